"""Small documents with the awkward cases, and extra columns whose names operators use inside."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, row string, block int, line string, bucket int, size long, name string, key string, version string"

random.seed(5)
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "sa", "vo", "ne") for b in ("ban", "dil", "for", "gus", "hem", "jot", "kip", "lam")]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60, 99)
LINE = "This is a line that many documents have in common."


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(120, 1)
    rows: list[tuple[int | None, str | None]] = [(10, base), (3, base), (7, base), (7, base)]  # copies; one row repeated
    rows += [(11, base.replace(base.split()[5], "changed", 1)), (12, base + " and more at the end")]  # near copies
    rows += [(20 + k, prose(40, 20 + k) + "\n" + PASSAGE + "\n" + prose(30, 40 + k)) for k in range(4)]  # a passage at other offsets
    rows += [(30 + k, f"{prose(12, 60 + k)}\n  {LINE.upper() if k % 2 else LINE}\t\n{prose(9, 70 + k)}\n{LINE}") for k in range(5)]
    rows += [(40, None), (41, ""), (42, "   \n\t "), (43, "one"), (44, "two words"), (45, "\n"), (None, "a row without an id " + prose(60, 3)), (46, "a" * 700), (47, "na " * 400), (48, prose(9000, 8))]
    rows += [(50, "Größe ñandú — 你好 世界 😀 don't WE'LL 12345 \x1c mixed space"), (51, "Released under the MIT License. " + prose(20, 4)), (52, "the GNU General Public License and the MIT license"), (53, "x * y | z # " * 40 + prose(80, 5))]
    return rows


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(d, t, "en" if k % 3 else None, "s0" if k % 4 else None, None, "i", k, "r", 1, "l", 2, 3, "n", "k", "v") for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
