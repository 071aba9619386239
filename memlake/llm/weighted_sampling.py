"""Document fingerprints by consistent weighted sampling.

Terms are a text's words (lower-cased A-Z, split at ASCII white space), weighted by their counts. For
each of ``SAMPLES`` independent hash functions a term of weight w draws, from its own 64-bit hash,
r and c from Gamma(2, 1) and b uniform; t = floor(ln w / r + b) and a = c / exp(r (t - b) + r). The
term with the smallest a (equal ones: the smallest hash) is the sample, together with its t. Two texts
have the same sample with a probability equal to the generalised Jaccard similarity of their weights
(sum of minima over sum of maxima), so the share of equal samples estimates it. A sample is kept as 16
bits of a hash. A fingerprint depends on the weighted set alone and not on the order of words.

``fingerprint_neighbours`` also gives every document its successor by id: documents are dealt to
ranges of (id, hash of the text), each range gets the first row of the next non-empty one (a bounded
number of rows), and tasks sort and stream their ranges. Ids that very many rows repeat are cut into
ranges by the hash.

Cases: null text is empty; an empty text has a fingerprint of its own, equal to itself only; equal
texts have equal fingerprints; rows that repeat an id follow each other, ordered by a hash of the text; a
null doc_id sorts first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import bounded_batches
from memlake.llm.simhash import LOWERED

SAMPLES, SEED = 64, 0x5EED
#: Terms drawn together: the draws stay in the processor's cache.
TOGETHER = 128
EMPTY = "ffff" * SAMPLES
LOWEST = -(1 << 63)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Per sample and per 64 random bits: what a term's hash is combined with.
_SALTS = mixed((np.arange(2 * SAMPLES, dtype=np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, SAMPLES)
#: What wins against no term.
_NOTHING = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int32)


#: ln of 2^64 and of 2^44, a rounding step more, so that no draw is zero.
_WHOLE, _PART = np.float32(64 * np.log(2) + 1e-5), np.float32(44 * np.log(2) + 1e-5)
_LOW, _HALF = np.uint64((1 << 22) - 1), np.float32(0.5)


def draws(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of terms (rows) and samples (columns). Gamma(2, 1) is minus the logarithm of a product of two
    uniform numbers: two pieces of 22 random bits make r, two of 32 make c, 20 make b."""
    one, two = (mixed(h[:, None] ^ salts) for salts in _SALTS)
    r = _PART - np.log(((one & _LOW).astype(np.float32) + _HALF) * ((one >> np.uint64(22) & _LOW).astype(np.float32) + _HALF))
    halves = two.view(np.uint32).reshape(*two.shape, 2).astype(np.float32) + _HALF
    log_c = np.log(_WHOLE - np.log(halves[..., 0] * halves[..., 1]))
    return r, log_c, ((one >> np.uint64(44)).astype(np.float32) + _HALF) * np.float32(2.0**-20)


def better(x: tuple, y: tuple) -> tuple:
    """Per sample the smaller of two samples (a, hash, t)."""
    first = (x[0] < y[0]) | ((x[0] == y[0]) & (x[1] <= y[1]))
    return tuple(np.where(first, p, q) for p, q in zip(x, y, strict=True))


def least(counts: dict[bytes, int]) -> tuple:
    """The samples (a as its logarithm, hash, t) of weighted terms."""
    if not counts:
        return _NOTHING
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in counts), np.uint64, len(counts))
    order = np.argsort(h)
    h, weights = h[order], np.fromiter(counts.values(), np.float32, len(counts))[order]
    found = _NOTHING
    for k in range(0, len(h), TOGETHER):
        own, w = h[k : k + TOGETHER], weights[k : k + TOGETHER]
        r, log_c, b = draws(own)
        a, t = log_c + r * (b - 1), np.zeros(r.shape, np.int32)  # at weight 1 t is 0
        if len(heavy := np.flatnonzero(w > 1)):
            steps = np.floor(np.log(w[heavy])[:, None] / r[heavy] + b[heavy])
            t[heavy], a[heavy] = steps, log_c[heavy] - r[heavy] * (steps - b[heavy]) - r[heavy]
        at = a.argmin(axis=0)  # hashes ascend, so of equal ones the smallest
        column = np.arange(SAMPLES)
        found = better(found, (a[at, column], own[at], t[at, column]))
    return found


def packed(found: tuple) -> str:
    """Per sample 16 bits of a hash of its term and t, as hexadecimal digits."""
    key = found[1] ^ (found[2].astype(np.int64).view(np.uint64) << np.uint64(32))
    return (mixed(key) >> np.uint64(48)).astype(">u2").tobytes().hex()


def weighted(text: bytes) -> Counter:
    return Counter(text.translate(LOWERED).split())


def fingerprint(text: bytes) -> str:
    counts = weighted(text)
    return packed(least(counts)) if counts else EMPTY


def both(text: bytes, edited: bytes) -> tuple[str, str]:
    """Fingerprints of a text and of an edited one: terms of equal weight in both are drawn once."""
    one, two = weighted(text), weighted(edited)
    if not one or not two:
        return fingerprint(text), fingerprint(edited)
    same = {w: n for w, n in one.items() if two.get(w) == n}
    shared = least(same)
    parts = ({w: n for w, n in x.items() if w not in same} for x in (one, two))
    first, second = (packed(better(shared, least(x))) for x in parts)
    return first, second


def likeness(a: str, b: str) -> float:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k] if k else text


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    bounded_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), body.alias("body"), F.xxhash64(body).alias("hash"))
    bounds = boundaries(rows, partitions)
    ranged = rows.withColumn("range", (_search(bounds) if bounds else F.lit(0)).cast("int"))
    first = F.min(F.struct("id", "hash")).alias("least")
    heads = sorted((r["range"], r["least"]["id"], r["least"]["hash"]) for r in ranged.groupBy("range").agg(first).collect())
    # The first row of each range also goes to the range before it, as a row that only ends it.
    closing = [(heads[k - 1][0], id, hash, own) for k, (own, id, hash) in enumerate(heads)]
    table = spark.createDataFrame(closing, "into int, head long, head_hash long, own int")
    ends = ranged.join(F.broadcast(table), (F.col("range") == F.col("own")) & (F.col("id") == F.col("head")) & (F.col("hash") == F.col("head_hash")))
    row = F.min_by(F.struct("doc_id", "id", "body", "hash"), "body").alias("row")
    ends = ends.groupBy(F.col("into").alias("range")).agg(row).select("row.*", "range", F.lit(1).alias("closes"))
    both_ = ranged.select("doc_id", "id", "body", "hash", "range", F.lit(0).alias("closes")).unionByName(ends)
    dealt = both_.repartitionById(max(partitions, 1), "range").sortWithinPartitions("range", "closes", "id", "hash")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, row = None, None
        for batch in batches:
            out = []
            for doc, body, closes in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist(), batch["closes"].to_pylist(), strict=True):
                if prior is not None:
                    before, text = prior
                    raw = edited(text, body).encode()
                    first, second = both(text.encode(), raw)
                    if row is not None:  # the row before waits for this text's fingerprint
                        out.append((*row, likeness(row[3], first)))
                    row = before, len(text), hashlib.sha256(raw).hexdigest(), first, second, likeness(first, second)
                prior = doc, body
                if closes:
                    out.append((*row, likeness(row[3], fingerprint(body.encode()))))
                    prior = row = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def boundaries(rows: DataFrame, partitions: int) -> list[tuple[int, int]]:
    """First (id, hash) of each range but the lowest: quantiles of the ids, exact enough for even tasks and no
    matter for the result, and equal steps of the hash within ids that over 1 / partitions of all rows have."""
    if partitions < 2:
        return []
    quantiles = F.percentile_approx("id", [k / partitions for k in range(1, partitions)], 20 * partitions)
    cuts, total = rows.agg(quantiles, F.count("*")).first()
    found = {(int(x), LOWEST) for x in cuts or []}
    for id, n in rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > max(total // partitions, 100)).collect():
        steps = -(-n * partitions // total)
        found |= {(id, LOWEST + (k << 64) // steps) for k in range(steps)} | ({(id + 1, LOWEST)} if id < (1 << 63) - 1 else set())
    return sorted(found)


def _search(bounds: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or below (id, hash): a balanced tree of comparisons."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        id, hash = bounds[m]
        reached = F.col("id") >= id if hash == LOWEST else (F.col("id") > id) | ((F.col("id") == id) & (F.col("hash") >= hash))
        return F.when(reached, tree(m + 1, b)).otherwise(tree(a, m))

    return tree(0, len(bounds))
