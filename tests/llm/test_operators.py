"""Each operator against a brute-force version on documents with awkward cases, and on an empty table."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from memlake.llm import bpe, components, license_scan, line_dedup, outliers, packing, quality, sharding, simhash, suffix_dedup, weighted_sampling
from memlake.llm.common import Stash
from tests.llm.fixtures import frame, prose, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [(1, "x")]).limit(0)


def rows(df):
    return [tuple(r) for r in df.collect()]


def same(got, expected):
    assert Counter(got) == Counter(expected)


# 1: suffix dedup


def test_difference_set_is_perfect():
    for q in (2, 3, 5, 11):
        d, v = suffix_dedup.difference_set(q), q * q + q + 1
        assert Counter((a - b) % v for a in d for b in d if a != b) == {k: 1 for k in range(1, v)}


def removed(texts_: list[bytes], n: int = suffix_dedup.LENGTH) -> list[list[bool]]:
    seen = Counter(t[i : i + n] for t in texts_ for i in range(len(t) - n + 1))
    out = []
    for t in texts_:
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


def test_suffix_dedup(docs, none):
    own = texts()
    coded = [(t or "").encode() for _, t in own]
    expected = []
    for (d, _), t, gone in zip(own, coded, removed(coded), strict=True):
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    same(rows(suffix_dedup.repeat_digests(docs)), expected)
    assert rows(suffix_dedup.repeat_digests(none)) == []


def test_suffix_windows_agree(monkeypatch, spark):
    """Texts over a window's length are cut into overlapping windows with the same result."""
    monkeypatch.setattr(suffix_dedup, "WINDOW", 4 * suffix_dedup.PERIOD)
    long = prose(900, 1)
    assert sum(len(g) for g in suffix_dedup.gathered([len(long)])) > 10
    own = [long, prose(30, 2) + long[2000:4000] + prose(30, 3), long[:150], prose(40, 9) + long[500:800]]
    got = rows(suffix_dedup.repeat_digests(frame(spark, list(enumerate(own)))))
    expected = removed([t.encode() for t in own])
    assert {d: r for d, _, r, _, _ in got} == {k: sum(g) for k, g in enumerate(expected)}


def test_a_hot_passage(spark):
    """One passage in very many documents, beside others that share nothing."""
    passage = prose(40, 1)
    own = [(k, prose(3 + k % 5, 10 + k) + passage + prose(2 + k % 3, 9000 + k)) for k in range(400)] + [(1000 + k, prose(30, 20_000 + k)) for k in range(50)]
    got = {d: (r, n) for d, _, r, n, _ in rows(suffix_dedup.repeat_digests(frame(spark, own)))}
    for (d, _), gone in zip(own, removed([t.encode() for _, t in own]), strict=True):
        assert got[d] == (sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)))


def test_suffix_dedup_keeps_columns(docs):
    out = suffix_dedup.dedup_text(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[40].text is None and got[41].text == "" and got[43].text == "one" and got[43].size == 3


def test_suffix_dedup_carries_any_column(spark):
    """Values of other columns come back as they were, microseconds and nested ones too."""
    own = spark.createDataFrame([(k, prose(60, k % 2) + f" {k}") for k in range(4)], "doc_id long, text string")
    own = own.withColumns({"ts": F.lit("2024-01-02 03:04:05.123456").cast("timestamp"), "rest": F.struct(F.lit(1.5).cast("decimal(9,3)").alias("text"), F.array(F.lit(None).cast("date")).alias("none"))})
    own = own.withColumn("extra", F.map_from_arrays(F.array(F.lit("a")), F.array("doc_id"))).select("extra", "text", "ts", "doc_id", "rest")
    out = suffix_dedup.dedup_text(own)
    assert out.dtypes == own.dtypes
    keep = lambda df: sorted(map(str, df.drop("text").collect()))
    assert keep(out) == keep(own) and all(len(r.text) < 250 for r in out.collect())


def test_suffix_dedup_in_more_rounds(docs, monkeypatch):
    """Buckets of a few bytes of input: as many rounds as it takes, the same result."""
    plain = rows(suffix_dedup.repeat_digests(docs))
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5 << 10)
    same(rows(suffix_dedup.repeat_digests(docs)), plain)


# 2: near duplicates


def brute_fingerprint(text: str | None, k: int = 3) -> int:
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(links: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_simhash(docs, none):
    own = [(d, t) for d, t in texts()]
    marks = [brute_fingerprint(t) for _, t in own]
    ids = [simhash.NO_ID if d is None else d for d, _ in own]
    links = [(ids[i], ids[j]) for i in range(len(own)) for j in range(i) if bin(marks[i] ^ marks[j]).count("1") <= 3]
    group = brute_components(links, ids)
    same(rows(simhash.near_duplicate_report(docs)), [(d, f"{m:016x}", None if group[i] == simhash.NO_ID else group[i]) for (d, _), m, i in zip(own, marks, ids, strict=True)])
    assert rows(simhash.near_duplicate_report(none)) == []


def test_grid_loses_no_link(spark):
    """Clusters of fingerprints at all distances, one of them dense."""
    rng = np.random.default_rng(3)
    marks = set()
    for c in range(40):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(25 if c else 400):
            flips = rng.choice(64, int(rng.integers(0, 6)), replace=False)
            marks.add(base ^ sum(1 << int(f) for f in flips))
    marks = sorted(marks)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(0, k, m, 0) for k, m in enumerate(signed)], "family int, id long, fingerprint long, guard long")
    stash = Stash(spark)
    found = dict(rows(components.components(simhash.grid_links(df), stash)))
    x = np.array(marks, np.uint64)
    links = [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 3)]
    assert {k: found.get(k, k) for k in range(len(x))} == brute_components(links, list(range(len(x))))


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
@settings(max_examples=4, deadline=None)
def test_components(links):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long"), Stash(spark))))
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    assert got == brute_components(links, nodes) if nodes else got == {}


def jaccard(a: str, b: str) -> float:
    x, y = (set(simhash.shingles(t.encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_keep_one(docs, spark):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept))
    assert 3 in kept and not {7, 10, 11, 12} & set(kept)  # the smallest id of the copies stays
    clean = {20, 21, 22, 23, 30, 31, 43, 44, 46, 48, 50, 52, 53, None}
    assert clean <= set(kept)


def test_symbol_rich_text_is_an_outlier(spark):
    rng = np.random.default_rng(5)
    body = lambda: ["".join(rng.choice(list("abcdefgh"), int(k))) for k in rng.integers(2, 9, 120)]
    own = [(k, " ".join(body())) for k in range(80)]
    own.append((80, " ".join(w + "|" * (k % 5 < 2) for k, w in enumerate(body()))))  # 0.4 symbols a word
    found = {r.doc_id: r.kept for r in outliers.verdicts(frame(spark, own)).collect()}
    assert not found[80] and all(found[k] for k in range(80))


def test_keep_one_after_edits_of_a_passage(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    words = lambda n: rng.choice(vocabulary, n).tolist()
    own, due = [], 0
    for k in range(90):
        base = words(int(rng.integers(101, 400)))
        n, at = len(base), int(rng.integers(0, len(base) * 9 // 10))
        other = [base + words(n * 18 // 100), base[: n - n * 18 // 100], base[:at] + words(n * 8 // 100) + base[at + n * 8 // 100 :]][k % 3]
        a, b = (set(simhash.shingles(" ".join(x).encode()).tolist()) for x in (base, other))
        due += len(a & b) >= 0.8 * len(a | b)
        own += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    assert due >= 80
    gone = [d for d, _, _ in rows(simhash.near_copies(frame(spark, own)))]
    assert len(gone) == due and all(d % 2 for d in gone)


def brute_gone(own: list[tuple[int, str]], similarity: float = 0.8) -> set[int]:
    """All pairs, by the elements that sets share: ids that have a smaller one in their component."""
    sets = [simhash.shingles((t or "").encode()) for _, t in own]
    sizes, links = np.array([len(s) for s in sets]), []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i, s in enumerate(sets):
        spans = zip(np.searchsorted(flat, s), np.searchsorted(flat, s, "right"), strict=True)
        both = np.bincount(np.concatenate([owner[x:y] for x, y in spans]), minlength=len(sets)) if len(s) else np.where(sizes == 0, 1, 0)
        near = both / np.maximum(sizes + sizes[i] - both, 1) >= similarity if len(s) else sizes == 0
        links += [(own[i][0], own[j][0]) for j in np.flatnonzero(near[:i])]
    return {n for n, c in brute_components(links, [d for d, _ in own]).items() if n != c}


def test_near_copies_equal_brute_force(spark, monkeypatch):
    """Copies of one text, each with other words changed, with and without the text itself; block pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(17)
    vocabulary = [f"w{k}" for k in range(4000)]
    own: list[tuple[int, str]] = []
    for group, (n, edits) in enumerate([(60, 2), (60, 4), (25, 6), (8, 12), (3, 20)]):
        base = rng.choice(vocabulary, 150).tolist()
        for k in range(n):
            words = list(base)
            for at in rng.choice(150, 0 if k == n // 2 and group != 1 else edits, replace=False):
                words[at] = f"x{group}y{k}z{at}"
            own.append((len(own), " ".join(words)))
    own += [(len(own) + k, own[k][1].upper()) for k in range(5)]
    got = [d for d, _, _ in rows(simhash.near_copies(frame(spark, own)))]
    expected = brute_gone(own)
    assert len(expected) > 60 and len(got) == len(set(got)) and set(got) == expected


def test_near_copies_of_a_table_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {d for d, _, _ in rows(simhash.near_copies(table))}
    assert got == brute_gone(sorted((r.doc_id, r.text) for r in table.collect()))


def test_blank_texts_and_empty_tables(spark, none):
    own = [(5, None), (2, ""), (9, " \n "), (7, "word"), (None, "word")]
    assert {d for d, _, _ in rows(simhash.near_copies(frame(spark, own)))} == {5, 9, None}
    assert rows(simhash.near_copies(none)) == [] and rows(simhash.keep_one(none)) == []


def test_skewed_joins(spark):
    from memlake.llm.common import join_skewed

    data = spark.range(6000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    table = data.groupBy("k").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    assert Counter(rows(join_skewed(data, table, ["k"]))) == Counter(rows(data.join(table, "k")))


# 3: weighted sampling


def weights(text: str) -> Counter:
    return Counter(text.encode().translate(simhash.LOWERED).split())


def test_weighted_sampling(docs, none):
    own = sorted(texts(), key=lambda r: (-(1 << 63) if r[0] is None else r[0]))
    got = rows(weighted_sampling.fingerprint_neighbours(docs))
    by_text = {(t or ""): None for _, t in own}
    assert len(got) == len(own)
    by_id = {r[0]: r for r in got if r[0] != 7}
    order = [(d, t or "") for d, t in own]
    for k, (d, t) in enumerate(order):
        if d in (7, 3):  # the repeated row follows itself
            continue
        after = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q] if q else t
        r = by_id[d]
        assert r[1:3] == (len(t), hashlib.sha256(e.encode()).hexdigest())
        for other, near in ((e, r[5]), (after, r[6])):
            a, b = weights(t), weights(other)
            true = sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0
            assert abs(near - true) < 0.3
        by_text[t] = r[3]
    copies = {r[3] for r in got if r[0] in (3, 7, 10)}
    assert len(copies) == 1
    assert rows(weighted_sampling.fingerprint_neighbours(none)) == []


def test_collisions_estimate_generalised_jaccard():
    s = weighted_sampling
    errors = []
    for k in range(60):
        a, b = prose(80, k), " ".join(prose(80, k).split()[:50]) + " " + " ".join([prose(3, k)] * 10)
        x, y = weights(a), weights(b)
        errors.append(weighted_sampling.likeness(s.fingerprint(a.encode()), s.fingerprint(b.encode())) - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.25
    assert s.both(b"a b b", b"a b b") == (s.fingerprint(b"a b b"),) * 2


def plain_samples(counts: Counter) -> list[tuple]:
    """The definition, a term and a sample at a time: (hash of the term, t) of each sample."""
    out = []
    for k in range(weighted_sampling.SAMPLES):
        best = None
        for w, n in counts.items():
            h = np.array([xxhash.xxh64_intdigest(w, weighted_sampling.SEED)], np.uint64)
            r, log_c, b = (x[0, k] for x in weighted_sampling.draws(h))
            t = np.floor(np.float32(np.log(np.float32(n))) / r + b)
            a = log_c - r * (t - b) - r
            best = min(best or (np.inf,), (float(a), int(h[0]), int(t)))
        out.append(best[1:])
    return out


def test_sampler_equals_the_definition():
    for k in range(4):
        counts = weights(prose(30, k) + " again" * 7 + " twice twice")
        found = weighted_sampling.least(counts)
        got = [(int(h), int(t)) for h, t in zip(found[1], found[2], strict=True)]
        assert sum(x == y for x, y in zip(got, plain_samples(counts), strict=True)) >= 63  # rounding may move a tie


def test_fingerprints_do_not_depend_on_order():
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(20_000)]
    for n in (50, 4000, 20_000):
        own = words[:n] + words[: n // 3]
        marks = {weighted_sampling.fingerprint(" ".join(rng.permutation(own)).encode()) for _ in range(3)}
        assert len(marks) == 1
    a, b = " ".join(words[:15_000]), " ".join(words[5_000:])
    near = weighted_sampling.likeness(*weighted_sampling.both(a.encode(), b.encode()))
    assert abs(near - 0.5) < 0.25


def test_one_id_for_very_many_rows(spark):
    own = [(7, f"{prose(4, k)}") for k in range(900)] + [(None, prose(5, 2000 + k)) for k in range(400)] + [(k, prose(6, 5000 + k)) for k in range(20, 60)]
    got = rows(weighted_sampling.fingerprint_neighbours(frame(spark, own)))
    mark = lambda t: weighted_sampling.fingerprint(t.encode())
    assert Counter((r[0], r[3]) for r in got) == Counter((d, mark(t)) for d, t in own)
    ranged = weighted_sampling.boundaries(frame(spark, own).select(F.coalesce("doc_id", F.lit(weighted_sampling.LOWEST)).alias("id")), 4)
    assert sum(i == 7 for i, _ in ranged) >= 3


# 4: sharding


def test_sharding(docs, none, spark):
    out = sharding.shard_digests(docs)
    got = rows(out)
    own = texts()
    same([(r[0], r[1], r[2]) for r in got], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in own])
    slots = defaultdict(list)
    for r in got:
        slots[r[4]].append(r[5])
        assert r[3] == "bytes" and r[6] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rows(sharding.shard_digests(none)) == []
    many = frame(spark, [(k, prose(20 + k % 30, k)) for k in range(1500)] + [(5000 + k, "same text for all of these") for k in range(700)] + [(9, "row")] * 300)
    sizes, count = Counter(), Counter()
    for r in rows(sharding.shard_digests(many)):
        sizes[r[4]] += r[1]
        count[r[4]] += 1
    assert sum(count.values()) == 2500 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8 + 1200


# 5 and 10: tokenizers


ODD = ["", "   ", "a  b\n\n c \t d", "a" * 3000, "haha" * 300, "don't We'LL x's 12345 ١٢ 你好 世界 ΣΑΣ İstanbul é \x1cfoo bar <|endoftext|> 😀", "x y   z", "\n", " \n x"]


def test_byte_bpe(docs, none):
    encoder, tokens = bpe.rank_encoder(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens) if t}, special_tokens={})
    data = ODD + [t or "" for _, t in texts()]
    expected = [own.encode_ordinary(t) for t in data]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_texts(data)] == expected
    ids = {t: e for t, e in zip(data, expected, strict=True)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    same(rows(bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN)), [(d, len(ids[t or ""]), digest(" ".join(map(str, ids[t or ""])).encode()), digest((t or "").encode())) for d, t in texts()])
    assert rows(bpe.encode_digests(none, RANKS, public_tokenizers.PATTERN)) == []
    back = bpe.encode_documents(docs.where("doc_id = 50"), RANKS, public_tokenizers.PATTERN).first()
    assert bytes(back.decoded).decode() == dict(texts())[50] and back.ids == ids[dict(texts())[50]]


@given(st.lists(st.text(st.sampled_from(list("ab \n'1é你.t")), max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_byte_bpe_on_any_text(data):
    encoder, tokens = bpe.kept(bpe.rank_encoder, RANKS, public_tokenizers.PATTERN)
    own = bpe.kept(lambda: tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens) if t}, special_tokens={}))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_texts(data)] == [own.encode_ordinary(t) for t in data]


def test_rank_queue():
    q = bpe.RankQueue(50_000)
    rng = np.random.default_rng(1)
    ranks = rng.integers(0, 50_000, 400)
    for k, r in enumerate(ranks.tolist()):
        q.push(r, np.array([k]))
    got = []
    while (top := q.pop()) is not None:
        got += [top[0]] * len(top[1])
    assert got == sorted(ranks.tolist())


def test_packing(docs, none):
    own = Tokenizer.from_file(WORDS)
    own.encode_special_tokens = True
    encoder = bpe.word_encoder(WORDS)
    data = ODD + [t or "" for _, t in texts()]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_texts(data)] == [x.ids for x in own.encode_batch(data, add_special_tokens=False)]
    out = packing.pack_documents(docs, WORDS, keep_ids=True)
    got = [r.asDict() for r in out.collect()]
    expected = []
    for d, t in texts():
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            expected.append((d, k, at, np.array(ids[at : at + 2048], "<u4").tobytes()))
    same([(r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in got], expected)
    filled = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert rows(packing.pack_documents(none, WORDS)) == []


def plain_best_fit(lengths: list[int], capacity: tuple[int, int, int], rule: str) -> list[int]:
    """The rule, a sequence at a time."""
    bins, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for b, left in enumerate(bins):
            room = [x - y for x, y in zip(left, need, strict=True)]
            if min(room) >= 0:
                terms = [r * r for r in room] if rule == "norm" else [-x * y for x, y in zip(left, need, strict=True)]
                score = sum(w / c**2 * x for w, c, x in zip(packing.WEIGHTS, capacity, terms, strict=True))
                best = min(best or (np.inf, 0), (score, b))
        if best is None:
            bins.append(list(capacity))
            best = 0, len(bins) - 1
        bins[best[1]] = [x - y for x, y in zip(bins[best[1]], need, strict=True)]
        out[i] = best[1]
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(2048, 2048, 2048**2), (2048, 4, 2048**2), (2048, 9, 2048**2 + 1)])
def test_best_fit_equals_plain_loop(rule, capacity):
    lengths = np.random.default_rng(8).choice([3, 40, 41, 250, 600, 700, 1023, 1024, 1500, 2047, 2048], 400)
    bins, _ = packing.vector_best_fit(lengths, capacity, rule=rule)
    assert bins.tolist() == plain_best_fit(lengths.tolist(), capacity, rule)


def test_limits_of_documents_bind(docs):
    out = packing.pack_documents(docs, WORDS, documents=3).groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
    got = rows(out.select("n", "tokens"))
    assert max(n for n, _ in got) == 3 and max(t for _, t in got) <= 2048
    with pytest.raises(ValueError):
        packing.pack_documents(docs, WORDS, attention=1000)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_meets_all_capacities(rule):
    lengths = np.random.default_rng(2).integers(1, 2049, 3000)
    for capacity in ((2048, 2048, 2048**2), (2048, 3, 2048**2), (2048, 2048, 2_200_000 + 2048**2 // 2)):
        fitting = lengths[lengths.astype(float) ** 2 <= capacity[2]]
        bins, offsets = packing.vector_best_fit(fitting, capacity, rule=rule)
        assert (np.bincount(bins, fitting) <= capacity[0]).all() and np.bincount(bins).max() <= capacity[1] and (np.bincount(bins, fitting.astype(float) ** 2) <= capacity[2]).all()
        assert bins.max() + 1 >= fitting.sum() / capacity[0]
    bins, _ = packing.vector_best_fit(lengths, (2048, 2048, 2048**2), rule=rule)
    assert bins.max() + 1 <= 1.02 * lengths.sum() / 2048 + 1


# 6: outliers


def test_base_counts(docs, none):
    expected = []
    for d, t in texts():
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if twice[x] > 1 for j in range(3)}
        seen: set[str] = set()
        again = 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        expected.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    out = outliers.verdicts(docs)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance"]
    got = out.collect()
    same([tuple(r)[:7] for r in got], expected)
    assert all(not r.kept for r in got if r.base_failed)
    assert rows(outliers.verdicts(none)) == []


def test_base_counts_are_exact_where_hashes_clash(docs, monkeypatch):
    plain = rows(outliers.base_counts(docs))
    monkeypatch.setattr(outliers, "UNUSED", 46)
    same(rows(outliers.base_counts(docs)), plain)


@pytest.mark.parametrize("seed", range(3))
def test_estimate_is_the_minimum_determinant(spark, seed):
    """Against all subsets of three quarters of 14 rows."""
    from itertools import combinations

    rng = np.random.default_rng(seed)
    z = np.vstack([rng.normal(0, 1, (11, 4)) @ rng.normal(0, 1, (4, 4)), rng.normal(9, 1, (3, 4))])
    data = spark.createDataFrame([("en", "s", *map(float, r)) for r in z], "lang string, source string, z_0 double, z_1 double, z_2 double, z_3 double")
    found = {r.pooled: r for r in outliers.estimates(data, Stash(spark)).collect()}
    floor = np.diag(np.square(outliers.FLOORS))
    scatter = lambda rows_: outliers.CONSISTENCY * np.cov(rows_.T, bias=True) + floor
    least = min(np.linalg.slogdet(scatter(z[list(c)]))[1] / 2 for c in combinations(range(14), 11))
    assert found[True].logdet == pytest.approx(least) and found[False].logdet == pytest.approx(least)
    middle = z[:11].mean(axis=0)
    assert [found[True][f"m_{i}"] for i in range(4)] == pytest.approx(middle.tolist())


def test_consistency_factor():
    assert outliers.CUTOFF == pytest.approx(23.51, abs=0.01)  # tables of the chi-square distribution
    x = np.random.default_rng(1).normal(0, 1, (200_000, 4))
    inner = x[(x**2).sum(axis=1) <= outliers.chi2_quantile(outliers.KEEP)]
    assert outliers.CONSISTENCY * inner.var() == pytest.approx(1, abs=0.01)


def test_outliers_are_rejected(spark):
    clean = [(k, prose(60 + k % 90, k)) for k in range(400)]
    odd = [(1000 + k, " ".join(f"{w}%%%" for w in prose(80, k).split())) for k in range(60)]
    data = frame(spark, clean + odd).withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = {r.doc_id: r.kept for r in outliers.verdicts(data).collect()}
    assert sum(got[k] for k, _ in clean) >= 398 and not any(got[k] for k, _ in odd)


# 7: licences


def test_license_scan(docs, none):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    expected = []
    for d, t in texts():
        w = word.findall((t or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        expected.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = rows(license_scan.scan(docs))
    same([r[:6] for r in got], expected)
    assert all(0 <= r[7] <= 1 and set(r[5].split(",")) - {""} <= set(r[6].split(",")) for r in got)
    assert rows(license_scan.scan(none)) == []


def test_matching_statistics():
    rng = np.random.default_rng(4)
    texts_ = [rng.integers(0, 4, 30).tolist() for _ in range(3)]
    machine = license_scan.Automaton(texts_)
    inside = lambda x: any(t[i : i + len(x)] == x for t in texts_ for i in range(len(t)))
    for _ in range(20):
        query = rng.integers(0, 5, 40).tolist()
        found = machine.matches(query)
        expected, last = [], -1
        for end in range(1, len(query) + 1):
            n = max((n for n in range(end + 1) if n == 0 or inside(query[end - n : end])), default=0)
            if n and (end == len(query) or not inside(query[end - n : end + 1])):
                expected.append((end, n))
        assert [(e, n) for e, n, _ in found] == expected
        for end, n, state in found:
            for t, stop in machine.ends[state]:
                assert texts_[t][stop - n : stop] == query[end - n : end]


def test_license_chain_bridges_gaps():
    scanner = license_scan.Scanner()
    text = dict((label, t) for label, t in license_scan.TEMPLATES)["bsd"].replace("source and binary forms", "source and , maybe , binary forms")
    _, _, spans = scanner.scan(license_scan.words_of(("before words " + text + " after").encode()))
    assert [s for s in spans if s[0] == "bsd" and s[3] > 0.9]


def test_license_copies_give_spans_each():
    scanner = license_scan.Scanner()
    mit = next(t for label, t in license_scan.TEMPLATES if label == "mit" and len(t) > 300)
    text = f"first {mit} then other words {mit} and the MIT License again, the General Public License too"
    words = license_scan.words_of(text.encode())
    places, labels, spans = scanner.scan(words)
    assert len([s for s in spans if s[0] == "mit" and s[3] == 1.0 and s[2] - s[1] > 50]) == 2
    assert [b" ".join(words[k : k + 2]) for k in places] == [b"mit license", b"general public"] and labels == {"mit", "gpl"}


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(1, 4), st.integers(4, 25)), max_size=9))
@settings(max_examples=60, deadline=None)
def test_chains_equal_all_sequences(matches):
    """Against all ordered subsets: the most words of a valid chain that ends in each match."""
    matches = sorted(set(matches))
    follows = lambda x, y: 0 <= y[0] - x[0] - x[1] <= license_scan.GAP and 0 <= y[2] - y[1] - x[2] <= license_scan.GAP
    def most(k):  # noqa: E306
        return matches[k][1] + max([most(j) for j in range(k) if follows(matches[j], matches[k])], default=0)
    assert [c[0] for c in license_scan.chained(matches)] == [most(k) for k in range(len(matches))]


# 8: lines


def brute_lines(own):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    first: dict[str, tuple] = {}
    rank = lambda d: (d is not None, d or 0)
    for d, t in own:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), rank(d)), rank(d))
    out = []
    for d, t in own:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == rank(d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(docs, none, spark):
    same(rows(line_dedup.line_digests(docs)), brute_lines(texts()))
    assert rows(line_dedup.line_digests(none)) == []
    # One line in every document and one document of many lines: hot keys take the salted way.
    many = [(k, f"{prose(5, k)}\nthe very same line\n{prose(4, k % 50)}") for k in range(3000)] + [(9000, "\n".join(f"line number {k % 70} of it" for k in range(500)))]
    same(rows(line_dedup.line_digests(frame(spark, many))), brute_lines(many))


# 9: quality


def labelled(n: int, start: int = 0):
    data, labels = [], []
    for k in range(start, start + n):
        text, good, toxic = prose(40 + k % 60, k), 1, 0
        if k % 5 == 0:
            text, good = " ".join(f"{w}###" for w in text.split()), 0
        if k % 7 == 0:
            text, toxic = text + " you awful villain", 1
        data.append((k, text))
        labels.append((k, good, toxic))
    return data, labels


def test_quality(spark, none):
    data, labels = labelled(1200)
    marks = spark.createDataFrame(labels[:700], "doc_id long, quality int, toxic int")
    df = frame(spark, data)
    got = {r.doc_id: r.kept for r in quality.judge(df, marks).collect()}
    wanted = {d: bool(q and not t) for d, q, t in labels}
    held_out = [d for d, _, _ in labels[700:]]
    assert sum(got[d] == wanted[d] for d in held_out) >= 0.97 * len(held_out)
    kept = quality.keep_good(df, marks)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, k in got.items() if k}
    assert rows(quality.judge(none, marks)) == []


def test_quality_without_labels(docs, spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows(quality.judge(docs, marks))
    assert len(got) == docs.count() and all(r[-1] for r in got)


def test_sparse_sites_shrink(spark):
    scores = spark.createDataFrame([("big", "p", 0.9, 0.1)] * 200 + [("other", "p", 0.3, 0.1)] * 200 + [("tiny", "p", 0.0, 0.9)], "host string, path string, quality double, toxic double")
    found = {r.host: r for r in quality.posteriors(scores, Stash(spark)).collect()}
    world = found["tiny"].rate_quality
    assert abs(found["big"].host_quality - 0.9) < 0.02 and 0.0 < found["tiny"].host_quality < world


def test_posteriors_equal_plain_loops(spark):
    data, labels = labelled(300)
    marks = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    df = frame(spark, data).withColumns({"source": F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")), "lang": F.when(F.col("doc_id") % 3 > 0, "en")})
    got = quality.judge(df, marks).collect()
    for task in quality.TASKS:
        p = {r.doc_id: r[f"evidence_{task}"] for r in got}
        path = {r.doc_id: (r.host, r.path) for r in got}
        hosts, paths = defaultdict(list), defaultdict(list)
        for d, x in p.items():
            hosts[path[d][0]].append(x)
            paths[path[d]].append(x)
        n = len(p)
        mean = sum(p.values()) / n
        spread = sum(len(x) * (sum(x) / len(x)) ** 2 for x in hosts.values()) / n - mean**2
        worth = min(max(mean * (1 - mean) / max(spread - mean * (1 - mean) * len(hosts) / n, 1e-6) - 1, 1.0), 1000.0)
        for r in got:
            host = (sum(hosts[r.host]) + worth * mean) / (len(hosts[r.host]) + worth)
            others = paths[(r.host, r.path)]
            prior = (sum(others) - p[r.doc_id] + worth * host) / (len(others) - 1 + worth)
            odds = p[r.doc_id] / (1 - p[r.doc_id]) * (1 - mean) / mean * prior / (1 - prior)
            assert abs(r[f"posterior_{task}"] - odds / (1 + odds)) < 1e-6


def test_sample_is_bounded(spark, monkeypatch):
    data, labels = labelled(300)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda words, shapes, y, default: seen.append(words) or quality.Model(*[np.zeros(0, np.int32), np.zeros(0, np.float32)], np.zeros(8, np.float32), np.zeros(8), np.ones(8), 0.0))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for sample, most in ((50, 10**6), (300, 900)):
        monkeypatch.setattr(quality, "SAMPLE", sample)
        monkeypatch.setattr(quality, "SAMPLE_WORDS", most)
        twice = frame(spark, data + [(k, t + " other") for k, t in data[:150]])  # ids that repeat with other texts
        quality.train(twice, marks, Stash(spark))
        assert 0 < len(seen[-1]) <= sample and sum(map(len, seen[-1])) <= most


# the pipeline


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{d}/documents.parquet")
    now, counts = docs_, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = Stash(spark).put("stage", stage(spark, now, d))
        assert now.columns == docs_.columns
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[0] < docs_.count()
    kept = [r.text for r in now.collect()]
    clean = [t for t in kept if len(t.split()) > 30]
    assert all(jaccard(a, b) < 0.8 for k, a in enumerate(clean) for b in clean[:k])
    packed = corpus_pipeline.run(spark, d)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_line_query_equals_sql(spark):
    from tests.oracle_check import compare, connection

    from memlake.llm import queries

    compare(spark, connection(), queries.queries()["op8_line_dedup"], json.loads(json.dumps(queries.oracle_sql()["op8_line_dedup"])))


def test_fingerprints_of_long_texts_are_counted_in_parts(monkeypatch):
    text = prose(300, 5)
    whole = simhash.word_marks(text.encode())
    monkeypatch.setattr(simhash, "TOGETHER", 7)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    assert simhash.word_marks(text.encode()).tolist() == whole.tolist()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_awkward_tables(spark, docs, none, empty):
    """Nulls, repeated rows and columns whose names the operators use inside; and a table without rows."""
    start = none if empty else docs
    now = start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = Stash(spark).put(name, stage(spark, now, "/root/testdata/sf0.001"))
        assert now.columns == start.columns
    kept = now.collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    if empty:
        assert not kept
    else:
        assert {r.bucket for r in kept} == {2} and {r.version for r in kept} == {"v"} and 3 in {r.doc_id for r in kept}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == len({r.doc_id for r in kept})


def test_equal_texts_with_clashing_labels(spark):
    """Repeated ids and equal texts count once in the fitted sample; all rows get a verdict."""
    data, labels = labelled(150)
    marks = spark.createDataFrame(labels + [(d, 1 - q, 1 - t) for d, q, t in labels[:20]], "doc_id long, quality int, toxic int")
    df = frame(spark, data + data[:30] + [(5000 + k, data[0][1]) for k in range(40)])
    got = quality.judge(df, marks)
    assert got.count() == 220 and got.where("kept IS NULL").isEmpty()
