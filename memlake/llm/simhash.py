"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints. A text's word shingles are hashed with XXH64 (seed 42); a bit of the 64-bit
fingerprint is 1 if it is set in over half of the hashes.

Links. Two fingerprints link if they differ in at most ``RADIUS`` bits. A fingerprint is mapped to
the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors never exceeds
the number of differing bits. If it is at most 3, then it is at most 1 in the upper or in the
lower sixteen segments, so it suffices to range-join with radius 1 in each half: every distinct
fingerprint goes into the grid cell of its own half vector and, as a probe, into the cells that are
larger by one in one segment (of two neighbours one is the larger). Rows of a cell meet in one
task as they stream by in order of cells; pairs are verified on all 64 bits there.

Groups. Equal fingerprints are one row before the join, and a cell emits the links of a spanning
forest of its rows and not all its pairs, so copies and near copies cost no more than their number.
Components come from alternating stars over links.

Cases: null or empty text has fingerprint 0, linked like any other; repeated rows share their
document's component; rows with a null doc_id get the smallest id linked to them, or null; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import Stash, bounded_batches, join_skewed, map_batches, utf8
from memlake.llm.components import components

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Lower-cases A-Z.
LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingle hashes counted together.
TOGETHER = 1 << 16
NO_ID = (1 << 63) - 1
ODD = 0x55555555


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of UTF-8 bytes, unsigned."""
    words = text.translate(LOWERED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    spans = zip(at, at[shingle:], strict=False) if len(words) >= shingle else [(0, len(joined) + 1)]
    digest, n, counts = xxhash.xxh64_digest, 0, np.zeros(64, np.int64)
    hashes = [digest(joined[a : b - 1], seed) for a, b in spans]
    for k in range(0, len(hashes), TOGETHER):
        part = hashes[k : k + TOGETHER]
        counts += np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (signed 64-bit) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in utf8(batch["text"])], np.uint64)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fingerprint long")


def spanning_links(fingerprints: np.ndarray, guards: np.ndarray, radius: int, guard: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of all pairs within both radii, as positions."""
    links, rest = [], np.arange(len(fingerprints))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = (np.bitwise_count(fingerprints[rest] ^ fingerprints[at]) <= radius) & (np.bitwise_count(guards[rest] ^ guards[at]) <= guard)
            if near.any():
                found = rest[near].tolist()
                links += [(at, x) for x in found]
                queue += found
                rest = rest[~near]
    return links


def cell_links(cells: np.ndarray, fps: np.ndarray, guards: np.ndarray, ids: np.ndarray, probes: np.ndarray, radius: int, guard: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by cell: verified pairs of rows up to three places apart, and a
    spanning forest of each cell of over four rows. Two probes needn't meet: if they are within
    radius, one is in the other's cell in one of the halves."""
    a, b = [], []
    firsts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    ends = np.append(firsts[1:], len(cells))
    large = np.repeat(ends - firsts > 4, ends - firsts)
    for step in (1, 2, 3):
        same = np.flatnonzero((cells[step:] == cells[:-step]) & ~large[step:] & ~(probes[step:] & probes[:-step]))
        near = same[(np.bitwise_count(fps[same] ^ fps[same + step]) <= radius) & (np.bitwise_count(guards[same] ^ guards[same + step]) <= guard)]
        a.append(ids[near])
        b.append(ids[near + step])
    for k in np.flatnonzero(ends - firsts > 4):
        x = slice(firsts[k], ends[k])
        if not probes[x].all() and (links := spanning_links(fps[x], guards[x], radius, guard)):
            p, q = np.array(links).T
            a.append(ids[x][p])
            b.append(ids[x][q])
    return np.concatenate(a), np.concatenate(b)


def grid_links(representatives: DataFrame, radius: int = RADIUS, guard: int = 64) -> DataFrame:
    """Links (a, b) between representatives (family, id, fingerprint, guard) that connect exactly what the
    links of all pairs of a family connect whose fingerprints differ in at most ``radius`` bits and
    whose guards, a second fingerprint, in at most ``guard``. Families: 0 to 255."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves and neighbours at distance 1 cover a radius of 0 to 3")
    bounded_batches(representatives.sparkSession)
    half = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("fingerprint", 32).alias("bits")), F.struct(F.lit(1).alias("half"), F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF)).alias("bits"))))
    counts = F.col("bits").bitwiseAND(F.lit(ODD)) + F.shiftright("bits", 1).bitwiseAND(F.lit(ODD))
    own = representatives.select("family", "id", "fingerprint", "guard", half.alias("x")).select("family", "id", "fingerprint", "guard", "x.half", "x.bits").select("id", "fingerprint", "guard", (F.col("half") + 2 * F.col("family")).alias("half"), counts.alias("own"))
    # A segment's two bits hold its count, 0 to 2.
    larger = F.expr("transform(filter(sequence(0, 15), k -> (shiftright(own, 2 * k) & 3) < 2), k -> own + shiftleft(1L, 2 * k))")
    cells = own.select("id", "fingerprint", "guard", "half", F.posexplode(F.concat(F.array("own"), larger)).alias("n", "cell")).select(F.col("cell").bitwiseOR(F.shiftleft(F.col("half").cast("long"), 40)).alias("cell"), "id", "fingerprint", "guard", (F.col("n") > 0).alias("probe"))
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            cells, ids, fps, guards, probes = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = cell_links(cells, fps.view(np.uint64), guards.view(np.uint64), ids, probes, radius, guard)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "id", "fingerprint", "guard", "probe"))
            cut = int(np.searchsorted(new[0], new[0][-1]))  # the last cell may go on
            if cut or (held and held[-1][0][-1] != new[0][0]):
                yield links([*held, tuple(x[:cut] for x in new)] if cut else held)
                held = []
            held.append(tuple(x[cut:] for x in new))
        if held:
            yield links(held)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, stash: Stash | None = None) -> DataFrame:
    """doc_id, fingerprint (signed), component_id of each row."""
    stash = stash or Stash(docs.sparkSession)
    rows = stash.put("fingerprints", fingerprints(docs, shingle))
    representatives = stash.put("representatives", rows.groupBy("fingerprint").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id")))
    links = stash.put("grid", grid_links(representatives.withColumns({"family": F.lit(0), "guard": F.lit(0).cast("long")}), radius))
    found = components(links, stash)
    named = representatives.join(found, F.col("id") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "id").alias("component"))
    named = stash.put("named", named)
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return near_duplicates(docs).withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


#: Near copies share this part of their 5-word shingles; word fingerprints that look for candidates.
SIMILARITY, WORDS, FAMILIES = 0.8, 5, 4
#: Bits in which candidates' fingerprints of 5-word shingles may differ. At a similarity of 0.8 ten are
#: expected with a deviation of three (over 22: odds of 1e-5), of unrelated texts 32.
GUARD = 22
#: Min-hash bands over 5-word shingles, and minima in each. A band agrees with odds of J^MINIMA at a Jaccard
#: similarity of J, whatever the edit was: at 0.8 a pair that no band proposes has odds of
#: (1 - 0.8^5)^48 = 5e-9, at 0.1 one that some band does has odds of 5e-4.
BANDS, MINIMA = 48, 5
#: Equal minima that a candidate needs: a similarity of 0.8 gives 192 of 240 with a deviation of 6.2, so
#: the odds of fewer than this are 1e-9.
AGREE = 155
#: Partners that one copy of a text's shingles is compared with in a task; rows and bytes of a block.
BLOCK, BLOCK_BYTES = 256, 16 << 20
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * MINIMA), np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles multiplied together: the products stay in the processor's cache.
PRODUCTS = 128
#: The only band of a text without words.
BLANK = np.zeros(1, np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's word shingles (fewer words: the whole sequence), sorted."""
    own = text.translate(LOWERED).split()
    joined = b" ".join(own)
    at = [0, *accumulate(len(w) + 1 for w in own)]
    spans = zip(at, at[words:], strict=False) if len(own) >= words else [(0, len(joined) + 1)] if own else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in spans), np.uint64))


def majority(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bits (as bytes) that are set in over half of the weight of hashes (rows of bytes)."""
    counts = np.zeros(8 * hashes.shape[1])
    for k in range(0, len(hashes), TOGETHER):
        counts += weights[k : k + TOGETHER] @ np.unpackbits(hashes[k : k + TOGETHER], axis=1).astype(np.float64)
    return np.packbits(2 * counts > weights.sum())


def word_marks(text: bytes) -> np.ndarray:
    """FAMILIES independent fingerprints of words, each word as often as it stands."""
    counts = Counter(text.translate(LOWERED).split())
    if not counts:
        return np.zeros(FAMILIES, np.int64)
    raw = b"".join([xxhash.xxh3_128_digest(w, SEED + k) for w in counts for k in range(FAMILIES // 2)])
    return majority(np.frombuffer(raw, np.uint8).reshape(len(counts), -1), np.array(list(counts.values()), float)).view(np.int64)


def bands(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys of distinct shingle hashes (sets that share one are candidates) and a byte of each minimum."""
    if not len(found):
        return BLANK, bytes(BANDS * MINIMA)
    least = np.full(BANDS * MINIMA, (1 << 64) - 1, np.uint64)
    for k in range(0, len(found), PRODUCTS):  # an odd factor permutes the hashes
        np.minimum(least, (found[k : k + PRODUCTS, None] * _ODD[0]).min(axis=0), out=least)
    least ^= least >> np.uint64(29)
    mixed = least * _ODD[1]
    return mixed.reshape(BANDS, MINIMA).sum(axis=1, dtype=np.uint64), (mixed >> np.uint64(56)).astype(np.uint8).tobytes()


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
    return both / (len(a) + len(b) - both)


def text_marks(docs: DataFrame) -> DataFrame:
    """id, text hashes h and g, word fingerprints, guard, band keys, sketch and bytes of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch["text"])
        sets = [shingles(t) for t in texts]
        marks = np.concatenate([word_marks(t) for t in texts])
        guards = [majority(x.astype(">u8").view(np.uint8).reshape(-1, 8), np.ones(len(x))).tobytes() if len(x) else bytes(8) for x in sets]
        keys, sketches = zip(*map(bands, sets), strict=True)
        parts = [
            pa.ListArray.from_arrays(pa.array(np.arange(0, len(marks) + 1, FAMILIES), pa.int32()), pa.array(marks)),
            pa.array(np.frombuffer(b"".join(guards), ">i8").astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys).view(np.int64))),
            pa.array(sketches, pa.binary()),
            pa.array([len(t) for t in texts], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([*[batch[c] for c in ("id", "h", "g")], *parts], ["id", "h", "g", "marks", "guard", "bands", "sketch", "bytes"])

    return map_batches(docs, run, "id long, h long, g long, marks array<long>, guard long, bands array<long>, sketch binary, bytes long")


def shared_bands(texts: DataFrame, stash: Stash) -> DataFrame:
    """n, band, head of each text in each band that it shares. The head of a band is its most popular text: the one
    whose bands are shared most, as the original of many edited copies is. Bands of one text go."""
    keys = texts.select("n", F.explode("bands").alias("band"))
    counts = keys.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    keys = stash.put("shared", join_skewed(keys, stash.put("counts", counts), ["band"]))
    # A text has BANDS bands at most, so they can travel with their sum.
    popular = keys.groupBy("n").agg(F.sum("size").alias("popularity"), F.collect_list(F.struct("band", "size")).alias("own"))
    popular = popular.select("n", "popularity", F.explode("own").alias("x")).select("n", "popularity", "x.*")
    heads = popular.groupBy("band").agg(F.max_by("n", F.struct("popularity", -F.col("n"))).alias("head"), F.first("size").alias("size"))
    return stash.put("banded", join_skewed(keys.select("n", "band"), stash.put("heads", heads), ["band"]).drop("size"))


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches agree in AGREE minima or more."""
    sketch = lambda c: texts.select(F.col("n").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "sketch_a", "sketch_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
        near = pa.array((x == y).sum(axis=1) >= AGREE)
        return pa.RecordBatch.from_arrays([batch["a"].filter(near), batch["b"].filter(near)], ["a", "b"])

    return map_batches(both, run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, numbered: DataFrame, similarity: float, stash: Stash, name: str) -> DataFrame:
    """The pairs (a, b) whose texts (numbered: n, id, h, g) have a Jaccard similarity of shingles high enough.

    Partners of a text b are dealt in blocks of about BLOCK; b's text goes to each block once, so that a
    text with very many partners is many tasks' work. Texts travel once to their numbers and once to the blocks."""
    pairs = stash.put(f"pairs_{name}", pairs)
    hot = pairs.groupBy("b").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = join_skewed(pairs, stash.put(f"blocks_{name}", hot), ["b"]).select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"))
    dealt = stash.put(f"dealt_{name}", dealt)
    own = dealt.select("b", "block").distinct().select(F.col("b").alias("n"), "b", "block", F.lit(None).cast("long").alias("a"))
    asked = own.unionByName(dealt.select(F.col("a").alias("n"), "b", "block", "a")).join(numbered, "n").drop("n")
    rows = docs.join(asked, ["id", "h", "g"]).select("b", "block", "a", "text")
    rows = rows.repartition("b", "block").sortWithinPartitions("b", "block", F.asc_nulls_first("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for b, a, text in zip(batch["b"].to_pylist(), batch["a"].to_pylist(), utf8(batch["text"]), strict=True):
                if a is None:
                    head = shingles(text)
                elif similarity_of(head, shingles(text)) >= similarity:
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    bounded_batches(docs.sparkSession)
    return stash.put(f"links_{name}", rows.mapInArrow(run, "a long, b long"))


def cells_of(rows: DataFrame, fn: Callable[[list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` of the rows of each cell (head, low, high), in the order of n."""
    cell = ("head", "low", "high")
    dealt = rows.repartition(*cell).sortWithinPartitions(*cell, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[c] for c in cell)
                if now != last:
                    if len(held) > 1:
                        yield from fn(held)
                    last, held = now, []
                if not held or row["n"] != held[-1]["n"]:  # a repeated row of the input
                    held.append(row)
        if len(held) > 1:
            yield from fn(held)

    bounded_batches(rows.sparkSession)
    return dealt.mapInArrow(run, schema)


def partners(rows: list[dict]) -> Iterator[tuple[int, np.ndarray]]:
    """Of rows of two blocks: each row and those behind it that it may be alike to. Rows of one block meet among
    themselves where both blocks are the same one."""
    marks = np.frombuffer(b"".join([r["sketch"] for r in rows]), np.uint8).reshape(len(rows), -1)
    label, own = (np.array([r[c] for r in rows]) for c in ("label", "own"))
    for k in range(len(rows) - 1):
        other = label[k + 1 :] != label[k]
        if rows[0]["low"] != rows[0]["high"]:
            other &= own[k + 1 :] != own[k]
        rest = np.flatnonzero(other) + k + 1
        yield k, rest[(marks[rest] == marks[k]).sum(axis=1) >= AGREE]


def left_over(stars: DataFrame, found: DataFrame, texts: DataFrame, docs: DataFrame, similarity: float, stash: Stash) -> DataFrame:
    """Links between members of one head's bands that are in different components (``found``).

    Two texts of one band have its head in common, so all pairs of bands are pairs of heads' groups. Groups whose
    members are all in one component are done. The others' members are dealt to blocks of about BLOCK rows and
    BLOCK_BYTES by a hash, and each two blocks of a group meet in one task, first with sketches alone, then with the
    texts of those that have a partner of a like sketch. A task gives the links of a spanning forest, so that no rows
    grow with the square of a group."""
    label = F.coalesce("component", "n").alias("label")
    members = stars.select(F.col("a").alias("n"), F.col("b").alias("head")).join(texts.select("n", "bytes"), "n")
    members = stash.put("members", members.join(found, F.col("n") == F.col("node"), "left").select("n", "head", "bytes", label))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    groups = members.groupBy("head").agg(F.count("*").alias("size"), blocks.alias("blocks"), F.min("label").alias("first"), F.max("label").alias("last"))
    rows = join_skewed(members, stash.put("groups", groups.where("first < last").select("head", "size", "blocks")), ["head"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("head", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "n", "label", "own")
    schema = "head long, low int, high int, n long, label long, own int"

    def near(held: list[dict]) -> Iterator[pa.RecordBatch]:
        some = np.zeros(len(held), bool)
        for k, rest in partners(held):
            some[rest] = True
            some[k] |= len(rest) > 0
        if some.any():
            names = ["head", "low", "high", "n", "label", "own"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([held[k][c] for k in np.flatnonzero(some)], t) for c, t in zip(names, kinds, strict=True)], names)

    near_rows = stash.put("near", cells_of(rows.join(texts.select("n", "sketch"), "n"), near, schema))

    def links(held: list[dict]) -> Iterator[pa.RecordBatch]:
        sets, group, out = [shingles((r["text"] or "").encode()) for r in held], list(range(len(held))), []

        def of(k: int) -> int:
            while group[k] != k:
                group[k] = group[group[k]]
                k = group[k]
            return k

        for k, rest in partners(held):
            for j in rest.tolist():
                if of(k) != of(j) and similarity_of(sets[k], sets[j]) >= similarity:
                    group[of(j)] = of(k)
                    out.append((held[j]["n"], held[k]["n"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    whole = docs.join(near_rows.join(texts.select("n", "id", "h", "g", "sketch"), "n"), ["id", "h", "g"]).drop("id", "h", "g")
    return stash.put("links_left", cells_of(whole, links, "a long, b long"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, stash: Stash | None = None) -> DataFrame:
    """Rows that go because an exact or near copy stays: doc_id, text hashes h and g.

    Near copies are the components of links between texts whose 5-word shingles have an exact Jaccard
    similarity of ``similarity`` or more; of each the smallest id stays (equal ids: the smallest hashes).

    1. Equal texts are one, numbered n. Candidate pairs come in two ways. SimHash fingerprints of words are
       shared but for a few bits by copies with scattered edits: they meet in the grid join, in any of FAMILIES
       independent fingerprints, if their fingerprints of 5-word shingles aren't far apart either (GUARD).
       Passages that were added, cut or replaced move more bits than that; min-hash bands of the 5-word
       shingles propose these, as their odds depend on the similarity alone.
    2. Each band pairs its members with one head, so a group of m copies gives about m pairs and not m^2;
       pairs with unlike sketches go, the others' texts are compared exactly. Components of these links.
    3. What a head's bands still hold in more than one component is compared block by block (``left_over``), so
       nothing rests on the choice of heads.

    Cases: null, empty and blank texts are near copies of each other; a null doc_id counts as the largest;
    rows that repeat id and text stay once (``keep_one``); an empty table gives no rows."""
    spark = docs.sparkSession
    stash = stash or Stash(spark)
    keys = [F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g")]
    rows = stash.put("marks", text_marks(docs.select(*keys, "text")))
    firsts = [F.first(c).alias(c) for c in ("marks", "guard", "bands", "sketch", "bytes")]
    texts = rows.groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *firsts)
    texts = stash.put("texts", texts.withColumn("n", F.monotonically_increasing_id()))
    each = texts.select(F.col("n").alias("id"), "guard", F.posexplode("marks").alias("family", "fingerprint"))
    grid = stash.put("grid", grid_links(each, RADIUS, GUARD))
    banded = shared_bands(texts, stash)
    stars = stash.put("stars", banded.where("n <> head").select(F.col("n").alias("a"), F.col("head").alias("b")).distinct())
    first = alike(stars.unionByName(grid.where("a <> b")).distinct(), texts)
    numbered, bodies = texts.select("n", "id", "h", "g"), docs.select(*keys, "text")
    links = verified(first, bodies, numbered, similarity, stash, "heads")
    found = stash.put("found", components(links, stash))
    more = left_over(stars, found, texts, bodies, similarity, stash)
    if not more.isEmpty():
        found = stash.put("all", components(links.unionByName(more), stash))
    group = F.coalesce("component", "n").alias("group")
    grouped = texts.select("n", "id", "h", "g", "copies").join(found, F.col("n") == F.col("node"), "left")
    grouped = stash.put("grouped", grouped.select("id", "h", "g", "copies", group))
    stays = grouped.groupBy("group").agg(F.min(F.struct("id", "h", "g")).alias("stays"), F.count("*").alias("size"))
    named = join_skewed(grouped, stays, ["group"]).select("h", "g", "stays", F.col("copies").alias("size"))
    gone = join_skewed(rows.select("id", "h", "g"), stash.put("named", named), ["h", "g"]).where(F.struct("id", "h", "g") != F.col("stays")).select("id", "h", "g").distinct()
    gone = stash.put("gone", gone)
    stash.clear("gone")
    return gone.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "h", "g")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of exact and near copies: the one with the smallest id, whole. Rows that
    repeat both id and text stay once. Cases as in ``near_copies``; other columns pass through."""
    gone = near_copies(docs, similarity).select(F.col("doc_id").alias("doc"), F.col("h").alias("of_h"), F.col("g").alias("of_g"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g"))
    left = rows.join(gone, F.col("id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("of_h")) & (F.col("g") == F.col("of_g")), "left_anti")
    return left.dropDuplicates(["id", "h", "g"]).select("row.*")
