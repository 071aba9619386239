"""Removal of byte strings that repeat, by difference-cover blockwise suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts at another place too, in the same
document or another. Only ties of that depth matter, so suffixes are ordered by names
(fingerprints) instead of bytes: suffixes with equal prefixes are neighbours in either order.

Cover sample. With v = q^2 + q + 1 and D a perfect difference set mod v, any two positions i and j have
a shift below v that takes both into the sample {p: p mod v in D}. So two suffixes that agree in
LENGTH bytes have a sample position below v from their start at which both agree in the next
LENGTH - v + 1 bytes. The sample is |D| / v of all positions (12 of 133).

1. Ranks of the sample: each sample position gets the name of the string of LENGTH - v + 1 bytes
   there, and of LENGTH bytes. Names are dealt to buckets, in ``SAMPLE_PASSES`` rounds, and a task
   sorts one bucket. Positions whose short name recurs are tied; those whose long name recurs as well
   start a repeat.
2. All other suffixes: one can only tie with another at depth LENGTH if a tied sample position lies
   within the next v - 1 bytes; all others are resolved by the sample's ranks and go no further.
   The open suffixes' bytes are written once. Each gets a name of 128 bits at depth LENGTH, is
   dealt to a bucket, in ``SUFFIX_PASSES`` rounds, and sorted there; equal neighbours start a
   repeat. Only suffixes whose bytes step 1 has not yet found removed need the answer sent back.
3. The repeats' spans return to their documents.

Between the steps positions travel as packed integers by blocks of documents, a few thousand a row.
Names that recur within a batch of documents are tied there and then: their positions go straight to
their documents and one representative of each name goes to its bucket. So a string with very many
copies is one position a batch in its bucket, and not a hot key. Rounds are as many as keep a bucket at
the names of ``BUCKET_BYTES`` of input. Memory: a bucket of names, or the documents of a batch.
A false tie in step 1 costs a candidate; a false repeat needs two distinct strings with 128 equal
bits (step 1: short and long name).

Cases: null text has no bytes; texts under LENGTH bytes lose nothing; equal rows are each other's
repeats; a null doc_id is kept; an empty table gives no rows; other columns pass through
``dedup_text``.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.llm.common import Stash, bounded_batches

LENGTH, ORDER = 200, 11
#: Rounds in which buckets are dealt, at least; each needs its share of the disk that all names would need.
SAMPLE_PASSES, SUFFIX_PASSES = 2, 5
#: Bytes of text whose names make a bucket at most.
BUCKET_BYTES = 32 << 20
#: Blocks of documents a partition holds; bytes of input (as the plan estimates it) for a partition at
#: least. Every bucket sends a row to every block, so neither is made finer than the data call for.
BLOCKS, PARTITION_BYTES = 4, 4 << 20
BASES = (0x9E3779B97F4A7C15 | 3, 0xD1342543DE82EF95)


def difference_set(q: int) -> list[int]:
    """A perfect difference set mod q^2 + q + 1 for a prime q: exponents of a line in the cyclic group
    of points of the plane over GF(q), found with the first primitive cubic."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):  # x^3 = a x^2 + b x + c
                x, found = (1, 0, 0), []
                for k in range(v):
                    if x[2] == 0:
                        found.append(k)
                    x = ((c * x[2]) % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                    if x[1:] == (0, 0) and k < v - 1:
                        break
                else:
                    if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
                        return found
    raise ValueError("q is not a prime")


class Names:
    """Fingerprints of substrings by prefix sums: sum of table[byte] * base^k mod 2^64, shifted to 0."""

    def __init__(self, base: int):
        self.base = base
        rng = np.random.default_rng(base & 0xFFFFFFFF)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw) + 1
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        out = np.zeros(n, np.uint64)
        np.cumsum(self.table[raw] * self.up[: n - 1], out=out[1:])
        return out

    def at(self, sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        x = (sums[starts + length] - sums[starts]) * self.down[starts]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


_NAMES = [Names(b) for b in BASES]
COVER = np.array(difference_set(ORDER))
PERIOD = ORDER * ORDER + ORDER + 1
SHORT = LENGTH - PERIOD + 1


#: Bytes that are fingerprinted together; longer texts go in overlapping windows of whole periods.
WINDOW = PERIOD * 7000


def gathered(sizes: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Texts of these sizes as lists of (text, start, end) of about WINDOW bytes in all. Windows of one
    text overlap, so that every string of LENGTH bytes lies in one."""
    held, total = [], 0
    for k, n in enumerate(sizes):
        for start in range(0, max(n - LENGTH, 0) + 1, WINDOW):
            held.append((k, start, min(n, start + WINDOW + LENGTH - 1)))
            total += held[-1][2] - start
            if total >= WINDOW:
                yield held
                held, total = [], 0
    if held:
        yield held


#: Positions of some documents: each document's id and key, how many positions it has, the positions.
PACK = "ids binary, keys binary, counts binary, at binary"


def packed(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """``doc``: index into ids and keys of each position, non-decreasing."""
    firsts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    own = doc[firsts]
    return ids[own].tobytes(), keys[own].tobytes(), np.diff(np.append(firsts, len(doc))).astype(np.int32).tobytes(), at.astype(np.int32).tobytes()


def column(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(batch[name].to_pylist()), kind)


def release(stash: Stash) -> None:
    """Let Spark drop the shuffle files of finished steps, which no plan refers to any more. The listener
    bus holds on to its last event, and with it a plan, until another event comes: hence a tiny job."""
    stash.spark.sparkContext.parallelize([0], 1).count()
    gc.collect()
    stash.spark._jvm.System.gc()
    time.sleep(0.5)


def chosen(name: np.ndarray, buckets: int, low: int, high: int) -> np.ndarray:
    """Places of the names in buckets low to high."""
    bucket = (name >> np.uint64(33)) % np.uint64(buckets)
    return np.flatnonzero((bucket >= low) & (bucket < high))


def dealt(names: list[np.ndarray], ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, at: np.ndarray, buckets: int, low: int, high: int) -> Iterator[tuple]:
    """Rows (bucket, names, pack); all names are of the buckets low to high."""
    if not len(at):
        return
    bucket = ((names[0] >> np.uint64(33)) % np.uint64(buckets) - np.uint64(low)).astype(np.uint16 if high - low < 65536 else np.int64)
    own = np.argsort(bucket, kind="stable")
    bucket = bucket[own]
    firsts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(firsts, [*firsts[1:], len(own)], strict=True):
        x = own[a:b]
        yield int(bucket[a]), *[n[x].tobytes() for n in names], *packed(ids, keys, doc[x], at[x])


def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


NAMED, NAMED_KINDS = ["bucket", "name", "more", "ids", "keys", "counts", "at"], [pa.int32(), *[pa.binary()] * 6]
FOUND, FOUND_KINDS = ["block", "ids", "keys", "counts", "at"], [pa.int32(), *[pa.binary()] * 4]
NAMED_SCHEMA, FOUND_SCHEMA = f"bucket int, name binary, more binary, {PACK}", f"block int, {PACK}"


def runs_of(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of names: whether the first recurs, whether both do, and whether a pair is the first of its kind."""
    order = np.lexsort((two, one))
    same = one[order][1:] == one[order][:-1]
    both = same & (two[order][1:] == two[order][:-1])
    out = []
    for mark in (np.append(same, False) | np.append(False, same), np.append(both, False) | np.append(False, both), ~np.append(False, both)):
        at = np.zeros(len(one), bool)
        at[order] = mark
        out.append(at)
    return out[0], out[1], out[2]


def by_block(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, at: np.ndarray, blocks: int) -> list[tuple]:
    """Rows (block, pack) of positions."""
    if not len(at):
        return []
    block = (keys % blocks)[doc]
    order = np.lexsort((doc, block))
    doc, block, at = doc[order], block[order], at[order]
    firsts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    return [(int(block[a]), *packed(ids, keys, doc[a:b], at[a:b])) for a, b in zip(firsts, [*firsts[1:], len(doc)], strict=True)]


def known(rows: list[tuple], partitions: int) -> list[tuple]:
    """Rows (block, pack) as rows of a bucket that pass it by: without names, the block instead of them."""
    return [(block % partitions, b"", np.int32(block).tobytes(), *pack) for block, *pack in rows]


def sample_names(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], buckets: int, low: int, high: int, blocks: int) -> list[tuple]:
    """Names of the sample positions of documents, and the positions that tie among these documents."""
    own = [k for k, t in enumerate(texts) if len(t) >= LENGTH]
    parts = []
    for group in gathered([len(texts[k]) for k in own]):
        doc, start, end = np.array(group, np.int64).T
        raw = np.frombuffer(b"".join([texts[own[k]][a:b] for k, a, b in group]), np.uint8)
        size = end - start
        periods = -(-size // PERIOD)
        piece = np.repeat(np.arange(len(group)), periods)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(periods) - periods, periods)
        at = ((nth * PERIOD)[:, None] + COVER).ravel()
        piece = np.repeat(piece, len(COVER))
        # A window's last LENGTH - 1 bytes are the next one's first, unless the text ends here.
        ends = np.array([len(texts[own[k]]) == b for k, _, b in group])
        inside = (at < WINDOW) | ends[piece]
        inside &= at <= size[piece] - SHORT
        at, piece = at[inside], piece[inside]
        offset = (np.cumsum(size) - size)[piece]
        name = _NAMES[0].at(_NAMES[0].sums(raw), at + offset, SHORT)
        x = chosen(name, buckets, low, high)
        name, at, piece, offset = name[x], at[x], piece[x], offset[x]
        more = np.zeros(len(at), np.uint64)  # 0: no LENGTH bytes to go
        full = at <= size[piece] - LENGTH
        more[full] = _NAMES[1].at(_NAMES[1].sums(raw), (at + offset)[full], LENGTH) | np.uint64(1)
        parts.append((name, more, np.array(own)[doc[piece]], at + start[piece]))
    if not parts:
        return []
    name, more, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    tied, start, x = runs_of(name, more)
    own = by_block(ids, keys, doc[tied], np.where(start & (more != 0), ~at, at)[tied], blocks)
    return [*known(own, high - low), *dealt([name[x], more[x]], ids, keys, doc[x], at[x], buckets, low, high)]


def repeated(bucket: list[pa.RecordBatch], blocks: int, sampled: bool) -> list[tuple]:
    """Rows (block, pack) of the positions of one bucket that tie. Sampled: short names tie, and a
    position that starts a repeat is given as its complement (below 0). Else: those of the positions
    given as complements that start a repeat."""
    name, more = (np.concatenate([column(b, c, np.uint64) for b in bucket]) for c in ("name", "more"))
    ids, keys = (np.concatenate([column(b, c, np.int64) for b in bucket]) for c in ("ids", "keys"))
    counts, at = (np.concatenate([column(b, c, np.int32) for b in bucket]) for c in ("counts", "at"))
    order = np.argsort(name)
    same = name[order][1:] == name[order][:-1]
    tied = np.zeros(len(name), bool)
    tied[order[1:][same]] = tied[order[:-1][same]] = True
    tied = np.flatnonzero(tied)
    if not len(tied):
        return []
    order = tied[np.lexsort((more[tied], name[tied]))]
    both = (name[order][1:] == name[order][:-1]) & (more[order][1:] == more[order][:-1]) & (more[order][1:] != 0)
    start = np.zeros(len(name), bool)
    start[order[1:][both]] = start[order[:-1][both]] = True
    if sampled:
        at = np.where(start, ~at, at)
    else:  # only those that ask for it
        tied = np.flatnonzero(start & (at < 0))
        if not len(tied):
            return []
    return by_block(ids, keys, np.repeat(np.arange(len(ids)), counts)[tied], at[tied], blocks)


def sort_buckets(named: DataFrame, partitions: int, blocks: int, sampled: bool) -> DataFrame:
    """Each task sorts one bucket of names and returns what ties there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            named = pc.greater(pc.binary_length(batch["name"]), 0)
            if (passing := batch.filter(pc.invert(named))).num_rows:
                block = pa.array(column(passing, "more", np.int32))
                yield pa.RecordBatch.from_arrays([block, *[passing[c] for c in FOUND[1:]]], FOUND)
            if (own := batch.filter(named)).num_rows:
                held.append(own)
        if held:
            rows = repeated(held, blocks, sampled)
            for k in range(0, len(rows), 64):
                yield batch_of(rows[k : k + 64], FOUND, FOUND_KINDS)

    return named.repartitionById(partitions, "bucket").mapInArrow(run, FOUND_SCHEMA)


def keyed(docs: DataFrame, blocks: int) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = F.xxhash64("doc_id", "text")
    return docs.select(F.col("doc_id"), key.alias("key"), F.pmod(key, F.lit(blocks)).cast("int").alias("block"), text.alias("body"))


def with_positions(docs: DataFrame, found: list[DataFrame], partitions: int, blocks: int, fn: Callable, names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """Brings positions to their documents, block by block: ``fn`` turns documents with their positions into rows
    (columns ``names``). If documents carry a column ``extra``, ``fn`` gives a row each and that passes through."""
    extra = next((f for f in docs.schema if f.name == "extra"), None)
    carried = lambda x: [x.alias("extra")] if extra else []
    nothing = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("body")]
    body = docs.select(F.lit(1).alias("kind"), "block", "doc_id", "key", "body", *[F.lit(None).cast("binary").alias(c) for c in FOUND[1:]], *carried(F.col("extra")))
    for f in found:
        none = carried(F.lit(None).cast(extra.dataType)) if extra else []
        body = body.unionByName(f.select(F.lit(0).alias("kind"), "block", *nothing, *FOUND[1:], *none))
    rows = body.repartitionById(partitions, F.pmod("block", F.lit(partitions))).sortWithinPartitions("block", "kind")
    full = StructType([*StructType.fromDDL(schema), *([extra] if extra else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict[tuple[int, int], list[np.ndarray]] = {}
        last = None
        for batch in batches:
            todo, places = [], []
            blocks_, kinds_ = batch["block"].to_pylist(), batch["kind"].to_pylist()
            for k, (block, kind) in enumerate(zip(blocks_, kinds_, strict=True)):
                if block != last:
                    positions, last = {}, block
                if kind == 0:
                    ids, keys = (np.frombuffer(batch[c][k].as_py(), np.int64).tolist() for c in ("ids", "keys"))
                    counts, at = (np.frombuffer(batch[c][k].as_py(), np.int32) for c in ("counts", "at"))
                    for key, part in zip(zip(ids, keys, strict=True), np.split(at, np.cumsum(counts)[:-1]), strict=True):
                        positions.setdefault(key, []).append(part)
                else:
                    doc, key = batch["doc_id"][k].as_py(), batch["key"][k].as_py()
                    at = positions.get((-1 if doc is None else doc, key))
                    todo.append((doc, key, batch["body"][k].as_py(), np.concatenate(at) if at else np.zeros(0, np.int32)))
                    places.append(k)
            out = fn(todo) if todo else []
            for k in range(0, len(out), 512):
                made = batch_of(out[k : k + 512], names, kinds)
                if extra:
                    made = pa.RecordBatch.from_arrays([*made.columns, batch["extra"].take(pa.array(places[k : k + 512]))], [*names, "extra"])
                yield made

    return rows.mapInArrow(run, full)


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n bytes a repeat that starts at one of ``starts`` covers."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + LENGTH, -1)
    return np.cumsum(steps[:n]) > 0


OPEN = ["doc_id", "key", "runs", "asks", "body"]
OPEN_SCHEMA = "doc_id long, key long, runs binary, asks binary, body binary"


def open_suffixes(rows: list[tuple]) -> list[tuple]:
    """The suffixes that the sample's ranks leave open, of each document that has any: runs of starts
    (first, end), a bit for each start that asks for an answer, the bytes from each run's first start to
    LENGTH - 1 behind its last."""
    out = []
    for doc, key, text, at in rows:
        n = len(text)
        if not len(at) or n < LENGTH:
            continue
        start = ~at[at < 0]
        tied = np.append(at[at >= 0], start)
        steps = np.zeros(n + 1, np.int32)
        np.add.at(steps, np.maximum(tied - (PERIOD - 1), 0), 1)
        np.add.at(steps, tied + 1, -1)
        open_ = np.cumsum(steps)[: n - LENGTH + 1] > 0
        runs = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8))).reshape(-1, 2)
        if not len(runs):
            continue
        sums = np.append(0, np.cumsum(covered(n, start), dtype=np.int32))
        asks = (sums[LENGTH:] - sums[:-LENGTH] < LENGTH)[open_]
        out.append((-1 if doc is None else doc, key, runs.astype(np.int32).tobytes(), np.packbits(asks).tobytes(), b"".join([text[a : b + LENGTH - 1] for a, b in runs.tolist()])))
    return out


def suffix_names(batch: pa.RecordBatch, buckets: int, low: int, high: int, blocks: int) -> list[tuple]:
    """128-bit names of open suffixes; starts that ask for an answer are given as complements."""
    ids, keys = (batch[c].to_numpy() for c in ("doc_id", "key"))
    runs = [np.frombuffer(x, np.int32).reshape(-1, 2).astype(np.int64) for x in batch["runs"].to_pylist()]
    sizes = [x[:, 1] - x[:, 0] for x in runs]
    asks = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(s.sum())) for x, s in zip(batch["asks"].to_pylist(), sizes, strict=True)]).astype(bool)
    doc = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    runs, sizes = np.concatenate(runs), np.concatenate(sizes)
    body = b"".join(batch["body"].to_pylist())
    offset = np.cumsum(sizes + LENGTH - 1) - (sizes + LENGTH - 1)
    # Runs longer than a window are cut; a run of m starts has m + LENGTH - 1 bytes.
    cut = -(-sizes // WINDOW)
    part = np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut)
    run = np.repeat(np.arange(len(runs)), cut)
    first, size = part * WINDOW, np.minimum(sizes[run] - part * WINDOW, WINDOW)
    where = offset[run] + first
    group = np.cumsum(size + LENGTH - 1) // WINDOW
    bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ones, twos, taken, base = [], [], [], 0
    for a, b in zip(bounds, [*bounds[1:], len(run)], strict=True):
        raw = np.frombuffer(b"".join([body[w : w + m + LENGTH - 1] for w, m in zip(where[a:b].tolist(), size[a:b].tolist(), strict=True)]), np.uint8)
        own = size[a:b]
        at = np.arange(int(own.sum())) + np.repeat(np.arange(b - a) * (LENGTH - 1), own)
        one = _NAMES[0].at(_NAMES[0].sums(raw), at, LENGTH)
        x = chosen(one, buckets, low, high)
        ones.append(one[x])
        twos.append(_NAMES[1].at(_NAMES[1].sums(raw), at[x], LENGTH) | np.uint64(1))
        taken.append(base + x)
        base += len(one)
    x = np.concatenate(taken)
    run = np.searchsorted(np.cumsum(sizes), x, "right")  # the run each of them is in
    at = x - (np.cumsum(sizes) - sizes)[run] + runs[run, 0]
    doc, asks, one, two = doc[run], asks[x], np.concatenate(ones), np.concatenate(twos)
    _, tied, x = runs_of(one, two)
    own = by_block(ids, keys, doc[tied & asks], ~at[tied & asks], blocks)
    at = np.where(asks & ~tied, ~at, at)
    return [*known(own, high - low), *dealt([one[x], two[x]], ids, keys, doc[x], at[x], buckets, low, high)]


def spans(n: int, at: np.ndarray) -> np.ndarray:
    """Maximal removed runs (start, end) from all positions found: repeats' starts are below 0."""
    start = ~at[at < 0]
    if not len(start):
        return np.zeros((0, 2), np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered(n, start), [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def in_buckets(rows: DataFrame, fn: Callable, stash: Stash, name: str, partitions: int, blocks: int, passes: int, sampled: bool) -> list[DataFrame]:
    """Names by ``fn(batch, buckets, low, high, blocks)``, dealt and sorted in so many passes."""
    found = []
    for k in range(passes):

        def run(batches: Iterator[pa.RecordBatch], low=k * partitions) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = fn(batch, passes * partitions, low, low + partitions, blocks) if batch.num_rows else []
                for at in range(0, len(out), 256):
                    yield batch_of(out[at : at + 256], NAMED, NAMED_KINDS)

        found.append(stash.put(f"{name}{k}", sort_buckets(rows.mapInArrow(run, NAMED_SCHEMA), partitions, blocks, sampled)))
        release(stash)
    return found


def find_repeats(docs: DataFrame, stash: Stash) -> tuple[list[DataFrame], DataFrame, int, int]:
    """Positions that start repeats (complements, below 0), the keyed documents, partitions and blocks."""
    spark = docs.sparkSession
    bounded_batches(spark)
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-estimate // PARTITION_BYTES)))
    blocks = partitions * BLOCKS
    rows = keyed(docs, blocks)
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0  # plans don't always know their size
    passes = -(-total // (partitions * BUCKET_BYTES))

    def names(batch: pa.RecordBatch, buckets: int, low: int, high: int, blocks: int) -> list[tuple]:
        ids = np.array([-1 if x is None else x for x in batch["doc_id"].to_pylist()], np.int64)
        return sample_names(ids, batch["key"].to_numpy(), batch["body"].to_pylist(), buckets, low, high, blocks)

    found = in_buckets(rows.select("doc_id", "key", "body"), names, stash, "sample", partitions, blocks, max(passes, SAMPLE_PASSES), True)
    left = stash.put("open", with_positions(rows, found, partitions, blocks, open_suffixes, OPEN, [pa.int64(), pa.int64(), *[pa.binary()] * 3], OPEN_SCHEMA))
    release(stash)
    found += in_buckets(left, suffix_names, stash, "suffix", partitions, blocks, max(passes, SUFFIX_PASSES), False)
    stash.drop("open")
    return found, rows, partitions, blocks


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found, rows, partitions, blocks = find_repeats(docs, Stash(docs.sparkSession))

    def run(todo: list[tuple]) -> list[tuple]:
        out = []
        for doc, _, text, at in todo:
            runs = spans(len(text), at).tolist()
            out.append((doc, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(text, runs)).hexdigest()))
        return out

    return with_positions(rows, found, partitions, blocks, run, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without(text: bytes, runs: list[list[int]]) -> bytes:
    if not runs:
        return text
    out, last = [], 0
    for a, b in runs:
        out.append(text[last:a])
        last = b
    return b"".join([*out, text[last:]])


def dedup_text(docs: DataFrame, stash: Stash | None = None) -> DataFrame:
    """The documents without repeated bytes; a character that is cut goes whole. Column order stays."""
    found, rows, partitions, blocks = find_repeats(docs, stash or Stash(docs.sparkSession))
    others = [c for c in docs.columns if c != "text"]
    extra = F.struct(F.col("text").isNull().alias("none"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    key = F.xxhash64("doc_id", "text")
    text = F.coalesce("text", F.lit("")).cast("binary")
    body = docs.select("doc_id", key.alias("key"), F.pmod(key, F.lit(blocks)).cast("int").alias("block"), text.alias("body"), extra.alias("extra"))

    def run(todo: list[tuple]) -> list[tuple]:
        return [(without(text, spans(len(text), at).tolist()).decode("utf-8", "ignore"),) for _, _, text, at in todo]

    out = with_positions(body, found, partitions, blocks, run, ["text"], [pa.string()], "text string")
    left = F.when(~F.col("extra.none"), F.col("text")).alias("text")
    return out.select(*[left if c == "text" else F.col(f"extra.rest.`{c}`").alias(c) for c in docs.columns])
