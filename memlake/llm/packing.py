"""Vector best-fit packing of tokenised documents into sequences.

Every document becomes its ids and a closing id; only documents longer than a sequence are cut,
into full pieces and a shorter last one. A piece asks for a vector of three things: tokens, one
place, and attention cost (its length squared). A sequence has a capacity in each: ``SEQUENCE`` tokens,
``documents`` places and ``attention`` cost. By default the last two are as large as tokens can ask
for (one place a token, the square of the tokens), so that only tokens limit a sequence and there are
as few as can be; smaller ones bind, for instance to bound the documents of a sequence. The attention
capacity has to hold a full piece. Pieces come longest first; a piece goes to the open sequence that can take it in every dimension and has the
best score: the smallest weighted norm of what is left (``norm``), or the largest weighted
dot-product of the piece with what is left (``dot``). If none can, a new sequence opens.

Pieces are dealt by a hash of document and piece in one exchange of thin rows, and a task packs
them in groups of ``GROUP`` as they stream by. A group's few unfilled sequences are all the waste,
so memory is bounded and the count is within about one sequence a group of packing all at once.

Cases: null text is empty and gives the closing id alone; repeated rows are packed once each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.bpe import kept, word_encoder
from memlake.llm.common import bounded_batches, map_batches

SEQUENCE, CLOSING = 2048, 0
#: Pieces packed together; the work for a group grows with its square.
GROUP = 8192
#: Weights of tokens, places and attention cost in the score.
WEIGHTS = (1.0, 0.05, 0.05)


def pieces(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, closing = kept(word_encoder, tokenizer_path), np.array([CLOSING], "<u4").tobytes()
        cols: list[list] = [[], [], [], [], [], []]
        for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_texts(batch["text"].to_pylist()), strict=True):
            ids += closing
            for k, at in enumerate(range(0, len(ids), 4 * SEQUENCE)):
                part = ids[at : at + 4 * SEQUENCE]
                for col, x in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                    col.append(x)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[: 5 + keep_ids], types, strict=False)], names[: 5 + keep_ids])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def vector_best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the order given."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((len(lengths), 3))
    full, w = np.array(capacity, float), np.array(weights)
    unit = w / full**2
    base, n = 0, 0  # sequences below base can take no piece any more
    shortest = int(lengths.min()) if len(lengths) else 0
    for at, i in enumerate(order):
        size = int(lengths[i])
        need = np.array((size, 1, size * size), float)
        to = -1
        if n > base and size < capacity[0]:
            room = left[base:n] - need
            fits = room.min(axis=1) >= 0
            if fits.any():
                score = (room * room) @ unit if rule == "norm" else -((left[base:n] * need) @ unit)
                to = base + int(np.where(fits, score, np.inf).argmin())
        if to < 0:
            left[n] = full
            to, n = n, n + 1
        bins[i], offsets[i] = to, capacity[0] - left[to, 0]
        left[to] -= need
        if at % 256 == 255 or size == capacity[0]:
            while base < n and (left[base, 0] < shortest or left[base, 1] < 1):
                base += 1
    return bins, offsets


def pack(found: DataFrame, documents: int = SEQUENCE, attention: int = SEQUENCE**2, rule: str = "norm") -> DataFrame:
    """Give each piece its sequence_id and its offset there."""
    if documents < 1 or attention < SEQUENCE**2:
        raise ValueError("a sequence has to hold a full piece")
    if rule not in ("norm", "dot"):
        raise ValueError("the rule is norm or dot")
    capacity = SEQUENCE, documents, attention
    bounded_batches(found.sparkSession)
    dealt = found.withColumn("_h", F.xxhash64("doc_id", "piece")).repartition("_h").sortWithinPartitions("_h", "doc_id", "piece", "start").drop("_h")
    schema = pa.schema([*[(f.name, {"long": pa.int64(), "integer": pa.int32(), "binary": pa.binary()}[f.dataType.typeName()]) for f in found.schema], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n = TaskContext.get().partitionId() << 40, [], 0

        def done(table: pa.Table) -> pa.RecordBatch:
            nonlocal first
            bins, offsets = vector_best_fit(table["length"].to_numpy(), capacity, rule=rule)
            out = table.append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))
            first += int(bins.max()) + 1
            return out.cast(schema).combine_chunks().to_batches()[0]

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= GROUP:
                yield done(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield done(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False, **limits) -> DataFrame:
    """Tokenise whole documents, cut those over a sequence, pack all pieces (``limits`` as ``pack`` takes them)."""
    return pack(pieces(docs, tokenizer_path, keep_ids), **limits)
