"""The nearest vectors of many questions: every pair is compared by matrix products, and what may be among the
best is scored again as ``functions.vectors.cosine`` does, in index order, so that scores and ties are the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a product: questions and contexts.
TILE, SLICE = 1024, 2048
#: How scores sort, best first: NaN above all numbers, null below.
NAN, NUMBER, NULL, NONE = range(4)


class Vectors:
    """Vectors of an Arrow list column as rows of a matrix, padded with zeros, with their norms.

    ``null``: a null, as vector or in it, makes every score null. ``odd``: those, and rows whose norm isn't a number
    or is near the ends of the doubles: products tell nothing about them, so all their pairs are scored."""

    def __init__(self, column: pa.ListArray):
        n = len(column)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().cast(pa.float64())
        missing = values.is_null().to_numpy(zero_copy_only=False)
        flat = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
        self.null = column.is_null().to_numpy(zero_copy_only=False).copy()
        np.logical_or.at(self.null, np.repeat(np.arange(n), lengths)[missing], True)
        width = int(lengths.max(initial=0))
        if (lengths == width).all():
            self.rows = flat.reshape(n, width)
        else:
            self.rows = np.zeros((n, width))
            self.rows[np.arange(width) < lengths[:, None]] = flat
        total = np.zeros(n)
        with np.errstate(all="ignore"):
            for j in range(width):
                total += self.rows[:, j] * self.rows[:, j]
            self.norm = np.sqrt(total)
            self.odd = self.null | ~((self.norm == 0) | (self.norm > 1e-140) & (self.norm < 1e140))
            self.unit = (self.rows / np.where(self.odd | (self.norm == 0), np.inf, self.norm)[:, None]).astype(np.float32)
            self.unit[self.odd] = 0

    def widen(self, width: int) -> None:
        more = ((0, 0), (0, max(0, width - self.rows.shape[1])))
        self.rows, self.unit = np.pad(self.rows, more), np.pad(self.unit, more)

    def firsts(self, at: slice, k: int) -> np.ndarray:
        """Rows of a slice without those that k rows before them equal: they can't be among k best."""
        rows = np.ascontiguousarray(np.column_stack([self.null[at], np.where(self.null[at, None], 0.0, self.rows[at])]))
        _, group = np.unique(rows.view(np.dtype((np.void, rows.strides[0]))).ravel(), return_inverse=True)
        order = np.argsort(group, kind="stable")
        return at.start + np.sort(order[_ranks(group[order]) < k])


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Place of each element in its group, from 0; groups are sorted."""
    at = np.arange(len(groups))
    new = np.r_[True, groups[1:] != groups[:-1]][: len(groups)]
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _scores(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of pairs, summed in index order, and how it sorts."""
    dot = np.zeros(len(i))
    with np.errstate(all="ignore"):
        for d in range(a.rows.shape[1]):
            dot += a.rows[i, d] * b.rows[j, d]
        size = a.norm[i] * b.norm[j]
        score = np.where(size == 0, 0.0, dot / size)
    return score, np.where(a.null[i] | b.null[j], NULL, np.where(np.isnan(score), NAN, NUMBER))


class Best:
    """The k best contexts of each question so far; contexts come in the order that ties are broken in."""

    def __init__(self, questions: Vectors, k: int):
        self.q, self.k, n = questions, k, len(questions.norm)
        self.score, self.kind, self.place = np.zeros((n, k)), np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, c: Vectors, start: int) -> None:
        """Contexts whose places begin at ``start``."""
        width = max(c.rows.shape[1], self.q.rows.shape[1])
        c.widen(width)
        self.q.widen(width)
        for at in range(0, len(c.norm), SLICE):
            kept = c.firsts(slice(at, min(at + SLICE, len(c.norm))), self.k)
            units = c.unit[kept]
            for first in range(0, len(self.q.norm), TILE):
                self._tile(slice(first, min(first + TILE, len(self.q.norm))), c, kept, units, start)

    def _tile(self, tile: slice, c: Vectors, kept: np.ndarray, units: np.ndarray, start: int) -> None:
        near, odd = self.q.unit[tile] @ units.T, c.odd[kept]
        off = np.float32((self.q.unit.shape[1] + 8) * 2.0**-22)  # over twice what single precision can be off by
        if odd.any():
            near[:, odd] = -np.inf
        kind, last = self.kind[tile, -1], self.score[tile, -1]
        least = np.select([kind == NAN, kind == NUMBER], [np.inf, last], -np.inf).astype(np.float32) - off
        if len(kept) >= self.k and (open_ := np.flatnonzero(least == -np.inf)).size:
            least[open_] = np.partition(near[open_], len(kept) - self.k, axis=1)[:, len(kept) - self.k] - 2 * off
        may = near >= least[:, None]
        if odd.any():
            may[:, odd] = True
        may[self.q.odd[tile]] = True
        some = np.flatnonzero(may.any(axis=1))  # few, once the best are near
        if some.size:
            i, j = np.divmod(np.flatnonzero(may[some]), len(kept))
            self._merge(some[i] + tile.start, c, kept[j], start)

    def _merge(self, i: np.ndarray, c: Vectors, j: np.ndarray, start: int) -> None:
        score, kind = _scores(self.q, i, c, j)
        known = np.unique(i)
        of = np.concatenate([np.repeat(known, self.k), i])
        score = np.concatenate([self.score[known].ravel(), score])
        kind = np.concatenate([self.kind[known].ravel(), kind])
        place = np.concatenate([self.place[known].ravel(), j + start])
        order = np.lexsort((place, np.where(kind == NUMBER, -score, 0.0), kind, of))
        order = order[_ranks(of[order]) < self.k]
        self.score[known], self.kind[known], self.place[known] = (x[order].reshape(-1, self.k) for x in (score, kind, place))


def nearest(questions: DataFrame, contexts: DataFrame, k: int) -> DataFrame:
    """Of each task's contexts (context_id, embedding) the k most similar to each question (question_id,
    question_vector), with their scores; at equal scores the smaller context_id. Questions go to all tasks."""
    spark = contexts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    asked = questions.select("question_id", F.col("question_vector").cast("array<double>")).toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast(asked)
    rows = contexts.select("context_id", F.col("embedding").cast("array<double>").alias("embedding")).sortWithinPartitions("context_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = (_one(x) for x in sent.value.columns)
        best, ids, seen = Best(Vectors(vectors), k), [], 0
        for batch in batches:
            if batch.num_rows and len(names):
                best.add(Vectors(batch.column(1)), seen)
                ids.append(batch.column(0))
                seen += batch.num_rows
        i, r = np.nonzero(best.kind != NONE)
        if len(i):
            found = [names.take(pa.array(i)), pa.concat_arrays(ids).take(pa.array(best.place[i, r])), pa.array(best.score[i, r], mask=best.kind[i, r] == NULL)]
            yield pa.RecordBatch.from_arrays(found, ["question_id", "context_id", "score"])

    fields = [T.StructField("question_id", questions.schema["question_id"].dataType), T.StructField("context_id", contexts.schema["context_id"].dataType), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType(fields))


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
