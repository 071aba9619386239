"""Quality classifier by hierarchical empirical Bayes.

1. Evidence: for quality and for toxicity a sparse logistic model (L1, accelerated proximal gradient) over
   word presence and shape rates, fitted on at most ``SAMPLE`` labelled documents that hold at most
   ``SAMPLE_WORDS`` words in all (those with the smallest hash of their id; equal texts count once).
   Every document gets both probabilities.
2. Hosts and paths: the probabilities are summed per host (``source`` here) and per path within it
   (``lang`` here). The spread of host rates beyond what their sizes explain gives, by moments, the
   strength of the global prior; a host's posterior mean shrinks its rate toward the global one, a
   path's posterior mean shrinks its own toward its host's. Sparse sites stay near their parents.
3. A document's own likelihood ratio is combined with the prior odds of its path, its own share taken
   out of the path's sums. A document is kept if its quality is at least ``QUALITY_LEAST`` likely and its
   toxicity at most ``TOXIC_MOST``.

Sums are grouped aggregations with partial sums, so a hot host is a few numbers a task.

Cases: null or empty text has no words; null host or path is a site of its own; without labels of both
kinds a model says the labelled rate (0.5 without labels, 0 for toxicity) for all; repeated rows
count each; an empty table gives no rows; other columns are not read by ``judge``.
"""

from __future__ import annotations

from collections import Counter
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import Stash, map_batches, utf8
from memlake.llm.simhash import LOWERED

#: Labelled documents that the models are fitted on, at most, and their distinct words in all (what the driver
#: gets is bounded by both: 4 bytes a word); words count if LEAST of the documents hold one.
SAMPLE, SAMPLE_WORDS, LEAST = 12_000, 8_000_000, 4
BITS, SEED = 18, 7
#: L1 penalty, on the mean loss and on weights of words scaled to unit mean square; steps of the fit.
PENALTY, STEPS = 1e-3, 160
#: Least posterior of quality and most of toxicity that a kept document has.
QUALITY_LEAST, TOXIC_MOST = 0.5, 0.25
SHAPES = 8
#: ASCII letters (lower-cased) and all bytes beyond ASCII make words here.
LETTERS = bytes(LOWERED[b] if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))
SYMBOLS = b"#*$%&|<>"
TASKS = ("quality", "toxic")


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words present, and shape rates."""
    words = {xxhash.xxh32_intdigest(w, SEED) >> (32 - BITS) for w in text.translate(LETTERS).split()}
    tokens = text.split()
    n = max(len(tokens), 1)
    counts = Counter(tokens)
    top = max(counts.values(), default=0)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    upper = sum(1 for w in counts if len(w) > 2 and w.isupper())
    shapes = (np.log1p(len(tokens)), len(text) / n / 10, min(symbols / n, 4.0), top / n, len(counts) / n, float(top / n > 0.25), float(symbols / n > 0.25), min(upper / n, 1.0))
    return np.fromiter(words, np.int32, len(words)), np.array(shapes, np.float32)


class Model:
    """Sparse weights of words and of shape rates; logits of a document's features."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, shapes: np.ndarray, middle: np.ndarray, scale: np.ndarray, bias: float):
        self.words, self.weights, self.shapes, self.middle, self.scale, self.bias = words, weights, shapes, middle, scale, bias
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def logit(self, words: np.ndarray, shapes: np.ndarray) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.words] = self.weights
        return float(self._dense[words].sum() + ((shapes - self.middle) / self.scale) @ self.shapes + self.bias)


def fit(words: list[np.ndarray], shapes: np.ndarray, labels: np.ndarray, default: float) -> Model:
    """L1-penalised logistic regression; words that occur in fewer than LEAST documents are left out."""
    nothing = np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(SHAPES, np.float32), np.zeros(SHAPES, np.float32), np.ones(SHAPES, np.float32)
    if len(labels) < 20 or labels.min() == labels.max():
        rate = np.clip(labels.mean() if len(labels) else default, 0.01, 0.99)
        return Model(*nothing, float(np.log(rate / (1 - rate))))
    flat = np.concatenate(words)
    holders = np.bincount(flat, minlength=1 << BITS)
    used = np.flatnonzero(holders >= LEAST)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    row, col = np.repeat(np.arange(len(words)), [len(w) for w in words]), place[flat]
    row, col = row[col >= 0], col[col >= 0]
    # Unit mean square brings rare words and common ones to one scale, for the steps and for the penalty.
    unit = np.sqrt(len(labels) / holders[used])
    value = unit[col]
    middle, scale = shapes.mean(axis=0), shapes.std(axis=0) + 1e-3
    x = (shapes - middle) / scale
    n, m = len(labels), len(used)
    w, v, bias = np.zeros(m), np.zeros(SHAPES), float(np.log(labels.mean() / (1 - labels.mean())))
    ahead, seen = (w, v, bias), 1.0
    # A bound of the curvature by power iteration on the design.
    probe = np.ones(m) / max(m, 1) ** 0.5
    for _ in range(12):
        probe = np.bincount(col, value * np.bincount(row, value * probe[col], n)[row], m)
        size = np.linalg.norm(probe)
        probe /= max(size, 1e-12)
    step = 4 * n / (size + np.linalg.norm(x, 2) ** 2 + n)
    for _ in range(STEPS):
        a, b, c = ahead
        gap = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * a[col], n) + x @ b + c, -30, 30))) - labels
        new_w = a - step * np.bincount(col, value * gap[row], m) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * PENALTY, 0)
        new_v, new_bias = b - step * x.T @ gap / n, c - step * gap.mean()
        after = (1 + np.sqrt(1 + 4 * seen * seen)) / 2
        pace, seen = (seen - 1) / after, after
        ahead = new_w + pace * (new_w - w), new_v + pace * (new_v - v), new_bias + pace * (new_bias - bias)
        w, v, bias = new_w, new_v, new_bias
    own = np.flatnonzero(w)
    return Model(used[own].astype(np.int32), (w * unit)[own].astype(np.float32), v.astype(np.float32), middle, scale, float(bias))


def train(docs: DataFrame, labels: DataFrame, stash: Stash) -> list[Model]:
    """Models of quality and toxicity from a bounded sample of labelled documents."""
    chosen = labels.where("doc_id IS NOT NULL").select("doc_id", *TASKS).orderBy(F.xxhash64("doc_id"), "doc_id", *TASKS).limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *TASKS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in utf8(batch["text"])]
        parts = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([batch["doc_id"], *parts, *[batch[t] for t in TASKS]], ["doc_id", "words", "shapes", *TASKS])

    names = {f.name: f.dataType.simpleString() for f in labels.schema}
    kinds = f"doc_id long, words binary, shapes binary, {', '.join(f'{t} {names[t]}' for t in TASKS)}"
    # Equal texts count once (with the least labels), so a document that is repeated weighs no more.
    first = F.min(F.struct(F.xxhash64("doc_id").alias("place"), "doc_id", *TASKS)).alias("x")
    each = stash.put("sampled", map_batches(rows, run, kinds).groupBy("words", "shapes").agg(first).select("words", "shapes", "x.*"))
    key = F.xxhash64("words", "shapes").alias("key")
    thin = each.select("place", "doc_id", key, (F.length("words") / 4).alias("n")).orderBy("place", "doc_id", "key").limit(SAMPLE)
    upto = F.sum("n").over(Window.orderBy("place", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0))  # SAMPLE rows at most
    taken = thin.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_WORDS).select("doc_id", "key")
    found = each.withColumn("key", key).join(F.broadcast(taken), ["doc_id", "key"]).orderBy("place", "doc_id", "key").collect()
    stash.drop("sampled")
    words, shapes = [np.frombuffer(r.words, np.int32) for r in found], np.array([np.frombuffer(r.shapes, np.float32) for r in found]).reshape(-1, SHAPES)
    out = []
    for task, default in zip(TASKS, (0.5, 0.01), strict=True):
        own = [k for k, r in enumerate(found) if r[task] is not None]
        out.append(fit([words[k] for k in own], shapes[own], np.array([float(found[k][task]) for k in own]), default))
    return out


def evidence(docs: DataFrame, models: list[Model], host: str, path: str) -> DataFrame:
    """doc_id, version (hash of the text), host, path and both probabilities of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([[m.logit(*f) for m in models] for f in map(features, utf8(batch["text"]))])
        p = 1 / (1 + np.exp(-np.clip(found, -20, 20)))
        return pa.RecordBatch.from_arrays([*[batch[c] for c in ("doc_id", "version", "host", "path")], pa.array(p[:, 0]), pa.array(p[:, 1])], ["doc_id", "version", "host", "path", *TASKS])

    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    return map_batches(rows, run, "doc_id long, version long, host string, path string, quality double, toxic double")


def strength(sites: DataFrame, task: str) -> list[Column]:
    """Global rate and, by moments, how many documents the prior of a host's rate is worth (1 to 1000)."""
    n, rate = F.col("n"), F.col(f"s_{task}") / F.col("n")
    mean = F.sum(f"s_{task}") / F.sum(n)
    spread = F.sum(n * rate * rate) / F.sum(n) - mean * mean
    noise = mean * (1 - mean) * F.count("*") / F.sum(n)
    worth = mean * (1 - mean) / F.greatest(spread - noise, F.lit(1e-6)) - 1
    return [F.least(F.greatest(mean, F.lit(1e-4)), F.lit(1 - 1e-4)).alias(f"rate_{task}"), F.least(F.greatest(worth, F.lit(1.0)), F.lit(1000.0)).alias(f"worth_{task}")]


def posteriors(scores: DataFrame, stash: Stash) -> DataFrame:
    """Per path: its sums, and the global rates, strengths and host posterior means."""
    sums = [F.sum(t).alias(f"s_{t}") for t in TASKS]
    paths = stash.put("paths", scores.groupBy("host", "path").agg(F.count("*").alias("n"), *sums))
    hosts = stash.put("hosts", paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{t}").alias(f"s_{t}") for t in TASKS]))
    world = hosts.agg(*[x for t in TASKS for x in strength(hosts, t)])
    means = hosts.crossJoin(F.broadcast(world))  # one row
    for t in TASKS:
        means = means.withColumn(f"host_{t}", (F.col(f"s_{t}") + F.col(f"worth_{t}") * F.col(f"rate_{t}")) / (F.col("n") + F.col(f"worth_{t}")))
    means = means.select(F.col("host").alias("host_"), *[c for t in TASKS for c in (f"rate_{t}", f"worth_{t}", f"host_{t}")])
    return stash.put("priors", paths.join(means, F.col("host").eqNullSafe(F.col("host_"))).drop("host_"))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", stash: Stash | None = None) -> DataFrame:
    """doc_id, version, host, path, evidence and posterior of quality and toxicity, kept."""
    stash = stash or Stash(docs.sparkSession)
    scores = stash.put("evidence", evidence(docs, train(docs, labels, stash), host, path))
    priors = posteriors(scores, stash).withColumnsRenamed({"host": "host_", "path": "path_"})
    both = scores.join(priors, F.col("host").eqNullSafe(F.col("host_")) & F.col("path").eqNullSafe(F.col("path_")))
    for t in TASKS:
        own = (F.col(f"s_{t}") - F.col(t) + F.col(f"worth_{t}") * F.col(f"host_{t}")) / (F.col("n") - 1 + F.col(f"worth_{t}"))
        own = F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6))
        logit = lambda p: F.log(p / (1 - p))
        inside = F.least(F.greatest(F.col(t), F.lit(1e-9)), F.lit(1 - 1e-9))
        both = both.withColumn(f"posterior_{t}", 1 / (1 + F.exp(-(logit(inside) - logit(F.col(f"rate_{t}")) + logit(own)))))
    kept = (F.col("posterior_quality") >= QUALITY_LEAST) & (F.col("posterior_toxic") <= TOXIC_MOST)
    return both.select("doc_id", "version", "host", "path", F.col("quality").alias("evidence_quality"), F.col("toxic").alias("evidence_toxic"), "posterior_quality", "posterior_toxic", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that the classifier keeps, whole."""
    rejected = judge(docs, labels, host, path).where("NOT kept").select("doc_id", "version").distinct().withColumnsRenamed({"doc_id": "doc", "version": "of"})
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"))
    return rows.join(rejected, F.col("id").eqNullSafe(F.col("doc")) & (F.col("version") == F.col("of")), "left_anti").select("row.*")
