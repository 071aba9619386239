"""Quality rules: base counts of each text and robust multivariate outliers, with DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated 3-word windows. Documents that
pass them become vectors of four transformed rates. For each language and source, and for each
language as a whole, the minimum covariance determinant is sought by concentration steps: keep the
share ``KEEP`` of rows with the smallest Mahalanobis distance under the current estimate, take mean
and covariance of those, repeat until no determinant falls any more. Three starts (median with MAD, the
half of the rows nearest to the median by the largest of its rates' distances, and all rows) run side
by side and the one with the smallest determinant wins. The scatter of a kept share is multiplied by
the factor that makes it consistent for normal rows. Covariances carry a floor on the diagonal, since
rates that are zero in most documents would make them singular. A document is rejected if its squared
distance under its group's estimate exceeds ``CUTOFF``, the chi-square quantile of an error rate of
``ERROR``; groups of fewer than ``LEAST`` rows use their language's.

All statistics cover all documents and each step is one aggregation with partial sums, so neither a
hot source nor a large group meets in one task. Thresholds of the steps are quantile sketches
(``percentile_approx``).

Equal windows are found by sorting 64-bit hashes that carry the window's place in their lower bits.
Neighbours that agree in the hash are then compared word by word; a text in which two different
windows agree is counted again from the windows' words themselves, so the counts are exact.

Cases: null or empty text has no words and fails the base rules; null language or source is a group
of its own; repeated rows count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import Stash

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WORDS_LEAST, REPEAT_PERCENT = 50, 50
#: Bits of the windows' hashes that go unused (tests make hashes clash by it).
UNUSED = 0
#: Share of rows in the concentration steps, their number at most, the fall of a log determinant that is worth
#: another step, and rows that a group needs of its own.
KEEP, STEPS, FALL, LEAST = 0.75, 12, 1e-3, 50
#: Least standard deviation of each rate: log word length, root of symbols a word, of repeated lines
#: a line, of repeated words a word.
FLOORS = (0.06, 0.12, 0.15, 0.15)
P = len(FLOORS)


def chi2_share(x: float, halves: int) -> float:
    """Share of a chi-square distribution of 2 x ``halves`` degrees of freedom below x."""
    return 1 - exp(-x / 2) * sum((x / 2) ** k / factorial(k) for k in range(halves))


def chi2_quantile(share: float, halves: int = P // 2) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_share(middle, halves) < share else (low, middle)
    return high


#: Rejected share of a normal group, and the squared Mahalanobis distance that cuts it off.
ERROR = 1e-4
CUTOFF = chi2_quantile(1 - ERROR)
#: Scatter of normal rows over that of their kept share.
CONSISTENCY = KEEP / chi2_share(chi2_quantile(KEEP), P // 2 + 1)


def base_counts(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` that the method needs and the base counts."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    first = docs.select("doc_id", "lang", "source", text.alias("t"), words.alias("w"), lines.alias("l"))
    first = first.select("doc_id", "lang", "source", "w", F.size("w").alias("n"), F.char_length(F.translate("t", BLANK, "")).cast("long").alias("word_chars"), (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"), F.size("l").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"))
    # Each window as one number: its hash above, its place in the lower bits. Sorting brings equal windows together.
    first = first.withColumn("bits", (F.ceil(F.log2(F.col("n") + 2)) + UNUSED).cast("int"))
    windows = "CASE WHEN n >= 3 THEN sort_array(transform(sequence(0, n - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), bits) | CAST(i AS BIGINT))) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    hash_, place = (lambda x: f"shiftright({x}, bits)"), (lambda x: f"CAST({x} & (shiftleft(1L, bits) - 1) AS INT)")
    beside = f"(k > 0 AND {hash_('s[greatest(k - 1, 0)]')} = {hash_('x')}) OR (k < size(s) - 1 AND {hash_('s[least(k + 1, size(s) - 1)]')} = {hash_('x')})"
    twice = f"transform(array(s), s -> filter(s, (x, k) -> {beside}))[0]"
    other = " OR ".join(f"w[{place('d[k]')} + {j}] <> w[{place('d[k - 1]')} + {j}]" for j in range(3))
    clash = f"size(d) > 1 AND exists(sequence(1, size(d) - 1), k -> {hash_('d[k]')} = {hash_('d[k - 1]')} AND ({other}))"
    # The windows' words (none has white space inside) and place, for texts with a clash.
    spelled = "sort_array(transform(sequence(0, n - 3), i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS s, i AS i)))"
    again = "filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].s = x.s) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].s = x.s))"
    exact = f"sort_array(transform(array({spelled}), s -> transform({again}, x -> CAST(x.i AS BIGINT)))[0])"
    at = f"CASE WHEN {clash} THEN {exact} ELSE sort_array(transform(d, x -> CAST({place('x')} AS BIGINT))) END"
    covered = "aggregate(p, struct(0L AS n, -3L AS last), (a, x) -> struct(a.n + least(3L, x - a.last) AS n, x AS last), a -> a.n)"
    first = first.withColumn("s", F.expr(windows)).withColumn("d", F.expr(twice)).drop("s").withColumn("p", F.expr(at)).drop("w", "d").withColumn("n_repeat_words", F.expr(covered))
    return first.select("doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("n_lines").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < WORDS_LEAST) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rates() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]


def cholesky(moments: DataFrame) -> DataFrame:
    """Means m_i, rows of the Cholesky factor c_i_j and log determinant from means and covariances v_i_j."""
    out = moments
    for i in range(P):
        for j in range(i + 1):
            part = F.col(f"v_{i}_{j}") - sum((F.col(f"c_{i}_{k}") * F.col(f"c_{j}_{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"c_{i}_{j}", F.sqrt(F.greatest(part, F.lit(FLOORS[i] ** 2 / 4))) if i == j else part / F.col(f"c_{j}_{j}"))
    return out.withColumn("logdet", sum((F.log(f"c_{i}_{i}") for i in range(P)), F.lit(0.0)))


def distance() -> Column:
    """Squared Mahalanobis distance of z_0.. under m_i and c_i_j: forward substitution."""
    y: list[Column] = []
    for i in range(P):
        y.append((F.col(f"z_{i}") - F.col(f"m_{i}") - sum((F.col(f"c_{i}_{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"c_{i}_{i}"))
    return sum((x * x for x in y), F.lit(0.0))


PARAMETERS = [*[f"m_{i}" for i in range(P)], *[f"c_{i}_{j}" for i in range(P) for j in range(i + 1)], "logdet", "n"]


def moments(rows: DataFrame, *by: str, factor: float = 1.0) -> DataFrame:
    """Estimates from rows; their covariance is multiplied by ``factor``."""
    means = [F.avg(f"z_{i}").alias(f"m_{i}") for i in range(P)]
    products = [F.avg(F.col(f"z_{i}") * F.col(f"z_{j}")).alias(f"q_{i}_{j}") for i in range(P) for j in range(i + 1)]
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), *means, *products)
    for i in range(P):
        for j in range(i + 1):
            found = found.withColumn(f"v_{i}_{j}", factor * (F.col(f"q_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) + F.lit(FLOORS[i] ** 2 if i == j else 0.0))
    return cholesky(found).select(*by, *PARAMETERS)


def estimates(rows: DataFrame, stash: Stash) -> DataFrame:
    """Location and scatter of each group (lang, source, pooled): the smallest determinant of three starts."""
    groups = ["lang_", "source_", "pooled"]
    keyed = rows.select(*[f"z_{i}" for i in range(P)], F.explode(F.array(F.struct(F.col("lang").alias("lang_"), F.col("source").alias("source_"), F.lit(False).alias("pooled")), F.struct(F.col("lang").alias("lang_"), F.lit(None).cast("string").alias("source_"), F.lit(True).alias("pooled")))).alias("g")).select("*", "g.*").drop("g")
    same = lambda a, b: F.col(f"{a}.lang_").eqNullSafe(F.col(f"{b}.lang_")) & F.col(f"{a}.source_").eqNullSafe(F.col(f"{b}.source_")) & (F.col(f"{a}.pooled") == F.col(f"{b}.pooled"))
    middle = keyed.groupBy(*groups).agg(F.count("*").alias("n"), *[F.percentile_approx(f"z_{i}", [0.25, 0.5, 0.75], 1000).alias(f"t_{i}") for i in range(P)])
    for i in range(P):
        middle = middle.withColumn(f"m_{i}", F.col(f"t_{i}")[1])
        for j in range(i + 1):  # quartile range / 1.349: the standard deviation of a normal sample
            middle = middle.withColumn(f"v_{i}_{j}", F.pow((F.col(f"t_{i}")[2] - F.col(f"t_{i}")[0]) / 1.349, F.lit(2.0)) + F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
    robust = cholesky(middle).select(*groups, *PARAMETERS)
    # The half nearest to the median: by the largest of the rates' distances in quartile ranges.
    off = F.greatest(*[F.abs(F.col(f"z_{i}") - F.col(f"m_{i}")) / F.col(f"c_{i}_{i}") for i in range(P)])
    near = keyed.alias("r").join(robust.alias("e"), same("r", "e")).select(*[f"r.{c}" for c in groups], *[f"z_{i}" for i in range(P)], off.alias("off"))
    middle_off = near.groupBy(*groups).agg(F.percentile_approx("off", 0.5, 1000).alias("bound"))
    half = near.alias("a").join(middle_off.alias("b"), same("a", "b")).where("off <= bound").select(*[f"a.{c}" for c in groups], *[f"z_{i}" for i in range(P)])
    starts = [robust, moments(half, *groups), moments(keyed, *groups)]
    now = reduce(DataFrame.unionByName, [x.withColumn("start", F.lit(k)) for k, x in enumerate(starts)])
    now = stash.put("step0", now)
    for k in range(1, STEPS + 1):
        far = keyed.alias("r").join(now.alias("e"), same("r", "e")).select(*[f"r.{c}" for c in groups], "e.start", *[f"z_{i}" for i in range(P)], distance().alias("d2"))
        bound = far.groupBy(*groups, "start").agg(F.percentile_approx("d2", KEEP, 1000).alias("bound"))
        inner = far.alias("a").join(bound.alias("b"), same("a", "b") & (F.col("a.start") == F.col("b.start"))).where("d2 <= bound").select(*[f"a.{c}" for c in groups], "a.start", *[f"z_{i}" for i in range(P)])
        old, now = now, stash.put(f"step{k}", moments(inner, *groups, "start", factor=CONSISTENCY))
        fall = old.alias("a").join(now.alias("b"), same("a", "b") & (F.col("a.start") == F.col("b.start"))).agg(F.max(F.col("a.logdet") - F.col("b.logdet"))).first()[0]
        if k > 1 and (fall is None or fall < FALL):  # the starts aren't covariances of a kept share
            break
    best = now.groupBy(*groups).agg(F.min_by(F.struct(*PARAMETERS), F.struct("logdet", "start")).alias("best"))
    return best.select(*groups, "best.*")


def judge(docs: DataFrame, stash: Stash | None = None) -> DataFrame:
    """Base counts, base_failed, distance (null where the base rules fail) and kept of each document."""
    stash = stash or Stash(docs.sparkSession)
    rows = base_counts(docs).withColumn("base_failed", base_failed())
    rows = stash.put("counts", rows.select("*", *[x.alias(f"z_{i}") for i, x in enumerate(rates())]))
    found = estimates(rows.where(~F.col("base_failed")), stash)
    own = found.where("NOT pooled").select(F.col("lang_").alias("lang1"), F.col("source_").alias("source1"), F.struct(*PARAMETERS).alias("own"))
    pooled = found.where("pooled").select(F.col("lang_").alias("lang2"), F.struct(*PARAMETERS).alias("pool"))
    both = rows.join(own, F.col("lang").eqNullSafe(F.col("lang1")) & F.col("source").eqNullSafe(F.col("source1")), "left").join(pooled, F.col("lang").eqNullSafe(F.col("lang2")), "left")
    # The kept share of a group's rows is what its estimate counts.
    use = F.when(F.col("own.n") >= LEAST * KEEP, F.col("own")).otherwise(F.col("pool"))
    far = both.withColumn("use", use).select(*rows.columns, "use.*").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    return far.select(*[c for c in rows.columns if not c.startswith("z_")], "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text", "lang", "source")).drop("lang", "source", "n_lines")
