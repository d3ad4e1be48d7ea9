"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Every document gets a few signals. For each group of strata and rule a grid of cutoffs is tested on the labelled good
documents: a cutoff is admissible if it and all looser ones pass the exact binomial test of "this rule turns away more than
its part of ``alpha`` of the group's good documents". The order of a rule's tests is fixed, from the loosest cutoff down to
the first that fails, so they need no correction for their number; ``delta`` is divided over groups and rules only. The rules'
parts of ``alpha`` and ``delta`` follow the labelled bad documents that their tightest cutoffs turn away; good documents have
no say in that, so it costs nothing. Among the admissible cutoffs the one is taken that turns away most labelled bad
documents, less ``cost`` times the good ones. With probability ``1 - delta`` no group then loses more than ``alpha`` of its
good documents.

A stratum is a group of its own if its labels could certify its foremost rule, should that turn away no good document:
(1 - alpha) ** n <= delta / strata for one rule, n = 1,094 good documents of 4 strata. All other strata with labels are one
pooled group, to which the bound applies as a whole.

Defined cases: null or blank text has no words and fails the base rules; a null stratum is a stratum of its own; strata
without labels, or whose pooled group has too few, get no cutoff and lose nothing to the method; repeated ids are judged row by row (a repeated
label counts once: good only if all its rows say so); an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.llm.common import absent, row_mark
from tallyframe.session import written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
GRIDS = {
    "symbols": [4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1],
    "marks": [2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1],
    "dup_lines": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "repeats": [0.48, 0.45, 0.4, 0.35, 0.3, 0.27, 0.24, 0.21, 0.18, 0.15, 0.12, 0.1],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks"]
TERMS = 4096


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of ``COUNTS`` (long) for the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""))
    out = out.withColumn("_h", F.expr("CASE WHEN size(_words) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"))
    out = out.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS i))) END"))
    out = out.withColumn("_p", F.expr("sort_array(transform(filter(_s, (e, k) -> (k > 0 AND e.h = _s[k - 1].h) OR (k + 1 < size(_s) AND e.h = _s[k + 1].h)), e -> e.i))"))
    size = lambda c: F.size(c).cast("long")
    return out.select(
        *docs.columns, size("_words").alias("n_words"),
        (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (size("_lines") - size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.expr("CASE WHEN _s IS NULL THEN 0L ELSE aggregate(sequence(1, size(_p)), 0L, (n, k) -> n + CASE WHEN k = size(_p) THEN 3 ELSE least(3, _p[k] - _p[k - 1]) END) END").alias("n_repeat_words"),
        size("_lines").alias("n_lines"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_marks"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def signals() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {"symbols": F.col("n_symbols") / words, "marks": F.col("n_marks") / words,
            "dup_lines": F.col("n_dup_lines") / lines, "repeats": F.col("n_repeat_words") / words}


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by 8 so that it is exact to about 1e-12 for every n >= 0."""
    z = n + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    shift = F.lit(0.0)
    for k in range(1, 9):
        shift = shift + F.log(n + float(k))
    return series - shift


def binomial_tail(k: Column, n: Column, p: float | Column) -> Column:
    """P(X <= k) for X ~ Bin(n, p), for k below the mean: exact terms downwards from k; beyond ``TERMS`` of them the rest
    is bounded by its geometric series, so the value never errs downwards. 1 at or above the mean."""
    p = p if isinstance(p, Column) else F.lit(p)
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log(1 - p)
    step = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(k.cast("long"), F.lit(TERMS).cast("long"))), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
                       lambda a, j: F.struct((a["t"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("t"), (a["s"] + a["t"]).alias("s")))
    ratio = (k - TERMS) * (1 - p) / ((n - k + TERMS + 1) * p)
    rest = F.when(k > TERMS, step["t"] / (1 - ratio)).otherwise(F.lit(0.0))
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(first) * (step["s"] + rest))).otherwise(F.lit(1.0))


def calibrated(scored: DataFrame, stratum: str, good: str, alpha: float = 0.004, delta: float = 0.05, cost: float = 20.0,
               grids: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """The chosen cutoffs of each stratum, one row (stratum, one double column per rule; null = never reject) from labelled
    rows with signals named as the grids; ``good`` is boolean."""
    grids = grids or GRIDS
    cells = [(r, i, c) for r, grid in grids.items() for i, c in enumerate(sorted(grid, reverse=True))]
    over = lambda r, c, g: F.sum(F.when((F.col(r) > c) & (F.col(good) if g else ~F.col(good)), 1).otherwise(0))
    sums = scored.where(F.col(good).isNotNull()).groupBy(stratum).agg(
        F.sum(F.col(good).cast("double")).alias("_n"),
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("place"), F.lit(float(c)).alias("cutoff"), over(r, c, True).cast("double").alias("_k"),
                           over(r, c, False).cast("double").alias("bad")) for r, i, c in cells]).alias("cell"))
    sums = written(sums, "quality-sums")
    # the rules' shares of what their tightest cutoffs turn away; without labelled bad documents no cutoff gains anything
    tightest = [F.expr(f"aggregate(filter(cell, x -> x.rule = '{r}'), 0D, (s, x) -> greatest(s, x.bad))") for r in grids]
    foremost, total = (F.greatest(*tightest) if len(tightest) > 1 else tightest[0]), sum(tightest, F.lit(0.0))
    part = F.when(total > 0, foremost / F.greatest(total, F.lit(1.0))).otherwise(F.lit(1.0))
    alone = F.col("_n") * F.log(1 - alpha * part) <= F.log(part * delta / max(1, sums.count()))
    sums = sums.withColumn("_alone", alone).withColumn("_group", F.when(F.col("_alone"), F.col(stratum)))
    group = ["_alone", "_group"]
    tests = max(1, sums.select(*group).distinct().count())
    tried = sums.select(*group, "_n", F.explode("cell").alias("cell")).groupBy(*group, "cell.rule", "cell.place", "cell.cutoff").agg(
        F.sum("_n").alias("_n"), F.sum("cell._k").alias("_k"), F.sum("cell.bad").alias("bad"))
    tried = tried.withColumn("_most", F.max("bad").over(Window.partitionBy(*group, "rule")))
    tried = tried.withColumn("_all", F.sum(F.when(F.col("place") == 0, F.col("_most"))).over(Window.partitionBy(*group))).where("_most > 0")
    share = F.col("_most") / F.col("_all")
    passed = binomial_tail(F.col("_k"), F.col("_n"), alpha * share) <= share * delta / tests
    tried = tried.withColumn("_passed", passed).withColumn("_passed", F.min("_passed").over(Window.partitionBy(*group, "rule").orderBy("place")))
    gain = F.col("bad") - cost * F.col("_k")
    best = tried.groupBy(*group, "rule").agg(F.max(F.when(F.col("_passed") & (gain > 0), F.struct(gain.alias("gain"), F.col("cutoff")))).alias("best"))
    best = best.groupBy(*group).agg(*[F.max(F.when(F.col("rule") == r, F.col("best.cutoff"))).alias(f"cut_{r}") for r in grids])
    same = sums["_alone"].eqNullSafe(best["_alone"]) & sums["_group"].eqNullSafe(best["_group"])
    return sums.join(best, same, "left").select(stratum, *[f"cut_{r}" for r in grids])


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", text: str = "text", **risk: float) -> DataFrame:
    """(key, counts, base_failed, kept, reasons) of every row. Signals are computed once and written, without the texts."""
    counts = counted(docs.select(F.col(key).alias("_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), F.col(text).alias("_text")), "_text").drop("_text")
    counts = written(counts, "quality-signals")
    scored = counts.withColumn("base_failed", base_failed()).select("*", *[c.alias(r) for r, c in signals().items()])
    marked = labels.groupBy(F.col(key).alias("_id")).agg((F.min("quality") == 1).alias("_good"))
    # the base rules act first: only what they leave is the method's to reject
    cuts = calibrated(scored.where(~F.col("base_failed")).join(marked, "_id"), "_stratum", "_good", **risk)
    cuts = written(cuts, "quality-cutoffs")
    out = scored.join(cuts, "_stratum", "left")
    hits = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in GRIDS]))
    return out.select(F.col("_id").alias(key), *COUNTS, "base_failed", (~F.col("base_failed") & (F.size(hits) == 0)).alias("kept"), hits.alias("reasons"))


def kept_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that neither the base rules nor the calibrated rules reject, with their columns."""
    # repeated ids have equal or different texts; a row leaves only for its own text, so rows meet their verdict by id and text
    columns = docs.columns
    (mark,) = absent(docs, "mark")
    named = docs.withColumn(mark, row_mark(docs, key, options.get("text", "text"), options.get("stratum", "lang")))
    marks = named.select(F.col(key).alias("_key"), mark).join(labels.select(F.col(key).alias("_key"), "quality"), "_key").select(mark, "quality")
    gone = judged(named, marks, mark, **options).where(~F.col("kept")).select(mark).distinct()
    return named.join(gone, mark, "left_anti").select(*columns)
