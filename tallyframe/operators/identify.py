"""Format identification: cosine similarity of term counts between texts and specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyframe.functions.sqltext import q
from tallyframe.session import written
from tallyframe.sources.layouts import BUILT_IN, Spec

WORD = r"[\p{L}\p{N}_]+"
TOP_K = 3


def term_counts(texts: DataFrame, key: str, text: str, pattern: str = WORD) -> DataFrame:
    """(key, term, n): lower-case words per text, combined map-side."""
    return texts.select(key, F.expr(f"explode(regexp_extract_all(lower({text}), {q(pattern)}, 0)) as term")) \
        .groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def spec_terms(spark: SparkSession, *specs: Spec) -> DataFrame:
    """(spec, term, weight): field names weigh 2, types and description words 1. A few hundred rows."""
    rows = []
    for s in specs or tuple(BUILT_IN.values()):
        for f in s.fields:
            rows += [(s.name, f.name, 2), (s.name, f.data_type, 1)]
        rows += [(s.name, w, 1) for w in s.description.lower().replace("-", " ").split()]
    raw = spark.createDataFrame(rows, "spec string, term string, w int")
    return raw.groupBy("spec", "term").agg(F.sum("w").cast("bigint").alias("weight"))


def similarity(counts: DataFrame, key: str, terms: DataFrame, idf: bool = False) -> DataFrame:
    """Cosine of term vectors per (text, spec) with at least one common term; absent terms add nothing, so the inner
    join is exact. ``idf`` weighs terms by their rarity among the specs (off by default)."""
    if idf:
        total = terms.select("spec").distinct().count()
        df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        terms = terms.join(df, "term").withColumn(
            "weight", F.col("weight") * (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1)).drop("df")
    spec_norm = terms.groupBy("spec").agg(F.expr("sqrt(sum(weight * weight)) as spec_norm"))
    # The counts are dear, so one pass makes both sums: a term meets each spec that has it, and itself (the norm, without a spec).
    kind = terms.schema["weight"].dataType.simpleString()
    of = terms.groupBy("term").agg(F.collect_list(F.struct("spec", "weight")).alias("specs"))
    met = counts.join(of, "term", "left").select(key, "n", F.expr(
        f"inline(concat(array(struct(cast(null as string) as spec, cast(n as {kind}) as weight)), coalesce(specs, array())))"))
    sums = met.groupBy(key, "spec").agg(F.expr("sum(n * weight) as dot"))
    text = Window.partitionBy(key)
    normed = sums.withColumn("text_norm", F.sqrt(F.max(F.when(F.col("spec").isNull(), F.col("dot"))).over(text))).filter("spec is not null")
    # a text without a key has no place among the scores
    return normed.filter(F.col(key).isNotNull()).join(spec_norm, "spec").select(
        key, "spec", F.expr("round(dot / (text_norm * spec_norm), 6) as score"))


def identify(texts: DataFrame, key: str, text: str, specs: tuple[Spec, ...] = tuple(BUILT_IN.values()),
             k: int = TOP_K, idf: bool = False) -> DataFrame:
    """Top-k specs per text, which may stand in several rows of one key. Every key is scored against every spec (the list is
    fixed); no common term scores 0."""
    spark = texts.sparkSession
    scores = similarity(term_counts(texts, key, text), key, spec_terms(spark, *specs), idf)
    names = ", ".join(q(s.name) for s in specs)
    pairs = texts.select(key).distinct().select(key, F.expr(f"explode(array({names})) as spec"))
    ranked = pairs.join(scores, [key, "spec"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "spec")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vocabulary(texts: DataFrame, text: str, pattern: str = "[a-z_]+", most: int = 200) -> DataFrame:
    """Most frequent words: a top-k report."""
    words = texts.select(F.expr(f"explode(regexp_extract_all(lower({text}), {q(pattern)}, 0)) as word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(most)


def cosine(left: DataFrame, right: DataFrame, key: str, term: str) -> DataFrame:
    """Cosine of each keyed profile in ``left`` (key, term, n) with the single profile ``right`` (term, m; unique terms). ``left`` is read
    once; ``right`` is written, so that a small one is broadcast by its size."""
    right = written(right, "profile")
    norm = right.agg(F.expr("sqrt(sum(m * m))")).scalar()
    sums = left.join(right, term, "left").groupBy(key).agg(
        F.expr("sqrt(sum(n * n)) as ln"),
        F.expr(f"sum(if({key} is null, null, n * m)) as dot"))
    joined = sums.withColumn("rn", norm)
    return joined.select(key, F.expr("round(if(ln = 0 or rn = 0, 0D, coalesce(dot, 0) / (ln * rn)), 6) as overlap"))
