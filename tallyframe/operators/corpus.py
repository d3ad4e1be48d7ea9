"""Corpus preparation: cleaning, exact line and near-duplicate document removal, splits, statistics, augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions import text as tx
from tallyframe.functions.sqltext import q
from tallyframe.operators import ordered, sinks, skew
from tallyframe.session import by_key, written

BLOCK = 512
OVERLAP = 0.5
SPLITS = (("train", 0.9), ("val", 0.05), ("test", 0.05))
SEPARATOR = "\n\n"


# ---------------------------------------------------------------------------------------------------- cleaning
def cleaned(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Cleaned documents; empty ones are dropped."""
    return docs.withColumn(text, tx.clean(F.col(text), **options)).filter(F.length(text) > 0)


def doc_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line): lines of every document."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def distinct_lines(lines: DataFrame, key: str = "doc_id", case_sensitive: bool = True) -> DataFrame:
    """First occurrence of every line over the whole corpus, with the number of copies. A minimum over (document,
    position) is combined map-side, so a line that fills a third of the corpus costs one row per task."""
    probe = F.col("line") if case_sensitive else F.lower("line")
    first = lines.groupBy(probe.alias("_probe")).agg(
        F.min(F.struct(key, "pos", "line")).alias("f"), F.count(F.lit(1)).alias("copies"))
    return first.select(f"f.{key}", "f.pos", "f.line", "copies")


def rebuilt(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents from their remaining lines (a document's lines were one row before, so each group fits)."""
    return lines.groupBy(key).agg(F.expr(
        "array_join(transform(sort_array(collect_list(struct(pos, line))), x -> x.line), '\\n') as text"))


# --------------------------------------------------------------------------------------- near-duplicate documents
def block_hashes(docs: DataFrame, size: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_blocks, hash): the distinct MD5 hashes of consecutive blocks of each document."""
    # one pass cuts the text; a substring per block would scan the text from its start each time
    hashes = F.expr(f"array_distinct(transform(regexp_extract_all({text}, '(?s).{{1,{size}}}', 0), b -> md5(b)))")
    with_text = docs.filter(F.length(text) > 0).select(key, hashes.alias("hashes"))
    return with_text.select(key, F.size("hashes").alias("n_blocks"), F.explode("hashes").alias("hash"))


def block_overlap(hashes: DataFrame, kept: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Per document: the share of its blocks that an earlier document has (earlier kept document, if ``kept`` is given).

    "Earlier" needs only the smallest key per hash, so no pairs are formed; heavy hashes take the hot-key path."""
    weights = hashes.groupBy("hash").agg(F.min(key).alias("first_any"), F.count(F.lit(1)).alias("_n"))
    if kept is None:
        lookup = weights.withColumnRenamed("first_any", "first_key")
    else:
        firsts = hashes.join(kept, key, "left_semi").groupBy("hash").agg(F.min(key).alias("first_key"))
        lookup = weights.drop("first_any").join(firsts, "hash", "left")
    looked = skew.lookup_join(hashes, lookup, ["hash"], ["first_key"])
    seen = F.coalesce(F.col("first_key") < F.col(key), F.lit(False))
    return looked.groupBy(key).agg(F.max("n_blocks").alias("n_blocks"), F.count_if(seen).alias("seen_blocks"))


def dedup_documents(docs: DataFrame, size: int = BLOCK, threshold: float = OVERLAP, one_pass: bool = False,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop documents half of whose blocks an earlier kept document has.

    The sequential rule depends on what was kept before. ``one_pass`` compares with all earlier documents. Otherwise
    verdicts are found in rounds. For an undecided document, the blocks that an earlier kept document has are a lower bound of its
    seen blocks, those that an earlier kept or undecided one has an upper bound. It is dropped if the lower bound reaches the
    threshold, kept if the upper one does not, and stays undecided else. At least the smallest undecided document is decided
    in a round. Only blocks of undecided documents are read again, and only those of newly kept ones are added to what is known;
    both are written each round. Documents that share no block with another one are kept without taking part."""
    hashes = block_hashes(docs, size, key, text)
    if one_pass:
        gone = block_overlap(hashes, None, key).filter(F.col("seen_blocks") >= F.col("n_blocks") * threshold)
        return docs.join(gone.select(key), key, "left_anti")
    counts = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("_n"))
    open_ = written(skew.lookup_join(hashes, counts, ["hash"], ["_n"]).filter("_n > 1").drop("_n"), "block-hashes")
    first = open_.select("hash", F.col(key).alias("_first")).limit(0)
    dropped = open_.select(key).limit(0)
    while True:
        here = open_.groupBy("hash").agg(F.min(key).alias("_least")).join(first, "hash", "left")
        looked = skew.lookup_join(open_, here, ["hash"], ["_least", "_first"])
        bounds = looked.groupBy(key).agg(F.max("n_blocks").alias("_n"), F.count_if(F.coalesce(F.col("_first") < F.col(key), F.lit(False))).alias("_low"),
                                         F.count_if(F.least("_least", "_first") < F.col(key)).alias("_high"))
        enough = F.col("_n") * threshold
        verdict = F.when(F.col("_low") >= enough, "dropped").when(F.col("_high") < enough, "kept").otherwise("open")
        verdicts = written(bounds.select(key, verdict.alias("_verdict")), "block-verdicts")
        if verdicts.isEmpty():
            return docs.join(dropped, key, "left_anti")
        dropped = dropped.union(verdicts.filter("_verdict = 'dropped'").select(key))
        kept = open_.join(verdicts.filter("_verdict = 'kept'"), key, "left_semi").select("hash", F.col(key).alias("_first"))
        first = written(first.union(kept).groupBy("hash").agg(F.min("_first").alias("_first")), "block-firsts")
        open_ = written(open_.join(verdicts.filter("_verdict = 'open'"), key, "left_semi"), "block-hashes")


def intersection_ratio(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """Share of each key's distinct items that also occur in the reference set."""
    marked = left.select(key, item).distinct().join(right.select(item).distinct().withColumn("_hit", F.lit(1)), item, "left")
    return marked.groupBy(key).agg(F.expr("round(count(_hit) / count(1), 6) as ratio"))


# -------------------------------------------------------------------------------------------- splits, assembling
def split_by_offset(docs: DataFrame, splits=SPLITS, corpus: str = "corpus", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Contiguous split of the concatenated corpus by character offset, without ever building it: every document is
    cut where a border falls into it. Fractions must sum to 1."""
    if abs(sum(w for _, w in splits) - 1.0) > 1e-6:
        raise ValueError("split fractions must sum to 1")
    totals = docs.groupBy(corpus).agg(F.sum(F.length(text).cast("bigint")).alias("_total"))
    placed = ordered.running_sums(docs.select(corpus, key, text), [corpus], [key], {"_upto": F.length(text)}, per_group=totals, sparse=True)
    (_, a), (_, b), _ = splits
    first, second = f"floor(_total * {a}D)", f"floor(_total * ({a}D + {b}D))"
    at = f"(_upto - length({text}))"
    pieces = []
    for (name, _), lo, hi in zip(splits, ["0L", first, second], [first, second, "_total"]):
        begin, end = f"greatest({lo} - {at}, 0L)", f"least({hi} - {at}, cast(length({text}) as bigint))"
        pieces.append(f"if({end} > {begin}, struct({q(name)} as split, {at} + {begin} as position, "
                      f"substring({text}, cast({begin} + 1 as int), cast({end} - {begin} as int)) as piece), null)")
    return placed.select(corpus, key, F.expr(f"inline(array_compact(array({', '.join(pieces)})))"))


def split_by_hash(docs: DataFrame, splits=SPLITS, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Whole-document split by a hash of the key: no order, no shuffle."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    (n1, a), (n2, b), (n3, _) = splits
    return docs.withColumn("split", F.when(u < a, n1).when(u < a + b, n2).otherwise(n3))


def concat_shards(docs: DataFrame, docs_per_shard: int = 64, separator: str = SEPARATOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Concatenated shards of a bounded number of consecutive documents; the corpus is the shards in order."""
    shard = F.floor(F.col(key) / docs_per_shard).cast("bigint").alias("shard")
    return docs.groupBy(shard).agg(
        F.expr(f"listagg({text}, {q(separator)}) within group (order by {key}) as text"), F.count(F.lit(1)).alias("documents"))


def replicate(docs: DataFrame, k: int) -> DataFrame:
    return docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))


# --------------------------------------------------------------------------------------------------- statistics
def stats(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Characters, lines, words and mean line length per group."""
    lines = F.size(F.split(text, "\n", -1)).cast("bigint")
    return docs.select(*by, F.length(text).cast("bigint").alias("c"), lines.alias("l"),
                       F.size(tx.words(F.col(text))).cast("bigint").alias("w")).groupBy(*by).agg(
        F.sum("c").alias("characters"), F.sum("l").alias("lines"), F.sum("w").alias("words"),
        F.expr("round((sum(c) - sum(l) + count(1)) / sum(l), 6) as avg_line_len"))


def char_counts(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Character frequencies per group, combined map-side."""
    return docs.select(*by, F.explode(tx.characters(F.col(text))).alias("ch")).groupBy(*by, "ch").agg(F.count(F.lit(1)).alias("n"))


def top_chars(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.groupBy("ch").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "ch").limit(k)


def summary(docs: DataFrame, by: list[str], text: str = "text", k: int = 10) -> DataFrame:
    """Statistics per group: characters, lines, words, mean line length, distinct characters and the k most frequent ones (ties: the
    smaller character). What is ranked has one row per group and character of the alphabet."""
    counts = char_counts(docs, by, text)
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "ch")))
    alphabet = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique_chars"),
        F.expr(f"transform(sort_array(collect_list(if(_rank <= {k}, struct(_rank, ch, n), null))), x -> struct(x.ch, x.n)) as top_chars"))
    return stats(docs, by, text).join(alphabet, by, "left").withColumns({
        "unique_chars": F.coalesce("unique_chars", F.lit(0)),
        "top_chars": F.coalesce("top_chars", F.expr("cast(array() as array<struct<ch:string,n:bigint>>)"))})


def distinct_share(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct-n: unique over all n-grams of words; 0 when there is none."""
    grams = docs.select(key, tx.word_ngrams(tx.words(F.col(text)), n).alias("g"))
    return grams.select(key, F.expr("size(g) as total"), F.expr("size(array_distinct(g)) as distinct_grams")).select(
        key, "total", "distinct_grams", F.expr("if(total = 0, 0D, round(distinct_grams / total, 6)) as distinct_n"))


def repetition_rate(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Share of distinct n-grams that occur more than once; 0 when there is none. Texts meet at their key, not their n-grams."""
    grams = by_key(docs.select(key, text), key, text).select(key, F.explode(tx.word_ngrams(tx.words(F.col(text)), n)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("c"))
    rates = grams.groupBy(key).agg(F.expr("round(count_if(c > 1) / count(1), 6) as repetition"))
    return docs.select(key).join(rates, key, "left").fillna({"repetition": 0.0})


def bigram_profile(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    return docs.select(*by, F.explode(tx.char_ngrams(F.col(text), 2)).alias("bigram")).groupBy(*by, "bigram").agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------------------------------------------- augmentation
def coin(seed: int, parts: list[str]) -> str:
    """Uniform [0, 1) as SQL text from a 64-bit hash; cheap enough per character."""
    return f"(pmod(xxhash64({seed}, {', '.join(parts)}), 1000003L) / 1000003D)"


def unit(seed: int, key: str, name: str) -> str:
    return f"(cast(conv(substring(md5(concat_ws('|', '{seed}', cast({key} as string), '{name}')), 1, 8), 16, 10) as bigint) / 4294967296D)"


def random_slice(text: str, seed: int, key: str, low: float = 0.5, high: float = 0.95) -> str:
    """A substring of 50 to 95 percent of the text."""
    size = f"greatest(1, cast(floor(length({text}) * ({low}D + {unit(seed, key, 'ratio')} * {high - low:.6f}D)) as int))"
    start = f"cast(floor({unit(seed, key, 'start')} * (greatest(0, length({text}) - {size}) + 1)) as int)"
    return f"substring({text}, {start} + 1, {size})"


def swap_lines(text: str, seed: int, key: str, probability: float = 0.05) -> str:
    """Adjacent lines swapped left to right with a probability: within a run of successful coins the first line moves
    behind the run and the others move up by one."""
    hit = f"{coin(seed, [key, 'cast(%s as int)'])} < {probability}D"
    at, prev, run = hit % "p", hit % "p - 1", hit % "x"
    start = f"coalesce(array_max(filter(sequence(0, p - 1), x -> not ({run}))), -1) + 1"
    lines = f"split({text}, '\\n', -1)"
    return f"""array_join(transform({lines}, (l, p) -> case
        when p < size({lines}) - 1 and {at} then element_at({lines}, p + 2)
        when p > 0 and {prev} then element_at({lines}, {start} + 1) else l end), '\\n')"""


def char_dropout(text: str, seed: int, key: str, probability: float = 0.005) -> str:
    """Characters dropped independently."""
    return f"array_join(filter(split({text}, ''), (c, i) -> {coin(seed, [key, 'i', '17'])} >= {probability}D), '')"


def repeat_section(text: str, seed: int, key: str, longest: int = 500) -> str:
    """A block from the first half inserted again somewhere; texts under 20 characters stay."""
    start = f"cast(floor({unit(seed, key, 'rs')} * (length({text}) div 2 + 1)) as int)"
    size = f"(10 + cast(floor({unit(seed, key, 'rl')} * {longest - 9}) as int))"
    insert = f"cast(floor({unit(seed, key, 'ri')} * (length({text}) + 1)) as int)"
    return (f"if(length({text}) < 20, {text}, concat(substring({text}, 1, {insert}), substring({text}, {start} + 1, {size}), "
            f"substring({text}, {insert} + 1)))")


def augment(docs: DataFrame, factor: int, seed: int = 42, swap: float = 0.02, drop: float = 0.003, key: str = "doc_id", text: str = "text") -> DataFrame:
    """factor - 1 variants per document: slice 0.3, swap 0.3, drop-out 0.2, repeat 0.2. ``variant`` 0 is the original."""
    many = docs.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    many = many.withColumn("_key", F.concat_ws("#", F.col(key).cast("string"), F.col("variant").cast("string")))
    u = unit(seed, "_key", "choice")
    kind = f"case when variant = 0 then 'original' when {u} < 0.3D then 'slice' when {u} < 0.6D then 'swap' when {u} < 0.8D then 'dropout' else 'repeat' end"
    many = many.withColumn("kind", F.expr(kind))
    new = f"""case kind when 'slice' then {random_slice(text, seed, '_key')} when 'swap' then {swap_lines(text, seed, '_key', swap)}
        when 'dropout' then {char_dropout(text, seed, '_key', drop)} when 'repeat' then {repeat_section(text, seed, '_key')} else {text} end"""
    return many.withColumn(text, F.expr(new)).drop("_key")


def prepared(docs: DataFrame, dedup: bool = True, factor: int = 1, key: str = "doc_id", **clean_options) -> DataFrame:
    """Clean, drop empty, drop near-duplicate documents, drop repeated lines over the corpus, augment."""
    out = cleaned(docs.select(key, "text"), **clean_options)
    if dedup:
        # cleaning is dear and several branches read the texts: written once, and out of reach of inferred filters
        out = dedup_documents(written(out, "cleaned-documents"), key=key)
        out = rebuilt(distinct_lines(doc_lines(out, key), key), key)
    return augment(out, factor, key=key) if factor > 1 else out


def prepare(docs: DataFrame, path: str | None = None, factor: int = 1, splits=SPLITS, key: str = "doc_id", **options) -> DataFrame:
    """The whole preparation: ``prepared`` texts (key, variant, kind, text) with the split of their document, written once. Variants
    of a document stay in its split, so no augmented text leaks from training into the other splits.

    With ``path`` the splits are also written there as ordered text files, documents in the order of key and variant, each
    followed by an empty line. Documents may be empty, null or missing; null texts count as empty and go."""
    out = prepared(docs, factor=factor, key=key, **options)
    if factor <= 1:
        out = out.withColumns({"variant": F.lit(0), "kind": F.lit("original")})
    out = written(split_by_hash(out.select(key, "variant", "kind", "text"), splits, key), "prepared-corpus")
    if path is not None:
        lines = out.select("split", key, "variant", F.posexplode(F.split(F.concat("text", F.lit("\n")), "\n", -1)).alias("pos", "text"))
        sinks.write_splits(lines.withColumn("position", F.struct(key, "variant", "pos")), path)
    return out
