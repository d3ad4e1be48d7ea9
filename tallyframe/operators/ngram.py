"""Character n-gram model, its distributions, loss and text generation; character vocabulary; token windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyframe.functions import seeded, text as tx
from tallyframe.operators import ordered, skew
from tallyframe.session import by_key, written

START, END = "^", "$"
FLOOR = 1e-6
SPECIALS = {"<PAD>": 0, "<BOS>": 1, "<EOS>": 2, "<UNK>": 3}


def model(texts: DataFrame, field: str, text: str, n: int = 3, weight: str | None = None) -> DataFrame:
    """(field, context, next, n): counts of the next character after each context of n-1 characters. ``weight`` names a
    column with the number of copies of a text."""
    padded = F.concat(F.lit(START * (n - 1)), F.col("_t"), F.lit(END))
    copies = F.col(weight) if weight else F.lit(1)
    rows = texts.select(F.col(field).alias("field"), tx.strip_blank(F.col(text)).alias("_t"), copies.cast("bigint").alias("_w")).filter("_t <> ''")
    grams = rows.select("field", "_w", F.explode(tx.char_ngrams(padded, n)).alias("g")).groupBy("field", "g").agg(F.sum("_w").alias("n"))
    return grams.select("field", F.expr(f"substring(g, 1, {n - 1}) as context"), F.expr(f"substring(g, {n}, 1) as next"), "n")


def distribution(counts: DataFrame, temperature: float = 0.8) -> DataFrame:
    """Temperature-scaled next-character distribution and its cumulative form, ordered by character. A context has at
    most one row per character of the alphabet, which bounds the window."""
    context = Window.partitionBy("field", "context")
    power = F.pow(F.col("n") / F.sum("n").over(context), F.lit(1.0 / temperature))
    shares = counts.withColumn("_p", power).withColumn("p", F.col("_p") / F.sum("_p").over(context)).drop("_p")
    running = context.orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
    return shares.withColumn("cumulative", F.sum("p").over(running))


def top_k_cut(dist: DataFrame, k: int) -> DataFrame:
    """Keep every character whose probability reaches the k-th largest."""
    order = Window.partitionBy("field", "context").orderBy(F.col("p").desc())
    return dist.withColumn("_rank", F.rank().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def nucleus_cut(dist: DataFrame, top_p: float) -> DataFrame:
    """Keep characters while the probability before them does not exceed top_p; renormalised."""
    order = Window.partitionBy("field", "context").orderBy(F.col("p").desc(), "next").rowsBetween(Window.unboundedPreceding, 0)
    kept = dist.withColumn("_before", F.round(F.sum("p").over(order) - F.col("p"), 9)).filter(F.col("_before") <= top_p).drop("_before")
    total = F.sum("p").over(Window.partitionBy("field", "context"))
    return kept.withColumn("p", F.col("p") / total)


def repetition_penalty(dist: DataFrame, previous: Column, penalty: float) -> DataFrame:
    """Divide the log-probability scores of characters already seen; renormalised."""
    context = Window.partitionBy("field", "context")
    score = F.log("p") / F.when(previous, F.lit(penalty)).otherwise(F.lit(1.0))
    scaled = dist.withColumn("_e", F.exp(score))
    return scaled.withColumn("p", F.col("_e") / F.sum("_e").over(context)).drop("_e")


def lookup(tests: DataFrame, counts: DataFrame, key: str, text: str, n: int = 3, floor: float = FLOOR) -> DataFrame:
    """n-grams of test texts with the probability a single-field model gives them: (key, context, next, n, p).

    The texts travel to their key, not their n-grams, which are many times as much; the model is written, so that a small one is
    broadcast by its size and nothing else moves."""
    padded = F.concat(F.lit(START * (n - 1)), F.col("_t"), F.lit(END))
    rows = by_key(tests.select(key, text), key, text).select(key, tx.strip_blank(F.col(text)).alias("_t")).filter("_t <> ''")
    grams = rows.select(key, F.explode(tx.char_ngrams(padded, n)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("n"))
    totals = F.sum("n").over(Window.partitionBy("context"))
    probs = written(counts.withColumn("_p", F.col("n") / totals).select(F.concat("context", "next").alias("g"), "_p"), "ngram-model")
    return grams.join(probs, "g", "left").select(
        key, F.expr(f"substring(g, 1, {n - 1}) as context"), F.expr(f"substring(g, {n}, 1) as next"), "n",
        F.coalesce("_p", F.lit(floor)).alias("p"))


def loss(looked: DataFrame, by: list[str]) -> DataFrame:
    """Mean negative log-likelihood, perplexity exp(min(loss, 20)), bits per token, tokens, total."""
    return looked.groupBy(*by).agg(F.expr("sum(-ln(p) * n) as nll"), F.expr("sum(n) as n_tokens")).select(
        *by, "n_tokens", F.expr("nll / n_tokens as loss"), F.expr("exp(least(nll / n_tokens, 20D)) as ppl"),
        F.expr("nll / n_tokens / ln(2) as bpt"), "nll")


def bits_per_char(losses: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Add bits per character, from the total and the length of each text."""
    return losses.join(texts.select(key, F.length(text).alias("_c")), key).withColumn(
        "bpc", F.expr("nll / ln(2) / greatest(_c, 1)")).drop("_c")


# ---------------------------------------------------------------------------------------------------- generation
def _choices(counts: DataFrame, temperature: float) -> DataFrame:
    dist = distribution(counts, temperature)
    packed = dist.groupBy("field", "context").agg(F.expr(
        "sort_array(collect_list(struct(next as ch, cumulative as c))) as choices"))
    return packed


def _uniform_sql(seed: int, row: str, step: int) -> str:
    return seeded.unit(seed, row, f"step{step}")


#: Steps between two written states of a walk.
WALK_STEPS = 4


def generate_text(rows: DataFrame, row: str, field: str, counts: DataFrame, length: int, temperature: float = 0.8, seed: int = 42, n: int = 3) -> DataFrame:
    """(row, field, text): one sampled text per row, at most ``length`` characters, padded with blanks.

    The draw at each step is a hash of (seed, row, step). All rows walk together: a step joins their contexts with the model, of any
    size (``skew.lookup_join``: that all rows start from one context is no hot task), and every few steps the rows are written. A
    context never seen falls back to the field's alphabet, uniformly."""
    choices = written(_choices(counts, temperature), "ngram-choices")
    alphabet = counts.groupBy("field").agg(F.sort_array(F.collect_set("next")).alias("alphabet"))
    state = rows.select(F.col(row).alias("row"), F.col(field).alias("field")).join(alphabet, "field", "left").withColumns({
        "context": F.lit(START * (n - 1)), "text": F.lit(""), "done": F.lit(False)})
    for step in range(length):
        if step % WALK_STEPS == 0:
            state = written(state, "ngram-walk")
        joined = skew.lookup_join(state, choices, ["field", "context"], ["choices"])
        u = _uniform_sql(seed, "row", step)
        picked = f"""case when done then '' when choices is not null then
            coalesce(filter(choices, x -> {u} <= x.c)[0].ch, element_at(choices, -1).ch)
            else coalesce(try_element_at(alphabet, cast(floor({u} * size(alphabet)) as int) + 1), ' ') end"""
        state = joined.withColumn("_ch", F.expr(picked)).withColumn(
            "done", F.expr(f"done or (choices is not null and _ch = '{END}')")).withColumns({
                "text": F.expr("if(done, text, concat(text, _ch))"),
                "context": F.expr(f"if(done, context, right(concat(context, _ch), {n - 1}))")}).drop("_ch", "choices")
    return state.select("row", "field", F.rpad("text", length, " ").alias("text"))


# ---------------------------------------------------------------------------------------- character vocabulary
def char_vocabulary(texts: DataFrame, text: str, offset: int = len(SPECIALS)) -> DataFrame:
    """(ch, id): distinct characters by code point. The alphabet, not the corpus, bounds the window."""
    chars = texts.select(F.explode(F.array_distinct(tx.characters(F.col(text)))).alias("ch")).distinct()
    return chars.withColumn("id", (F.row_number().over(Window.orderBy("ch")) - 1 + offset).cast("int"))


#: Characters, or ids, of a batch that encoding and decoding hand back. A batch of texts would come back as one of ids four times as large.
BATCH_CHARS = 1 << 20


def _in_batches(df: DataFrame, column: str, sizes: Callable[[pa.Array], pa.Array], out: str, kind: str, made: pa.DataType, of: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """Add ``out``, computed from ``column`` by Arrow batches of at most BATCH_CHARS by ``sizes``, or one row."""
    schema = T.StructType([*[f for f in df.schema if f.name != out], T.StructField(out, T._parse_datatype_string(kind))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            ends, at = np.cumsum(pc.fill_null(sizes(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS, side="right")))
                part, kept = batch.slice(at, end - at), [n for n in batch.schema.names if n != out]
                columns = [part.column(part.schema.get_field_index(n)) for n in kept]
                yield pa.RecordBatch.from_arrays([*columns, of(values.slice(at, end - at)).cast(made)], names=[*kept, out])
                at = end

    return df.mapInArrow(work, schema)


def encode(texts: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """Add ``ids``: character ids, unknown characters as 3. A table over the code points, bounded by the alphabet, gives the ids of
    a whole text at once."""
    known = {ord(r["ch"]): r["id"] for r in vocabulary.select("ch", "id").collect()}
    table = np.full(max(known, default=0) + 2, SPECIALS["<UNK>"], np.int32)
    table[list(known)] = list(known.values())
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def of(values: pa.Array) -> pa.Array:
        found = values.to_pylist()
        points = np.frombuffer("".join(v for v in found if v is not None).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([0, *[len(v or "") for v in found]])
        ids = shared.value[np.minimum(points, len(shared.value) - 1)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=pa.array([v is None for v in found]))

    return _in_batches(texts, text, pc.binary_length, "ids", "array<int>", pa.list_(pa.int32()), of)


def decode(encoded: DataFrame, vocabulary: DataFrame, offset: int = len(SPECIALS)) -> DataFrame:
    """Add ``decoded``: padding, start and end marks are skipped. A table over the ids, bounded by the alphabet, gives the characters of
    all ids at once; ids behind its end are shown as a question mark."""
    rows = sorted((r["id"], r["ch"]) for r in vocabulary.select("ch", "id").collect())
    unknown = SPECIALS["<UNK>"]
    known = {ord(ch) for _, ch in rows} | {ord("?")}
    mark = next(c for c in range(0xE000, 0x110000) if c not in known)  # stands for unknown characters until the text is made
    table = np.full(max(offset + len(rows), unknown + 1) + 1, ord("?"), np.uint32)
    table[offset:offset + len(rows)] = [ord(ch) for _, ch in rows]
    table[unknown] = mark
    shared = encoded.sparkSession.sparkContext.broadcast((table, chr(mark)))

    def of(values: pa.Array) -> pa.Array:
        table, mark = shared.value
        ids = values.flatten()
        ids, sizes = ids.fill_null(0).to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
        shown = ids >= unknown
        ends = np.append(0, np.cumsum(shown))[np.append(0, np.cumsum(sizes))]
        whole = table[np.minimum(ids[shown], len(table) - 1)].astype("<u4").tobytes().decode("utf-32-le", "replace")
        return pa.array([None if null else whole[a:b].replace(mark, "<UNK>") for a, b, null in zip(ends[:-1].tolist(), ends[1:].tolist(), values.is_null().to_pylist())], pa.string())

    return _in_batches(encoded, "ids", pc.list_value_length, "decoded", "string", pa.string(), of)


def coverage(encoded: DataFrame, key: str) -> DataFrame:
    """Share of known characters, unknown count, tokens."""
    unknown = F.when(F.col("ids").isNull(), F.size("ids")).otherwise(F.size("ids") - F.size(F.array_remove("ids", SPECIALS["<UNK>"])))
    return encoded.select(key, unknown.cast("bigint").alias("unk_count"), F.size("ids").cast("bigint").alias("n_tokens")).withColumn(
        "coverage", F.expr("round(1 - unk_count / greatest(n_tokens, 1), 6)"))


def windows(encoded: DataFrame, key: str, length: int, stride: int = 1) -> DataFrame:
    """(key, start, x, y): every training window x and the same window shifted by one."""
    starts = F.expr(f"explode(if(size(ids) > {length}, sequence(0, size(ids) - {length} - 1, {stride}), cast(array() as array<int>))) as start")
    return encoded.select(key, "ids", starts).select(
        key, "start", F.expr(f"slice(ids, start + 1, {length}) as x"), F.expr(f"slice(ids, start + 2, {length}) as y"))


#: Positions of the token stream whose windows one group makes.
SEGMENT = 1 << 16


def stream_windows(encoded: DataFrame, key: str, length: int, stride: int = 1, group: Sequence[str] = (), segment: int = SEGMENT) -> DataFrame:
    """(group, start, x, y): the training windows of the one token stream that the texts make in order of ``key`` (an integer, unique
    in its group), texts of any length and windows across their borders. ``start`` counts tokens from the stream's beginning.

    The stream is never put together. Every text knows its place from a running sum; it is cut where segments of the stream begin,
    and each segment also gets the next ``length`` tokens, its neighbour's first ones. So all windows that start in a segment are made
    from it alone, and no group holds more than ``segment + length`` tokens, whatever the texts' lengths or number. The ids are written
    once, as several passes read where they begin."""
    rows = written(encoded.select(*group, key, "ids"), "token-ids").filter(F.size("ids") > 0)
    placed = ordered.running_sums(rows, list(group), [key], {"_end": F.size("ids")}, sparse=True).withColumn("_from", F.col("_end") - F.size("ids"))
    first = F.greatest(F.lit(0), F.floor((F.col("_from") - length) / segment))
    parts = placed.withColumn("_segment", F.explode(F.sequence(first.cast("bigint"), F.floor((F.col("_end") - 1) / segment).cast("bigint"))))
    begin = F.greatest(F.col("_from"), F.col("_segment") * segment)
    stop = F.least(F.col("_end"), (F.col("_segment") + 1) * segment + length)
    parts = parts.select(*group, "_segment", begin.alias("_at"), F.slice("ids", (begin - F.col("_from") + 1).cast("int"), F.greatest(F.lit(0), stop - begin).cast("int")).alias("_piece")).filter(F.size("_piece") > 0)
    # a stream of one chunk was numbered in one task, which would otherwise keep all its segments
    whole = parts.repartition(*group, "_segment").groupBy(*group, "_segment").agg(F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
    whole = whole.select(*group, (F.col("_segment") * segment).alias("_base"), F.flatten(F.transform("_p", lambda p: p["_piece"])).alias("_t"))
    low, high = F.ceil(F.col("_base") / stride) * stride, F.least(F.col("_base") + segment, F.col("_base") + F.size("_t") - length) - 1
    starts = F.when(low <= high, F.sequence(low, high, F.lit(stride).cast("bigint")))
    cut = lambda more: F.expr(f"slice(_t, cast(start - _base as int) + {more}, {length})")
    return whole.withColumn("start", F.explode(starts)).select(*group, "start", cut(1).alias("x"), cut(2).alias("y"))
