"""Queries: corpus cleaning, dedup, splits, statistics, augmentation, n-gram model, tokenizers, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text as tx
from tallyframe.operators import bpe, corpus, identify, ngram, sinks
from tallyframe.plans.registry import query
from tallyframe.session import by_key, scratch_path, spread
from tallyframe.sources import derived

WS = r" \t\n\x0B\f\r\x1c-\x1f\x{85}\p{Z}"
WORDS = rf"regexp_extract_all(text, '[^{WS}]+')"
CHARS = "list_filter(string_split(text, ''), lambda c: c <> '')"


def docs(spark, folder):
    return derived.table(spark, folder, "documents")


def bench(spark, folder):
    return derived.table(spark, folder, "benchmark")


# ---------------------------------------------------------------------------------------------------- cleaning
PLAIN = "replace(translate({x}, '‘’“”–', '''''\"\"-'), '—', '--')"


@query("x15_normalize_unicode", f"SELECT doc_id, {PLAIN.format(x='nfc_normalize(text)')} AS text FROM documents")
def x15(spark, folder):
    return docs(spark, folder).select("doc_id", tx.normalize_unicode(F.col("text")).alias("text"))


@query("x16_strip_control", r"SELECT page_id, regexp_replace(replace(html, chr(9), ' '), '[^\n\P{C}]', '', 'g') AS text FROM pages")
def x16(spark, folder):
    return derived.table(spark, folder, "pages").select("page_id", tx.strip_control(F.col("html")).alias("text"))


@query("x17_squeeze_blank", rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '^[{WS}]+|[{WS}]+$', '', 'g') AS kept,
  regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g'), '^[{WS}]+|[{WS}]+$', '', 'g') AS collapsed FROM documents""")
def x17(spark, folder):
    return docs(spark, folder).select("doc_id", tx.squeeze_blank(F.col("text")).alias("kept"),
                                      tx.squeeze_blank(F.col("text"), preserve_newlines=False).alias("collapsed"))


@query("f9_bound_lines", """SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 20), lambda x: substr(x, 1, 200)), chr(10)) AS text FROM documents""")
def f9(spark, folder):
    return docs(spark, folder).select("doc_id", tx.bound_lines(F.col("text"), 20, 200).alias("text"))


CLEAN = rf"""trim(regexp_replace(regexp_replace(regexp_replace(replace({PLAIN.format(x='nfc_normalize(text)')}, chr(9), ' '), '[^\n\P{{C}}]', '', 'g'), '[ \t]+', ' ', 'g'), '^[{WS}]+|[{WS}]+$', '', 'g'))"""


@query("f10_clean_documents", f"SELECT doc_id, {CLEAN} AS text FROM documents WHERE length({CLEAN}) > 0")
def f10(spark, folder):
    return corpus.cleaned(docs(spark, folder).select("doc_id", "text"))


# --------------------------------------------------------------------------------------------------------- dedup
LINES_SQL = "lines AS (SELECT doc_id, cast(pos - 1 AS int) AS pos, l[pos] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents))"


@query("w10_distinct_lines", f"""WITH {LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS rn, count(*) OVER (PARTITION BY line) AS copies FROM lines)
  SELECT doc_id, pos, line, copies FROM r WHERE rn = 1""")
def w10(spark, folder):
    return corpus.distinct_lines(corpus.doc_lines(docs(spark, folder)))


@query("w10_distinct_lines_nocase", f"""WITH {LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(line) ORDER BY doc_id, pos) AS rn, count(*) OVER (PARTITION BY lower(line)) AS copies FROM lines)
  SELECT doc_id, pos, line, copies FROM r WHERE rn = 1""")
def w10b(spark, folder):
    return corpus.distinct_lines(corpus.doc_lines(docs(spark, folder)), case_sensitive=False)


BLOCKS = """b AS (SELECT DISTINCT doc_id, md5(array_to_string(c[i * 512 + 1:i * 512 + 512], '')) AS hash FROM (SELECT doc_id, c, unnest(range(0, cast(ceil(len(c) / 512.0) AS bigint))) AS i
    FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 0))),
  f AS (SELECT hash, min(doc_id) AS first_doc FROM b GROUP BY 1),
  ov AS (SELECT b.doc_id, cast(count(*) AS int) AS n_blocks, cast(count(*) FILTER (WHERE first_doc < b.doc_id) AS bigint) AS seen_blocks FROM b JOIN f USING (hash) GROUP BY 1)"""


@query("j11_block_overlap", f"WITH {BLOCKS} SELECT * FROM ov")
def j11(spark, folder):
    return corpus.block_overlap(corpus.block_hashes(docs(spark, folder)))


@query("u5_dedup_one_pass", f"WITH {BLOCKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ov WHERE seen_blocks >= n_blocks * 0.5)")
def u5(spark, folder):
    return corpus.dedup_documents(docs(spark, folder), one_pass=True).select("doc_id")


@query("u5_dedup_documents", None)
def u5b(spark, folder):
    return corpus.dedup_documents(docs(spark, folder).select("doc_id", "text"))


@query("u4_intersection_ratio", f"""WITH v AS (SELECT DISTINCT unnest({WORDS}) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS w FROM documents)
  SELECT doc_id, round(count(v.w) / count(*)::double, 6) AS ratio FROM d LEFT JOIN v USING (w) GROUP BY 1""")
def u4(spark, folder):
    left = docs(spark, folder).select("doc_id", F.explode(tx.words(F.col("text"))).alias("w"))
    right = bench(spark, folder).select(F.explode(tx.words(F.col("text"))).alias("w"))
    return corpus.intersection_ratio(left, right, "doc_id", "w")


# ------------------------------------------------------------------------------------------------------ assembly
@query("u1_union_corpora", "SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def u1(spark, folder):
    left = docs(spark, folder).selectExpr("'documents' as origin", "doc_id as id", "text")
    return left.unionByName(bench(spark, folder).selectExpr("'benchmark' as origin", "item_id as id", "text"))


@query("u6_split_by_offset", """WITH d AS (SELECT lang, doc_id, text, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(length(text)) OVER (PARTITION BY lang) AS t FROM documents),
  c AS (SELECT *, cast(floor(t * 0.9::double) AS bigint) AS t1, cast(floor(t * (0.9::double + 0.05::double)) AS bigint) AS t2 FROM d),
  p AS (SELECT lang, doc_id, text, n, a, unnest(['train', 'val', 'test']) AS split, unnest([0, t1, t2]) AS lo, unnest([t1, t2, t]) AS hi FROM c)
  SELECT lang, doc_id, split, cast(greatest(lo, a) AS bigint) AS position, md5(substr(text, cast(greatest(lo - a, 0) + 1 AS bigint), cast(least(hi - a, n) - greatest(lo - a, 0) AS bigint))) AS piece FROM p WHERE least(hi - a, n) > greatest(lo - a, 0)""")
def u6(spark, folder):
    return corpus.split_by_offset(docs(spark, folder), corpus="lang").select(
        "lang", "doc_id", "split", F.col("position").cast("bigint").alias("position"), F.md5("piece").alias("piece"))


@query("u6_split_by_hash", """WITH u AS (SELECT doc_id, (('0x' || substr(md5('42|' || doc_id), 1, 8))::bigint) / 4294967296.0::double AS u FROM documents)
  SELECT doc_id, CASE WHEN u < 0.9::double THEN 'train' WHEN u < 0.9::double + 0.05::double THEN 'val' ELSE 'test' END AS split FROM u""")
def u6b(spark, folder):
    return corpus.split_by_hash(docs(spark, folder)).select("doc_id", "split")


@query("u7_concat_shards", "SELECT doc_id // 64 AS shard, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text, cast(count(*) AS bigint) AS documents FROM documents GROUP BY 1")
def u7(spark, folder):
    return corpus.concat_shards(docs(spark, folder))


@query("u9_replicate", "SELECT doc_id, cast(unnest(range(1, 4)) AS int) AS copy, n_chars FROM documents")
def u9(spark, folder):
    return corpus.replicate(docs(spark, folder), 3).select("doc_id", "copy", "n_chars")


@query("k7_split_files", """WITH d AS (SELECT doc_id, (('0x' || substr(md5('42|' || doc_id), 1, 8))::bigint) / 4294967296.0::double AS u, unnest(string_split(text, chr(10))) AS line FROM documents),
  s AS (SELECT CASE WHEN u < 0.9::double THEN 'train' WHEN u < 0.9::double + 0.05::double THEN 'val' ELSE 'test' END AS split, line FROM d)
  SELECT split, cast(count(*) AS bigint) AS lines, cast(sum(length(replace(line, chr(13), ''))) AS bigint) AS chars FROM s GROUP BY 1""")
def k7(spark, folder):
    split = corpus.split_by_hash(docs(spark, folder))
    lines = split.select("split", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    path = scratch_path(spark, "splits")
    sinks.write_splits(lines.withColumn("position", F.struct("doc_id", "pos")), path)
    back = spark.read.option("lineSep", "\n").text(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("lines"),
                                     F.sum(F.length(F.replace("value", F.lit("\r"), F.lit(""))).cast("bigint")).alias("chars"))


# ---------------------------------------------------------------------------------------------------- statistics
@query("a28_corpus_stats", f"""SELECT lang, cast(sum(length(text)) AS bigint) AS characters, cast(sum(len(string_split(text, chr(10)))) AS bigint) AS lines,
  cast(sum(len({WORDS})) AS bigint) AS words, round((sum(length(text)) - sum(len(string_split(text, chr(10)))) + count(*)) / sum(len(string_split(text, chr(10))))::double, 6) AS avg_line_len FROM documents GROUP BY 1""")
def a28(spark, folder):
    return corpus.stats(docs(spark, folder), ["lang"])


@query("a28_char_counts", f"SELECT lang, ch, cast(count(*) AS bigint) AS n FROM (SELECT lang, unnest({CHARS}) AS ch FROM documents) GROUP BY 1, 2")
def a28b(spark, folder):
    return corpus.char_counts(docs(spark, folder), ["lang"])


@query("t6_top_characters", f"SELECT ch, cast(count(*) AS bigint) AS n FROM (SELECT unnest({CHARS}) AS ch FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def t6(spark, folder):
    return corpus.top_chars(corpus.char_counts(docs(spark, folder), ["lang"]))


@query("a30_distinct_n", f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w)
  SELECT doc_id, cast(len(g) AS int) AS total, cast(len(list_distinct(g)) AS int) AS distinct_grams, CASE WHEN len(g) = 0 THEN 0 ELSE round(len(list_distinct(g)) / len(g)::double, 6) END AS distinct_n FROM g""")
def a30(spark, folder):
    return corpus.distinct_share(docs(spark, folder), 2)


@query("a30_repetition_rate", f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
  c AS (SELECT doc_id, g, count(*) AS c FROM g GROUP BY 1, 2), r AS (SELECT doc_id, round(count(*) FILTER (WHERE c > 1) / count(*)::double, 6) AS r FROM c GROUP BY 1)
  SELECT doc_id, coalesce(r, 0.0::double) AS repetition FROM documents LEFT JOIN r USING (doc_id)""")
def a30b(spark, folder):
    return corpus.repetition_rate(docs(spark, folder))


BIGRAMS = "SELECT {key}, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) AS bigram FROM (SELECT {key}, " + CHARS + " AS c FROM {table})"


@query("a31_bigram_profile", f"SELECT lang, bigram, cast(count(*) AS bigint) AS n FROM ({BIGRAMS.format(key='lang', table='documents')}) GROUP BY 1, 2")
def a31(spark, folder):
    return corpus.bigram_profile(docs(spark, folder), ["lang"])


@query("a26_profile_overlap", f"""WITH l AS (SELECT doc_id, bigram, count(*) AS n FROM ({BIGRAMS.format(key='doc_id', table='documents')}) GROUP BY 1, 2),
  r AS (SELECT bigram, count(*) AS m FROM ({BIGRAMS.format(key='item_id', table='benchmark')}) GROUP BY 1),
  ln AS (SELECT doc_id, sqrt(sum(n * n)::double) AS ln FROM l GROUP BY 1), rn AS (SELECT sqrt(sum(m * m)::double) AS rn FROM r), d AS (SELECT doc_id, sum(n * m)::double AS dot FROM l JOIN r USING (bigram) GROUP BY 1)
  SELECT doc_id, round(coalesce(dot, 0) / (ln * rn), 6) AS overlap FROM ln LEFT JOIN d USING (doc_id), rn""")
def a26(spark, folder):
    left = corpus.bigram_profile(by_key(docs(spark, folder).select("doc_id", "text"), "doc_id", "text"), ["doc_id"])
    right = corpus.bigram_profile(bench(spark, folder), []).select("bigram", F.col("n").alias("m"))
    return identify.cosine(left, right, "doc_id", "bigram")


@query("x20_ngram_arrays", f"""WITH w AS (SELECT doc_id, {WORDS} AS w, {CHARS} AS c FROM documents)
  SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS word_pairs, md5(array_to_string(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]), ',')) AS char_trigrams FROM w""")
def x20(spark, folder):
    t = F.col("text")
    return docs(spark, folder).select("doc_id", tx.word_ngrams(tx.words(t), 2).alias("word_pairs"),
                                      F.md5(F.array_join(tx.char_ngrams(t, 3), ",")).alias("char_trigrams"))


# -------------------------------------------------------------------------------------------------- augmentation
def ou(key, name):
    return f"((('0x' || substr(md5('42|' || cast({key} AS varchar) || '|{name}'), 1, 8))::bigint) / 4294967296.0::double)"


@query("x21_random_slice", f"""WITH s AS (SELECT doc_id, text, cast(greatest(1, floor(length(text) * (0.5::double + {ou('doc_id', 'ratio')} * 0.45::double))) AS int) AS size FROM documents)
  SELECT doc_id, substr(text, cast(floor({ou('doc_id', 'start')} * (greatest(0, length(text) - size) + 1)) AS int) + 1, size) AS text FROM s""")
def x21(spark, folder):
    return docs(spark, folder).selectExpr("doc_id", f"{corpus.random_slice('text', 42, 'doc_id')} as text")


@query("x24_repeat_section", f"""WITH s AS (SELECT doc_id, text, cast(floor({ou('doc_id', 'rs')} * (length(text) // 2 + 1)) AS int) AS st, 10 + cast(floor({ou('doc_id', 'rl')} * 491) AS int) AS sz, cast(floor({ou('doc_id', 'ri')} * (length(text) + 1)) AS int) AS ins FROM documents)
  SELECT doc_id, CASE WHEN length(text) < 20 THEN text ELSE substr(text, 1, ins) || substr(text, st + 1, sz) || substr(text, ins + 1) END AS text FROM s""")
def x24(spark, folder):
    return docs(spark, folder).selectExpr("doc_id", f"{corpus.repeat_section('text', 42, 'doc_id')} as text")


@query("x22_swap_lines", None)
def x22(spark, folder):
    return docs(spark, folder).selectExpr("doc_id", f"{corpus.swap_lines('text', 42, 'doc_id')} as text")


@query("x23_char_dropout", None)
def x23(spark, folder):
    return docs(spark, folder).selectExpr("doc_id", f"{corpus.char_dropout('text', 42, 'doc_id')} as text")


@query("x25_augment_choice", f"""WITH v AS (SELECT doc_id, unnest([0, 1, 2]) AS variant FROM documents), k AS (SELECT doc_id, variant, {ou("(doc_id || '#' || variant)", 'choice')} AS u FROM v)
  SELECT doc_id, variant, CASE WHEN variant = 0 THEN 'original' WHEN u < 0.3::double THEN 'slice' WHEN u < 0.6::double THEN 'swap' WHEN u < 0.8::double THEN 'dropout' ELSE 'repeat' END AS kind FROM k""")
def x25(spark, folder):
    return corpus.augment(docs(spark, folder).select("doc_id", "text"), 3).select("doc_id", "variant", "kind")


@query("x25_augmented_texts", None)
def x25b(spark, folder):
    return corpus.augment(docs(spark, folder).select("doc_id", "text"), 3)


# --------------------------------------------------------------------------------------------------- n-gram model
PARTS = "SELECT 'name' AS field, p_name AS t FROM part UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'customer', c_name FROM customer"
MODEL = f"""m AS (SELECT field, substr(g, 1, 2) AS context, substr(g, 3, 1) AS next, cast(count(*) AS bigint) AS n FROM (
    SELECT field, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g FROM (SELECT field, '^^' || trim(t) || '$' AS p FROM ({PARTS}) WHERE trim(t) <> '')) GROUP BY 1, 2, 3),
  dist AS (SELECT *, sum(p) OVER (PARTITION BY field, context ORDER BY next ROWS UNBOUNDED PRECEDING) AS cumulative FROM (
    SELECT field, context, next, n, pw / sum(pw) OVER (PARTITION BY field, context) AS p FROM (SELECT *, pow(n / sum(n) OVER (PARTITION BY field, context)::double, 1.0::double / 0.8::double) AS pw FROM m)))"""


def names(spark, folder):
    part = derived.table(spark, folder, "part")
    return part.selectExpr("'name' as field", "p_name as t").unionByName(part.selectExpr("'type' as field", "p_type as t")) \
        .unionByName(derived.table(spark, folder, "customer").selectExpr("'customer' as field", "c_name as t"))


def name_model(spark, folder):
    return ngram.model(names(spark, folder), "field", "t")


@query("a29_ngram_model", f"WITH {MODEL} SELECT * FROM m")
def a29(spark, folder):
    return name_model(spark, folder)


def trigrams(key, table):
    chars = f"list_filter(string_split(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g'), ''), lambda x: x <> '')"
    return (f"SELECT {key}, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM "
            f"(SELECT {key}, list_concat(['^', '^'], {chars}, ['$']) AS c FROM {table}) WHERE len(c) > 3")



@query("a29_document_model", f"SELECT lang AS field, substr(g, 1, 2) AS context, substr(g, 3, 1) AS next, cast(count(*) AS bigint) AS n FROM ({trigrams('lang', 'documents')}) GROUP BY 1, 2, 3")
def a29b(spark, folder):
    return ngram.model(docs(spark, folder), "lang", "text")


@query("w17_next_char_distribution", f"WITH {MODEL} SELECT field, context, next, n, round(p, 6) AS p, round(cumulative, 6) AS cumulative FROM dist")
def w17(spark, folder):
    return ngram.distribution(name_model(spark, folder)).select(
        "field", "context", "next", "n", F.round("p", 6).alias("p"), F.round("cumulative", 6).alias("cumulative"))


@query("t8_sampling_cuts", f"""WITH {MODEL}, k AS (SELECT field, context, next, p FROM (SELECT *, rank() OVER (PARTITION BY field, context ORDER BY p DESC) AS r FROM dist) WHERE r <= 3),
  q AS (SELECT *, round(sum(p) OVER (PARTITION BY field, context ORDER BY p DESC, next ROWS UNBOUNDED PRECEDING) - p, 9) AS before FROM dist),
  s AS (SELECT field, context, next, p / sum(p) OVER (PARTITION BY field, context) AS p FROM q WHERE before <= 0.9)
  SELECT 'top_k' AS cut, field, context, next, round(p, 6) AS p FROM k UNION ALL SELECT 'top_p', field, context, next, round(p, 6) FROM s""")
def t8(spark, folder):
    dist = ngram.distribution(name_model(spark, folder))
    cols = ["field", "context", "next", F.round("p", 6).alias("p")]
    top = ngram.top_k_cut(dist, 3).select(F.lit("top_k").alias("cut"), *cols)
    return top.unionByName(ngram.nucleus_cut(dist, 0.9).select(F.lit("top_p").alias("cut"), *cols))


@query("t8_repetition_penalty", f"""WITH {MODEL}, e AS (SELECT field, context, next, exp(ln(p) / CASE WHEN contains(context, next) THEN 1.2::double ELSE 1.0::double END) AS e FROM dist)
  SELECT field, context, next, round(e / sum(e) OVER (PARTITION BY field, context), 6) AS p FROM e""")
def t8b(spark, folder):
    dist = ngram.distribution(name_model(spark, folder))
    return ngram.repetition_penalty(dist, F.contains("context", "next"), 1.2).select("field", "context", "next", F.round("p", 6).alias("p"))


LOOKUP = f"""bm AS (SELECT g, count(*) AS n FROM ({trigrams('item_id', 'benchmark')}) GROUP BY 1),
  pr AS (SELECT g, n / sum(n) OVER (PARTITION BY substr(g, 1, 2))::double AS p FROM bm),
  t AS (SELECT doc_id, g, cast(count(*) AS bigint) AS n FROM ({trigrams('doc_id', 'documents')}) GROUP BY 1, 2),
  lk AS (SELECT doc_id, g, n, coalesce(p, 1e-6::double) AS p FROM t LEFT JOIN pr USING (g))"""


def looked(spark, folder):
    trained = ngram.model(bench(spark, folder).withColumn("field", F.lit("all")), "field", "text")
    return ngram.lookup(docs(spark, folder), trained, "doc_id", "text")


@query("j14_model_lookup", f"WITH {LOOKUP} SELECT doc_id, cast(count(*) AS bigint) AS grams, cast(sum(n) AS bigint) AS n, cast(count(*) FILTER (WHERE p = 1e-6::double) AS bigint) AS unseen FROM lk GROUP BY 1")
def j14(spark, folder):
    return looked(spark, folder).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("grams"), F.sum("n").alias("n"), F.count_if(F.col("p") == 1e-6).alias("unseen"))


@query("a36_model_loss", f"""WITH {LOOKUP}, s AS (SELECT doc_id, sum(-ln(p) * n) AS nll, sum(n) AS n FROM lk GROUP BY 1)
  SELECT doc_id, cast(n AS bigint) AS n_tokens, round(nll / n, 4) AS loss, round(exp(least(nll / n, 20.0::double)), 2) AS ppl, round(nll / n / ln(2.0::double), 4) AS bpt FROM s""")
def a36(spark, folder):
    return ngram.loss(looked(spark, folder), ["doc_id"]).select(
        "doc_id", "n_tokens", F.round("loss", 4).alias("loss"), F.round("ppl", 2).alias("ppl"), F.round("bpt", 4).alias("bpt"))


@query("g16_ngram_text", None)
def g16(spark, folder):
    rows = derived.table(spark, folder, "customer").selectExpr("c_custkey", "if(c_custkey % 2 = 0, 'name', 'type') as field")
    return ngram.generate_text(rows, "c_custkey", "field", name_model(spark, folder), 22)


# ------------------------------------------------------------------------------------------------------ tokenizers
VOCAB = "v AS (SELECT ch, cast(row_number() OVER (ORDER BY ch) - 1 + 4 AS int) AS id FROM (SELECT DISTINCT unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS ch FROM {table}))"


@query("a33_char_vocabulary", f"WITH {VOCAB.format(table='documents')} SELECT * FROM v")
def a33(spark, folder):
    return ngram.char_vocabulary(docs(spark, folder), "text")


ENC = f"""{VOCAB.format(table='benchmark')}, c AS (SELECT doc_id, unnest({CHARS}) AS ch, unnest(range(1, len({CHARS}) + 1)) AS i FROM documents),
  ids AS (SELECT doc_id, list(coalesce(id, 3) ORDER BY i) AS ids, string_agg(CASE WHEN id IS NULL THEN '<UNK>' ELSE v.ch END, '' ORDER BY i) AS decoded FROM c LEFT JOIN v USING (ch) GROUP BY 1)"""


def encoded(spark, folder):
    vocabulary = ngram.char_vocabulary(bench(spark, folder), "text")
    return ngram.encode(spread(docs(spark, folder).select("doc_id", "text")), "text", vocabulary)


@query("x18_char_encode", f"WITH {ENC} SELECT doc_id, ids, decoded FROM ids")
def x18(spark, folder):
    vocabulary = ngram.char_vocabulary(bench(spark, folder), "text")
    return ngram.decode(encoded(spark, folder).drop("text"), vocabulary).filter(F.size("ids") > 0).select("doc_id", "ids", "decoded")


@query("a32_vocabulary_coverage", f"""WITH {ENC} SELECT doc_id, cast(coalesce(len(list_filter(ids, lambda x: x = 3)), 0) AS bigint) AS unk_count, cast(coalesce(len(ids), 0) AS bigint) AS n_tokens,
  round(1 - coalesce(len(list_filter(ids, lambda x: x = 3)), 0) / greatest(coalesce(len(ids), 0), 1)::double, 6) AS coverage FROM documents LEFT JOIN ids USING (doc_id)""")
def a32(spark, folder):
    return ngram.coverage(encoded(spark, folder), "doc_id")


@query("w18_training_windows", f"""WITH {ENC}, w AS (SELECT doc_id, ids, unnest(range(0, len(ids) - 128, 64)) AS st FROM ids WHERE len(ids) > 128)
  SELECT doc_id, cast(st AS int) AS start, md5(array_to_string(ids[st + 1:st + 128], ',')) AS x, md5(array_to_string(ids[st + 2:st + 129], ',')) AS y FROM w""")
def w18(spark, folder):
    found = ngram.windows(encoded(spark, folder), "doc_id", 128, 64)
    return found.select("doc_id", "start", F.md5(F.array_join("x", ",")).alias("x"), F.md5(F.array_join("y", ",")).alias("y"))


def _stream_sql(table, key, length, stride):
    """Windows of the concatenated stream, from the one list of all ids."""
    return f"""WITH {VOCAB.format(table='benchmark')}, c AS (SELECT {key} AS k, unnest({CHARS}) AS ch, unnest(range(1, len({CHARS}) + 1)) AS i FROM {table}),
  t AS (SELECT list(coalesce(id, 3) ORDER BY k, i) AS ids FROM c LEFT JOIN v USING (ch)), w AS (SELECT ids, unnest(range(0, len(ids) - {length}, {stride})) AS st FROM t)
  SELECT cast(st AS bigint) AS start, md5(array_to_string(ids[st + 1:st + {length}], ',')) AS x, md5(array_to_string(ids[st + 2:st + {length} + 1], ',')) AS y FROM w"""


def _stream(ids, key, length, stride):
    found = ngram.stream_windows(ids, key, length, stride)
    return found.select("start", F.md5(F.array_join("x", ",")).alias("x"), F.md5(F.array_join("y", ",")).alias("y"))


@query("w18_stream_windows", f"""WITH {VOCAB.format(table='benchmark')}, c AS (SELECT doc_id AS k, unnest({CHARS}) AS ch, unnest(range(1, len({CHARS}) + 1)) AS i FROM documents),
  s AS (SELECT coalesce(id, 3) AS id, row_number() OVER (ORDER BY k, i) - 1 AS p FROM c LEFT JOIN v USING (ch)),
  xs AS (SELECT p // 64 * 64 AS start, md5(string_agg(id, ',' ORDER BY p)) AS x FROM s GROUP BY 1), ys AS (SELECT (p - 1) // 64 * 64 AS start, md5(string_agg(id, ',' ORDER BY p)) AS y FROM s WHERE p > 0 GROUP BY 1)
  SELECT cast(start AS bigint) AS start, x, y FROM xs JOIN ys USING (start) WHERE start + 64 < (SELECT count(*) FROM s)""")
def w18b(spark, folder):
    """Windows of the stream of all documents."""
    return _stream(encoded(spark, folder), "doc_id", 64, 64)


@query("w18_every_window", _stream_sql("benchmark", "item_id", 32, 1))
def w18c(spark, folder):
    """Every window of the stream of all benchmark passages, one token apart."""
    texts = bench(spark, folder)
    return _stream(ngram.encode(texts.select("item_id", "text"), "text", ngram.char_vocabulary(texts, "text")), "item_id", 32, 1)


PAIRS = f"""wf AS (SELECT w, count(*) AS freq FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY 1),
  sy AS (SELECT freq, list_append(list_filter(string_split(w, ''), lambda c: c <> ''), '</w>') AS s FROM wf),
  pr AS (SELECT freq, s[i] AS l, s[i + 1] AS r FROM (SELECT freq, s, unnest(range(1, len(s))) AS i FROM sy))"""


@query("a34_pair_counts", f'WITH {PAIRS} SELECT l AS "left", r AS "right", cast(sum(freq) AS bigint) AS n FROM pr GROUP BY 1, 2')
def a34(spark, folder):
    return bpe.pair_counts(bpe.segmented(bpe.word_frequencies(docs(spark, folder), "text")))


#: Entries of the learned vocabulary.
BPE_VOCABULARY = 1000


def _bpe(spark, folder):
    """Merges of the whole document table, learned once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LEARNED:
        _LEARNED[key] = bpe.learn(docs(spark, folder), "text", vocab_size=BPE_VOCABULARY)
    return _LEARNED[key]


_LEARNED = {}


@query("a35_bpe_merges", None)
def a35(spark, folder):
    merges, vocabulary = _bpe(spark, folder)
    rows = [(i, a, b, vocabulary[a + b]) for i, (a, b) in enumerate(merges)]
    return spark.createDataFrame(rows, "step int, left string, right string, id int")


@query("x19_bpe_encode", None)
def x19(spark, folder):
    merges, vocabulary = _bpe(spark, folder)
    ids = bpe.encode(docs(spark, folder).select("doc_id", "text"), "text", merges, vocabulary)
    return bpe.decode(ids, vocabulary).select("doc_id", "ids", "decoded")


# ------------------------------------------------------------------------------------------------------ composites
#: Line bounds and copies of a prepared corpus.
PREPARED = {"min_line_len": 20, "max_line_len": 2000, "factor": 2}


@query("c8_prepare_corpus", None)
def c8(spark, folder):
    """Cleaned, line-bounded, deduplicated and augmented corpus with splits."""
    return corpus.prepare(spread(docs(spark, folder).select("doc_id", "text")), **PREPARED)


@query("c8_corpus_summary", None)
def c8b(spark, folder):
    """Statistics of the prepared corpus per split and kind of text, next to the lines and characters of the split files as written."""
    path = scratch_path(spark, "corpus-splits")
    ready = corpus.prepare(spread(docs(spark, folder).select("doc_id", "text")), path, **PREPARED)
    back = spark.read.option("lineSep", "\n").text(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("file_lines"), F.sum(F.length("value").cast("bigint")).alias("file_chars"))
    return corpus.summary(ready, ["split", "kind"]).join(back, "split", "left")


@query("c9_token_windows", None)
def c9(spark, folder):
    """BPE ids of the cleaned documents as training windows over the token stream of each split."""
    clean = corpus.split_by_hash(corpus.cleaned(spread(docs(spark, folder).select("doc_id", "text"))))
    found = ngram.stream_windows(bpe.encode(clean, "text", *_bpe(spark, folder)), "doc_id", 256, 256, ["split"])
    return found.select("split", "start", "x", "y")


@query("c10_text_metrics", None)
def c10(spark, folder):
    """Per document: loss of the reference model, coverage, diversity, repetition, profile overlap."""
    out = ngram.bits_per_char(ngram.loss(looked(spark, folder), ["doc_id"]), docs(spark, folder), "doc_id", "text")
    for part in (ngram.coverage(encoded(spark, folder), "doc_id").select("doc_id", "coverage"), a30(spark, folder).select("doc_id", "distinct_n"),
                 a30b(spark, folder), a26(spark, folder)):
        out = out.join(part, "doc_id", "left")
    return out
