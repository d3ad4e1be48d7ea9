"""Queries: record structure, format identification, spec documents, naming functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import fixed
from tallyframe.operators import identify, specdoc, structure
from tallyframe.plans import shared
from tallyframe.plans.registry import query
from tallyframe.plans.shared import LINES, _lit
from tallyframe.session import spread
from tallyframe.sources import derived, layouts
from tallyframe.sources.layouts import ACH

ORDERING = ["1", "5", "6", "7", "8", "9"]
SEQ = f"""WITH {LINES}, seq AS (SELECT file_id, line_no, substr(line, 1, 1) AS record_type FROM lines
  WHERE line <> repeat('9', 94) AND substr(line, 1, 1) IN ('1', '5', '6', '7', '8', '9'))"""


def seq(spark, folder):
    return structure.sequence(shared.raw(spark, folder), ACH.record_types)


@query("w1_successor", SEQ + " SELECT file_id, line_no, record_type, lead(record_type) OVER (PARTITION BY file_id ORDER BY line_no) AS next_type FROM seq")
def w1(spark, folder):
    return structure.successors(seq(spark, folder)).select("file_id", "line_no", "record_type", "next_type")


@query("a19_type_frequency", SEQ + " SELECT file_id, record_type, cast(count(*) AS bigint) AS n, min(line_no) AS first_line, count(*) > 1 AS repeating FROM seq GROUP BY 1, 2")
def a19(spark, folder):
    return structure.frequencies(seq(spark, folder))


MATRIX = SEQ + """, nx AS (SELECT *, lead(record_type) OVER (PARTITION BY file_id ORDER BY line_no) AS t FROM seq),
  matrix AS (SELECT file_id, record_type AS from_type, t AS to_type, cast(count(*) AS bigint) AS n, min(line_no) AS first_line FROM nx WHERE t IS NOT NULL GROUP BY 1, 2, 3)"""


@query("a20_transition_matrix", MATRIX + " SELECT * FROM matrix")
def a20(spark, folder):
    return structure.transition_matrix(seq(spark, folder))


START = """, st AS (SELECT file_id, first(record_type ORDER BY n DESC, f) AS start_type FROM (
    SELECT file_id, record_type, count(*) AS n, min(line_no) AS f FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rn,
      count(*) OVER (PARTITION BY file_id) AS c FROM seq) WHERE rn <= greatest(1, c // 10) GROUP BY 1, 2) GROUP BY 1)"""


@query("a21_start_type", SEQ + START + " SELECT * FROM st")
def a21(spark, folder):
    return structure.start_types(seq(spark, folder))


@query("w12_inferred_ordering", MATRIX.replace("WITH ", "WITH RECURSIVE ", 1) + START + """, tn AS (SELECT file_id, record_type, count(*) AS c FROM seq GROUP BY 1, 2),
  walk(file_id, node, path) AS (SELECT file_id, start_type, [start_type] FROM st
    UNION ALL SELECT w.file_id, (SELECT first(m.to_type ORDER BY m.n DESC, m.first_line) FROM matrix m WHERE m.file_id = w.file_id AND m.from_type = w.node AND NOT list_contains(w.path, m.to_type)) AS nxt,
      list_append(w.path, (SELECT first(m.to_type ORDER BY m.n DESC, m.first_line) FROM matrix m WHERE m.file_id = w.file_id AND m.from_type = w.node AND NOT list_contains(w.path, m.to_type)))
    FROM walk w WHERE w.node IS NOT NULL AND EXISTS (SELECT 1 FROM matrix m WHERE m.file_id = w.file_id AND m.from_type = w.node AND NOT list_contains(w.path, m.to_type))),
  best AS (SELECT file_id, max_by(path, len(path)) AS path FROM walk GROUP BY 1)
  SELECT t.file_id, t.record_type, cast(CASE WHEN list_contains(path, t.record_type) THEN list_position(path, t.record_type) - 1
      ELSE len(path) + (SELECT count(*) FROM tn o WHERE o.file_id = t.file_id AND NOT list_contains(path, o.record_type) AND (o.c > t.c OR (o.c = t.c AND o.record_type < t.record_type))) END AS int) AS position
  FROM tn t JOIN best USING (file_id)""")
def w12(spark, folder):
    return structure.inferred_ordering(seq(spark, folder))


@query("w11_batch_pattern", SEQ + """, o AS (SELECT file_id, min(line_no) AS a FROM seq WHERE record_type = '5' GROUP BY 1),
  c AS (SELECT s.file_id, a, min(line_no) AS b FROM seq s JOIN o USING (file_id) WHERE record_type = '8' AND line_no >= a GROUP BY 1, 2),
  f AS (SELECT s.file_id, record_type, min(line_no) AS l FROM seq s JOIN c USING (file_id) WHERE line_no BETWEEN a AND b GROUP BY 1, 2)
  SELECT file_id, string_agg(record_type, ',' ORDER BY l) AS pattern FROM f GROUP BY 1""")
def w11(spark, folder):
    return structure.batch_pattern(seq(spark, folder), "5", "8")


LAGGED = SEQ + """, lg AS (SELECT file_id, line_no, record_type, list_position(['1', '5', '6', '7', '8', '9'], record_type) AS p,
    lag(list_position(['1', '5', '6', '7', '8', '9'], record_type)) OVER (PARTITION BY file_id ORDER BY line_no) AS q FROM seq)"""


@query("w5_out_of_order", LAGGED + " SELECT file_id, line_no, record_type FROM lg WHERE p < q AND record_type <> '5'")
def w5(spark, folder):
    return structure.out_of_order(seq(spark, folder), ORDERING, restart="5").select("file_id", "line_no", "record_type")


@query("w5_out_of_order_compat", LAGGED + " SELECT file_id, line_no, record_type FROM lg WHERE p < q")
def w5b(spark, folder):
    return structure.out_of_order(seq(spark, folder), ORDERING).select("file_id", "line_no", "record_type")


@query("w6_repeated_headers", SEQ + " SELECT file_id, record_type, cast(count(*) AS bigint) AS n FROM seq WHERE record_type IN ('1', '5') GROUP BY 1, 2 HAVING count(*) > 1")
def w6(spark, folder):
    return structure.repeated_headers(seq(spark, folder), ["1", "5"])


@query("c4_detect_structure", None)
def c4(spark, folder):
    """Per file: inferred ordering, batch pattern, repeating types and anomaly counts."""
    s = seq(spark, folder)
    order = structure.inferred_ordering(s).groupBy("file_id").agg(F.expr(
        "array_join(transform(sort_array(collect_list(struct(position, record_type))), x -> x.record_type), ',') as ordering"))
    repeating = structure.frequencies(s).filter("repeating").groupBy("file_id").agg(
        F.array_join(F.sort_array(F.collect_list("record_type")), ",").alias("repeating"))
    wrong = structure.out_of_order(s, ORDERING, "5").groupBy("file_id").agg(F.count(F.lit(1)).alias("out_of_order"))
    return order.join(structure.batch_pattern(s, "5", "8"), "file_id", "left").join(repeating, "file_id", "left") \
        .join(wrong, "file_id", "left").fillna({"out_of_order": 0})


# ---------------------------------------------------------------------------------------------- identification
def spec_terms_sql():
    rows = []
    for s in layouts.BUILT_IN.values():
        for f in s.fields:
            rows += [(s.name, f.name, 2), (s.name, f.data_type, 1)]
        rows += [(s.name, w, 1) for w in s.description.lower().replace("-", " ").split()]
    values = ", ".join(f"({_lit(a)}, {_lit(b)}, {c})" for a, b, c in rows)
    return f"raw_terms(spec, term, w) AS (VALUES {values}), sterms AS (SELECT spec, term, cast(sum(w) AS bigint) AS weight FROM raw_terms GROUP BY 1, 2)"


PAGE_TERMS = f"""WITH {spec_terms_sql()}, tc AS (SELECT page_id, term, cast(count(*) AS bigint) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM pages) GROUP BY 1, 2),
  tn AS (SELECT page_id, sqrt(sum(n * n)::double) AS tn FROM tc GROUP BY 1), sn AS (SELECT spec, sqrt(sum(weight * weight)::double) AS sn FROM sterms GROUP BY 1),
  sim AS (SELECT page_id, spec, round(dot / (tn * sn), 6) AS score FROM (SELECT page_id, spec, sum(n * weight)::double AS dot FROM tc JOIN sterms USING (term) GROUP BY 1, 2) JOIN tn USING (page_id) JOIN sn USING (spec))"""


@query("j10_format_scores", PAGE_TERMS + " SELECT * FROM sim")
def j10(spark, folder):
    counts = identify.term_counts(derived.table(spark, folder, "pages"), "page_id", "html")
    return identify.similarity(counts, "page_id", identify.spec_terms(spark))


@query("t1_top_formats", PAGE_TERMS + """, r AS (SELECT page_id, s.spec, coalesce(score, 0) AS score, cast(row_number() OVER (PARTITION BY page_id ORDER BY coalesce(score, 0) DESC, s.spec) AS int) AS rank
    FROM pages CROSS JOIN (SELECT DISTINCT spec FROM sterms) s LEFT JOIN sim USING (page_id, spec)) SELECT * FROM r WHERE rank <= 3""")
def t1(spark, folder):
    return identify.identify(derived.table(spark, folder, "pages"), "page_id", "html")


@query("c5_identify_files", f"""WITH {spec_terms_sql()}, {LINES}, {shared.GL_LINES}, {shared.CARD_LINES}, tx AS (SELECT file_id, line FROM lines UNION ALL SELECT file_id, line FROM gl_lines UNION ALL SELECT file_id, line FROM card_lines),
  tc AS (SELECT file_id, term, count(*) AS n FROM (SELECT file_id, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM tx) GROUP BY 1, 2),
  tn AS (SELECT file_id, sqrt(sum(n * n)::double) AS tn FROM tc GROUP BY 1), sn AS (SELECT spec, sqrt(sum(weight * weight)::double) AS sn FROM sterms GROUP BY 1),
  sim AS (SELECT file_id, spec, round(dot / (tn * sn), 6) AS score FROM (SELECT file_id, spec, sum(n * weight)::double AS dot FROM tc JOIN sterms USING (term) GROUP BY 1, 2) JOIN tn USING (file_id) JOIN sn USING (spec)),
  r AS (SELECT file_id, s.spec, coalesce(score, 0) AS score, cast(row_number() OVER (PARTITION BY file_id ORDER BY coalesce(score, 0) DESC, s.spec) AS int) AS rank
    FROM (SELECT DISTINCT file_id FROM tx) CROSS JOIN (SELECT DISTINCT spec FROM sterms) s LEFT JOIN sim USING (file_id, spec)) SELECT * FROM r WHERE rank <= 3""")
def c5(spark, folder):
    """Best three formats of every derived file, scored on its lines as text (terms are counted, never concatenated)."""
    texts = shared.raw(spark, folder).unionByName(shared.gl_lines(spark, folder)).unionByName(shared.card_lines(spark, folder))
    return identify.identify(texts, "file_id", "line")


@query("a24_vocabulary", """SELECT word, cast(count(*) AS bigint) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z_]+')) AS word FROM documents)
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200""")
def a24(spark, folder):
    return identify.vocabulary(derived.table(spark, folder, "documents"), "text")


@query("a25_spec_term_weights", PAGE_TERMS + """ SELECT spec, term, weight, cast(count(page_id) AS bigint) AS pages FROM sterms LEFT JOIN tc USING (term) GROUP BY 1, 2, 3""")
def a25(spark, folder):
    counts = identify.term_counts(derived.table(spark, folder, "pages"), "page_id", "html")
    pages = identify.spec_terms(spark).join(counts, "term", "left")
    return pages.groupBy("spec", "term", "weight").agg(F.count("page_id").alias("pages"))


# ---------------------------------------------------------------------------------------------- spec documents
DOC_S = """case p_size % 4
    when 0 then concat(p_name, '  ', cast(p_partkey + 1 as string), '-', cast(p_partkey + p_size as string), '  ', cast(p_size as string), '  AN  Required  values: A,B/C')
    when 1 then concat(cast(p_partkey + 1 as string), '  ', p_type, ' ', p_name, '  ', cast(p_size as string), '  N  Optional range: 1-', cast(p_size as string))
    when 2 then concat(p_type, '_', cast(p_partkey as string), ': the ', p_name, ' amount')
    else concat('# ', p_name) end"""
DOC_D = """CASE p_size % 4
    WHEN 0 THEN p_name || '  ' || (p_partkey + 1) || '-' || (p_partkey + p_size) || '  ' || p_size || '  AN  Required  values: A,B/C'
    WHEN 1 THEN (p_partkey + 1) || '  ' || p_type || ' ' || p_name || '  ' || p_size || '  N  Optional range: 1-' || p_size
    WHEN 2 THEN p_type || '_' || p_partkey || ': the ' || p_name || ' amount' ELSE '# ' || p_name END"""


def spec_lines(spark, folder):
    return spread(derived.table(spark, folder, "part")).selectExpr("p_brand as spec", "p_partkey as line_no", f"{DOC_S} as line")


DOC_SQL = f"""WITH d AS (SELECT p_brand AS spec, p_partkey AS line_no, trim({DOC_D}) AS raw FROM part),
  tok AS (SELECT *, CASE WHEN regexp_matches(lower(raw), '\\b(numeric|num|n)\\b') THEN 'numeric' WHEN regexp_matches(lower(raw), '\\b(alpha|alphanumeric|an|a)\\b') THEN 'alphanumeric'
      WHEN regexp_matches(lower(raw), '\\b(date)\\b') THEN 'date' WHEN regexp_matches(lower(raw), '\\b(amount|amt)\\b') THEN 'amount' ELSE 'alphanumeric' END AS data_type FROM d WHERE raw NOT LIKE '#%'),
  sh AS (SELECT *, CASE WHEN regexp_matches(raw, '[0-9]-[0-9]+  [0-9]+  AN') THEN 1 WHEN regexp_matches(raw, '^[0-9]+  ') THEN 2 ELSE 3 END AS shape FROM tok),
  fl AS (SELECT spec, line_no AS source_line, upper(regexp_replace(trim(CASE shape WHEN 1 THEN regexp_extract(raw, '^(.+?)  [0-9]', 1) WHEN 2 THEN regexp_extract(raw, '^[0-9]+  (.+?)  [0-9]', 1) ELSE regexp_extract(raw, '^(.+?):', 1) END), '\\s+', '_', 'g')) AS name,
    CASE shape WHEN 1 THEN cast(regexp_extract(raw, '([0-9]+)-[0-9]+  ', 1) AS int) WHEN 2 THEN cast(regexp_extract(raw, '^([0-9]+)', 1) AS int) END AS start,
    CASE shape WHEN 1 THEN cast(regexp_extract(raw, '[0-9]+-([0-9]+)  ', 1) AS int) WHEN 2 THEN cast(regexp_extract(raw, '^([0-9]+)', 1) AS int) + cast(regexp_extract(raw, '  ([0-9]+)  N', 1) AS int) - 1 END AS "end",
    CASE shape WHEN 1 THEN cast(regexp_extract(raw, '  ([0-9]+)  AN', 1) AS int) WHEN 2 THEN cast(regexp_extract(raw, '  ([0-9]+)  N', 1) AS int) ELSE 12 END AS length,
    CASE shape WHEN 1 THEN 'alphanumeric' WHEN 2 THEN 'numeric' ELSE 'amount' END AS data_type, shape <> 2 AS required,
    CASE shape WHEN 2 THEN 1 END AS min_value, CASE shape WHEN 2 THEN cast(regexp_extract(raw, 'range: 1-([0-9]+)', 1) AS bigint) END AS max_value,
    CASE shape WHEN 1 THEN 'A,B,C' END AS allowed,
    CASE WHEN shape <> 3 THEN nullif(regexp_extract(raw, '(?i)format[\\s:]+([YMD0-9X]+)', 1), '') END AS format FROM sh)"""


@query("x8_spec_tokens", DOC_SQL + """ SELECT spec, line_no, data_type, cast(len(regexp_extract_all(raw, '[A-Za-z_]+')) AS int) AS words, cast(len(regexp_extract_all(raw, '[0-9]+')) AS int) AS numbers FROM tok""")
def x8(spark, folder):
    return specdoc.tokens(spec_lines(spark, folder)).selectExpr("spec", "line_no", "data_type", "size(words) as words", "size(numbers) as numbers")


@query("f11_field_lines", f"""WITH d AS (SELECT p_brand AS spec, p_partkey AS line_no, trim({DOC_D}) AS raw FROM part) SELECT spec, line_no, raw,
  regexp_matches(raw, '(?i)[a-z0-9_\\s]+?\\s+[0-9]+[-–][0-9]+\\s+[0-9]+\\s+[a-z0-9_]+') OR regexp_matches(raw, '(?i)[0-9]+\\s+[a-z0-9_\\s]+?\\s+[0-9]+\\s+[a-z0-9_]+')
    OR regexp_matches(raw, '(?i)[A-Z][A-Z\\s_]+\\s*[:=]\\s*[^\\n]+') OR (regexp_matches(raw, '[0-9]') AND regexp_matches(raw, '[A-Za-z]{{3,}}') AND length(raw) < 200) AS is_field FROM d WHERE raw NOT LIKE '#%'""")
def f11(spark, folder):
    return specdoc.tokens(spec_lines(spark, folder)).select("spec", "line_no", "raw", "is_field")


FIELDS_SQL = DOC_SQL + " SELECT {cols} FROM fl"


def parsed(spark, folder):
    return specdoc.parsed_fields(specdoc.tokens(spec_lines(spark, folder)))


@query("x9_spec_fields", FIELDS_SQL.format(cols='spec, source_line, name, start, "end", length'))
def x9(spark, folder):
    return parsed(spark, folder).select("spec", "source_line", "name", "start", "end", "length")


@query("x10_type_codes", FIELDS_SQL.format(cols="spec, source_line, data_type"))
def x10(spark, folder):
    return parsed(spark, folder).select("spec", "source_line", "data_type")


@query("x11_required_wording", FIELDS_SQL.format(cols="spec, source_line, required"))
def x11(spark, folder):
    return parsed(spark, folder).select("spec", "source_line", "required")


@query("x12_rule_wording", FIELDS_SQL.format(cols="spec, source_line, cast(min_value AS bigint) AS min_value, max_value, allowed"))
def x12(spark, folder):
    return parsed(spark, folder).select("spec", "source_line", "rules.min_value", "rules.max_value", "rules.allowed")


@query("x13_guessed_length", """WITH d AS (SELECT doc_id, text FROM documents) SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(text, '[0-9]+', 0), '') AS int),
  CASE WHEN length(text) % 2 = 0 THEN 10 ELSE 20 END) AS guessed FROM d""")
def x13(spark, folder):
    return derived.table(spark, folder, "documents").selectExpr(
        "doc_id", f"{specdoc.guessed_length('text', "if(length(text) % 2 = 0, 'numeric', 'other')")} as guessed")


@query("w15_first_wins", DOC_SQL + """ SELECT spec, name, min(source_line) AS source_line, min_by(length, source_line) AS length FROM fl GROUP BY 1, 2""")
def w15(spark, folder):
    return specdoc.first_wins(parsed(spark, folder)).select("spec", "name", "source_line", "length")


@query("w14_positions", DOC_SQL + """, u AS (SELECT * FROM fl WHERE start IS NULL)
  SELECT spec, name, source_line, cast(sum(length) OVER w - length + 1 AS int) AS start, cast(sum(length) OVER w AS int) AS "end" FROM u WINDOW w AS (PARTITION BY spec ORDER BY source_line)""")
def w14(spark, folder):
    return specdoc.positioned(parsed(spark, folder).filter("start is null")).select("spec", "name", "source_line", "start", "end")


@query("c6_learn_spec_documents", DOC_SQL + """, fw AS (SELECT spec, name, min(source_line) AS source_line FROM fl GROUP BY 1, 2)
  SELECT fl.spec, fl.name, fl.source_line, fl.start, fl."end", fl.length, fl.data_type, fl.required,
    cast(fl.min_value AS bigint) AS min_value, fl.max_value, fl.allowed, fl.format FROM fl JOIN fw USING (spec, name, source_line)""")
def c6(spark, folder):
    """Learned fields with the rules that their lines word."""
    learned = specdoc.learn(spec_lines(spark, folder))
    return learned.select(*[c for c in learned.columns if c != "rules"], "rules.*")


# ---------------------------------------------------------------------------------------------- naming functions
@query("p6_snake_names", """SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[\\s\\-/]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), ''), 'unknown_field') AS name FROM pages""")
def p6(spark, folder):
    return derived.table(spark, folder, "pages").select("page_id", fixed.snake_name(F.col("url")).alias("name"))


@query("p7_spec_names", """SELECT p_partkey, regexp_replace(regexp_replace(upper(trim('-' || p_name || ' ' || p_type || '_ ')), '^[_\\-]+|[_\\-]+$', '', 'g'), '\\s+', '_', 'g') AS name FROM part""")
def p7(spark, folder):
    return derived.table(spark, folder, "part").select("p_partkey", fixed.spec_name(
        F.expr("concat('-', p_name, ' ', p_type, '_ ')")).alias("name"))


@query("p9_masking", """SELECT page_id, regexp_replace('jdbc://app:s3' || page_id || 'cret@' || url, '(:)[^:@]+(@)', '\\1****\\2', 'g') AS masked,
  regexp_replace(url, '[^A-Za-z0-9_.]', '', 'g') AS table_name, regexp_replace(url, '[^A-Za-z0-9_\\-]', '_', 'g') AS spec_name,
  coalesce(nullif(regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '[^\\p{L}\\p{N}\\-_.]', '', 'g'), ''), 'upload.bin') AS file_name FROM pages""")
def p9(spark, folder):
    url = F.col("url")
    return derived.table(spark, folder, "pages").select(
        "page_id", fixed.mask_password(F.expr("concat('jdbc://app:s3', page_id, 'cret@', url)")).alias("masked"),
        fixed.safe_table_name(url).alias("table_name"), fixed.safe_spec_name(url).alias("spec_name"),
        fixed.safe_file_name(url).alias("file_name"))
