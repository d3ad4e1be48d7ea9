"""Queries: column profiles, type votes, learned specs, file-level detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import checks, fixed
from tallyframe.operators import profile
from tallyframe.plans import shared
from tallyframe.plans.registry import query
from tallyframe.plans.shared import LINES, _lit
from tallyframe.sources import derived, layouts

# Columns profiled in the queries: name -> (Spark SQL, DuckDB SQL).
RDFI_S, RDFI_D = "lpad(cast(o_custkey as string), 8, '0')", "lpad(cast(o_custkey AS varchar), 8, '0')"
PAN_S = "concat('4111', lpad(cast(o_orderkey as string), 11, '0'))"
PAN_D = "('4111' || lpad(cast(o_orderkey AS varchar), 11, '0'))"
COLUMNS = {
    "trace_number": ("o_orderkey", "cast(o_orderkey AS varchar)"),
    "customer": ("o_custkey", "cast(o_custkey AS varchar)"),
    "status": ("o_orderstatus", "o_orderstatus"),
    "amount": ("cast(o_totalprice as decimal(18,2))", "cast(cast(o_totalprice AS decimal(18,2)) AS varchar)"),
    "order_date": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "effective_entry_date": ("date_format(o_orderdate, 'yyMMdd')", "strftime(o_orderdate, '%y%m%d')"),
    "posted": ("date_format(o_orderdate, 'yyyyMMdd')", "strftime(o_orderdate, '%Y%m%d')"),
    "priority": ("o_orderpriority", "o_orderpriority"),
    "routing": (f"concat({RDFI_S}, {checks.aba_check_digit(RDFI_S)})", f"{RDFI_D} || cast({shared.aba_sql(RDFI_D)} AS varchar)"),
    "card": (f"concat({PAN_S}, {checks.luhn_check_digit(PAN_S)})", f"{PAN_D} || cast({shared.luhn_sql(PAN_D)} AS varchar)"),
    "is_urgent": ("if(o_orderpriority = '1-URGENT', 'Y', if(o_orderkey % 50 = 0, ' ', 'N'))",
                  "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Y' WHEN o_orderkey % 50 = 0 THEN ' ' ELSE 'N' END"),
    "batch": ("'0001'", "'0001'"),
}
LONG_SQL = ("long AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS field, trim({d}) AS value, o_orderkey AS pos FROM orders" for n, (_, d) in COLUMNS.items()) + """),
counts AS (SELECT field, value, cast(count(*) AS bigint) AS n, min(pos) AS first_pos FROM long WHERE value <> '' GROUP BY 1, 2)""")
NUM_D = f"try_cast(CASE WHEN regexp_full_match(trim(replace(replace(value, ',', ''), '$', '')), {shared.NUM}) THEN trim(replace(replace(value, ',', ''), '$', '')) END AS double)"


def long(spark, folder):
    return profile.unpivot(derived.table(spark, folder, "orders"), {n: s for n, (s, _) in COLUMNS.items()}, "o_orderkey")


def counts(spark, folder):
    return profile.value_counts(long(spark, folder))


def weighted(spark, folder):
    return profile.weighted(long(spark, folder))


A7_SQL = f"""WITH {LONG_SQL}, x AS (SELECT field, value, length(value) AS len, {NUM_D} AS num FROM long WHERE value <> '')
  SELECT field, cast(count(*) AS bigint) AS non_empty, cast(count(DISTINCT value) AS bigint) AS distinct_values, cast(min(len) AS int) AS min_len,
    cast(max(len) AS int) AS max_len, round(avg(len), 6) AS mean_len, round(coalesce(stddev_samp(len), 0), 6) AS stdev_len,
    min(num) AS min_value, max(num) AS max_value FROM x GROUP BY 1"""


@query("a7_column_profile", A7_SQL)
def a7(spark, folder):
    return profile.profile(weighted(spark, folder))


@query("a7_column_profile_in_place", A7_SQL)
def a7b(spark, folder):
    """The same profile with near-unique columns left where they are, as for inputs of many files."""
    return profile.profile(profile.weighted(long(spark, folder), most=1000, in_place=True))


def rates_sql(patterns, flag):
    rows = ", ".join(f"({i}, '{t}', {w}::double, '{p}')" for i, (t, p, w) in enumerate(patterns))
    return f"""pats(pattern_no, type, weight, pattern) AS (VALUES {rows}),
  rates AS (SELECT field, pattern_no, type, weight, sum(CASE WHEN regexp_full_match(value, pattern, '{flag}') THEN 1 ELSE 0 END) / count(*)::double AS rate
    FROM long, pats WHERE value <> '' GROUP BY 1, 2, 3, 4)"""


RATES_SQL = rates_sql(profile.FIELD_PATTERNS, "i")


@query("a8_pattern_rates", f"WITH {LONG_SQL}, {RATES_SQL} SELECT field, cast(pattern_no AS int) AS pattern_no, type, round(rate, 6) AS rate FROM rates")
def a8(spark, folder):
    return profile.pattern_rates(weighted(spark, folder)).select("field", "pattern_no", "type", F.round("rate", 6).alias("rate"))


@query("a8_pattern_rates_sample", f"""WITH {LONG_SQL}, {rates_sql(profile.SAMPLE_PATTERNS, 'c')}
  SELECT field, cast(pattern_no AS int) AS pattern_no, type, round(rate, 6) AS rate FROM rates""")
def a8b(spark, folder):
    return profile.pattern_rates(weighted(spark, folder), profile.SAMPLE_PATTERNS, False).select(
        "field", "pattern_no", "type", F.round("rate", 6).alias("rate"))


LUHN_V = shared.LUHN_OK.replace("(v,", "(value,")
NAME_ROWS = ", ".join(f"({200 + i}, '{t}', {w}::double, '{k}')" for i, (t, w, k) in enumerate(profile.FIELD_NAMES))
SNAME_ROWS = ", ".join(f"({200 + i}, '{t}', {w}::double, '{k}')" for i, (t, w, k) in enumerate(profile.SAMPLE_NAMES))
FACTS = f"""facts AS (SELECT field, sum(n) AS total, count(*) AS card, sum(CASE WHEN {NUM_D} IS NOT NULL THEN n ELSE 0 END) AS numeric_n,
    bool_and(regexp_full_match(replace(replace(replace(value, ',', ''), '.', ''), '-', ''), '[0-9]+')) AS digit_like,
    bool_and(regexp_full_match(value, '[0-9]+')) AS all_digits, min(length(value)) AS lo, max(length(value)) AS hi,
    length(min_by(value, first_pos)) AS first_len,
    sum(CASE WHEN regexp_full_match(value, '[0-9]+') AND {LUHN_V} THEN n ELSE 0 END) AS luhn_n,
    sum(CASE WHEN {shared.aba9('value')} THEN n ELSE 0 END) AS aba_n FROM counts GROUP BY 1)"""
VOTES_SQL = f"""WITH {LONG_SQL}, {RATES_SQL}, {FACTS},
rx AS (SELECT field, type, sum(rate * weight) AS score, min(pattern_no) AS ord FROM rates WHERE rate > 0.5 GROUP BY 1, 2),
st AS (SELECT field, coalesce(max(score) FILTER (WHERE type = 'DATE') >= 2.5, false) AS d, coalesce(max(score) FILTER (WHERE type = 'ROUTING_NUMBER') >= 2.0, false) AS r,
    coalesce(max(score) FILTER (WHERE type = 'PAN') >= 1.0, false) AS p FROM rx GROUP BY 1),
names(ord, type, w, k) AS (VALUES {NAME_ROWS}),
votes AS (
  SELECT field, 'regex' AS strategy, type, score, ord FROM rx JOIN st USING (field) WHERE NOT (d AND type IN ('NUMERIC', 'AMOUNT'))
    AND NOT (r AND type IN ('ACCOUNT_NUMBER', 'NUMERIC')) AND NOT (p AND type IN ('ACCOUNT_NUMBER', 'NUMERIC'))
  UNION ALL SELECT field, 'statistics', 'NUMERIC', numeric_n / total::double * 0.8, 100 FROM facts WHERE numeric_n / total::double > 0.9 AND digit_like
  UNION ALL SELECT field, 'statistics', 'ENUM', 1.2 * 0.8, 101 FROM facts WHERE card BETWEEN 2 AND 25 AND card / total::double < 0.25
  UNION ALL SELECT field, 'statistics', 'ROUTING_NUMBER', 0.5 * 0.8, 102 FROM facts WHERE lo = hi AND lo = 9
  UNION ALL SELECT field, 'statistics', 'PAN', 0.5 * 0.8, 103 FROM facts WHERE lo = hi AND lo BETWEEN 13 AND 19
  UNION ALL SELECT field, 'statistics', 'EXPIRY', 0.3 * 0.8, 104 FROM facts WHERE lo = hi AND lo = 4
  UNION ALL SELECT field, 'name', type, w * 0.6, ord FROM facts, names WHERE regexp_matches(lower(field), k)
  UNION ALL SELECT field, 'checksum', 'PAN', luhn_n / total::double * 2 * 1.5, 300 FROM facts WHERE all_digits AND first_len BETWEEN 13 AND 19 AND luhn_n / total::double > 0.8
  UNION ALL SELECT field, 'checksum', 'ROUTING_NUMBER', aba_n / total::double * 2 * 1.5, 301 FROM facts WHERE all_digits AND first_len = 9 AND aba_n / total::double > 0.8)"""
WIN_SQL = """, pt AS (SELECT field, type, round(sum(score), 9) AS score, min(ord) AS ord FROM votes GROUP BY 1, 2),
win AS (SELECT field, first(type ORDER BY score DESC, ord) AS type, round(least(max(score) / sum(score), 1.0::double), 6) AS confidence FROM pt GROUP BY 1)"""


def strategy(spark, folder, name):
    return profile.field_votes(weighted(spark, folder)).filter(F.col("strategy") == name).select(
        "field", "type", F.round("score", 6).alias("score"))


def strategy_sql(name):
    return VOTES_SQL + f" SELECT field, type, round(score::double, 6) AS score FROM votes WHERE strategy = '{name}'"


@query("a9_statistical_votes", strategy_sql("statistics"))
def a9(spark, folder):
    return strategy(spark, folder, "statistics")


@query("a10_name_votes", strategy_sql("name"))
def a10(spark, folder):
    return strategy(spark, folder, "name")


@query("a11_checksum_votes", strategy_sql("checksum"))
def a11(spark, folder):
    return strategy(spark, folder, "checksum")


@query("a12_type_winner", VOTES_SQL + WIN_SQL + " SELECT * FROM win")
def a12(spark, folder):
    return profile.winners(profile.field_votes(weighted(spark, folder)))


@query("a12_type_winner_sample", f"""WITH {LONG_SQL}, {rates_sql(profile.SAMPLE_PATTERNS, 'c')}, {FACTS}, names(ord, type, w, k) AS (VALUES {SNAME_ROWS}),
rx AS (SELECT field, type, sum(rate * weight) AS score, min(pattern_no) AS ord FROM rates WHERE rate > 0 GROUP BY 1, 2),
cand AS (SELECT field, type, score, ord FROM rx UNION ALL SELECT field, type, w, ord FROM facts, names WHERE regexp_matches(lower(field), k)),
votes AS (SELECT * FROM cand
  UNION ALL SELECT field, 'PAN', 2.0, 300 FROM (SELECT field, sum(CASE WHEN {LUHN_V} THEN n ELSE 0 END) / sum(n)::double AS rate FROM counts
    WHERE field IN (SELECT field FROM cand WHERE type = 'PAN') GROUP BY 1) WHERE rate > 0.8
  UNION ALL SELECT field, 'ENUM', 1.5, 400 FROM facts WHERE card BETWEEN 2 AND 20 AND card / total::double < 0.3)""" + WIN_SQL + " SELECT * FROM win")
def a12b(spark, folder):
    return profile.winners(profile.sample_votes(weighted(spark, folder)))


@query("a13_json_type_ladder", f"""WITH {LONG_SQL} SELECT field, CASE WHEN bool_and(regexp_full_match(value, '-?[0-9]+')) THEN 'NUMERIC'
    WHEN bool_and(regexp_full_match(value, '-?[0-9]+([.][0-9]+)?')) THEN 'AMOUNT' WHEN bool_and(regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) THEN 'DATE'
    WHEN bool_and(lower(value) IN ('true', 'false', '0', '1', 'yes', 'no')) THEN 'BOOLEAN'
    WHEN count(DISTINCT value) <= 10 OR (count(DISTINCT value) / count(*)::double < 0.4 AND count(DISTINCT value) <= 20) THEN 'ENUM' ELSE 'STRING' END AS type
  FROM long WHERE value <> '' GROUP BY 1""")
def a13(spark, folder):
    return profile.json_ladder(weighted(spark, folder))


STRICT_SQL = f"""WITH {LONG_SQL}, k AS (SELECT field, CASE WHEN count(*) = 1 THEN 'FIXED'
    WHEN bool_and(regexp_full_match(value, '[0-9]{{8}}')) THEN CASE WHEN bool_and(try_cast(substr(value, 1, 4) AS int) BETWEEN 1900 AND 2100) THEN 'DATE_YYYYMMDD' ELSE 'NUMERIC' END
    WHEN bool_and(regexp_full_match(value, '[0-9]{{6}}')) THEN 'DATE_YYMMDD'
    WHEN bool_and(regexp_full_match(value, '[0-9]{{4,6}}')) AND bool_and(try_cast(substr(value, 1, 2) AS int) < 24) THEN 'TIME'
    WHEN bool_and(regexp_full_match(value, '[0-9]+')) THEN CASE WHEN min(length(value)) = max(length(value)) AND min(length(value)) > 4 THEN 'AMOUNT' ELSE 'NUMERIC' END
    ELSE 'ALPHANUMERIC' END AS type, cast(length(min_by(value, first_pos)) AS int) AS first_len FROM counts GROUP BY 1)
  SELECT field, type, CASE WHEN type = 'FIXED' THEN 'Type_Code_' WHEN type = 'AMOUNT' THEN 'Amount_' WHEN type LIKE 'DATE%' THEN 'Date_' WHEN type = 'TIME' THEN 'Time_'
    WHEN type = 'NUMERIC' AND first_len IN (9, 10) THEN 'Routing_' WHEN type = 'NUMERIC' AND first_len >= 13 THEN 'Account_'
    WHEN type = 'ALPHANUMERIC' AND first_len BETWEEN 15 AND 30 THEN 'Name_' ELSE 'Field_' END || '001' AS learned_name FROM k"""


@query("a14_strict_type_ladder", STRICT_SQL)
def a14(spark, folder):
    return profile.strict_ladder(weighted(spark, folder)).select(
        "field", "type", F.expr(profile.learned_name("0", "type", "first_len")).alias("learned_name"))


@query("a15_allowed_values", f"""WITH {LONG_SQL} SELECT field, array_to_string(list_sort(list(value)), ',') AS allowed FROM counts GROUP BY 1 HAVING count(*) <= 25""")
def a15(spark, folder):
    return profile.allowed_values(counts(spark, folder))


@query("a16_most_common", f"""WITH {LONG_SQL} SELECT field, first(value ORDER BY n DESC, first_pos) AS value, max(n) AS n FROM counts GROUP BY 1""")
def a16(spark, folder):
    return profile.most_common(counts(spark, folder))


SHAPES_D = " ".join(f"WHEN bool_and(regexp_matches(value, '{p}')) THEN '{n}'" for p, n in profile.DATE_SHAPES)


@query("x7_date_format", f"WITH {LONG_SQL}, f AS (SELECT field, CASE {SHAPES_D} END AS format_string FROM counts GROUP BY 1) SELECT * FROM f WHERE format_string IS NOT NULL")
def x7(spark, folder):
    return profile.date_formats(weighted(spark, folder))


@query("t7_first_samples", f"""WITH {LONG_SQL}, r AS (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY pos) AS rank FROM long WHERE value <> '')
  SELECT field, string_agg(value, '|' ORDER BY rank) AS samples FROM r WHERE rank <= 10 GROUP BY 1""")
def t7(spark, folder):
    return profile.first_samples(long(spark, folder))


@query("x28_justification", VOTES_SQL + WIN_SQL + """ SELECT field, type, CASE WHEN type IN ('NUMERIC', 'AMOUNT', 'SEQUENCE') THEN 'right' ELSE 'left' END AS justify,
    CASE WHEN type IN ('NUMERIC', 'AMOUNT', 'SEQUENCE') THEN '0' ELSE ' ' END AS pad FROM win""")
def x28(spark, folder):
    justify, pad = profile.justification("type")
    return profile.winners(profile.field_votes(weighted(spark, folder))).select(
        "field", "type", F.expr(justify).alias("justify"), F.expr(pad).alias("pad"))


LEARN_SQL = VOTES_SQL + WIN_SQL + f""",
prof AS (SELECT field, cast(min(length(value)) AS int) AS min_len, cast(max(length(value)) AS int) AS max_len, cast(sum(n) AS bigint) AS non_empty,
    cast(count(*) AS bigint) AS distinct_values, min({NUM_D}) AS mn, max({NUM_D}) AS mx, first(value ORDER BY n DESC, first_pos) AS common,
    CASE WHEN count(*) <= 25 THEN array_to_string(list_sort(list(value)), ',') END AS allowed, CASE {SHAPES_D} END AS fmt FROM counts GROUP BY 1),
smp AS (SELECT field, string_agg(value, '|' ORDER BY rank) AS samples FROM (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY pos) AS rank
    FROM long WHERE value <> '') WHERE rank <= 10 GROUP BY 1),
lrn AS (SELECT field, CASE WHEN type <> 'STRING' AND confidence < 0.45 THEN 'STRING' ELSE type END AS type, confidence FROM win),
learned AS (SELECT field, type, confidence, min_len, max_len, non_empty, distinct_values, CASE WHEN type IN ('NUMERIC', 'AMOUNT') THEN mn END AS min_value,
    CASE WHEN type IN ('NUMERIC', 'AMOUNT') THEN mx END AS max_value, CASE WHEN type = 'ENUM' THEN allowed END AS allowed,
    CASE WHEN type = 'ENUM' THEN common END AS default_value, CASE type WHEN 'PAN' THEN 'luhn' WHEN 'ROUTING_NUMBER' THEN 'aba' END AS checksum,
    CASE WHEN type IN ('DATE', 'DATETIME') THEN fmt END AS format_string, CASE WHEN type IN ('NUMERIC', 'AMOUNT', 'SEQUENCE') THEN 'right' ELSE 'left' END AS justify,
    CASE WHEN type IN ('NUMERIC', 'AMOUNT', 'SEQUENCE') THEN '0' ELSE ' ' END AS pad, samples
  FROM lrn JOIN prof USING (field) JOIN smp USING (field))"""


@query("c3_learn_spec", LEARN_SQL + " SELECT * FROM learned")
def c3(spark, folder):
    return profile.learn(long(spark, folder))


@query("c3_learn_spec_in_place", LEARN_SQL + " SELECT * FROM learned")
def c3b(spark, folder):
    """The same spec with near-unique columns left where they are, as for inputs of many files."""
    return profile.learn(long(spark, folder), most=1000, in_place=True)


SPEC_ROWS = ", ".join(f"({_lit(s.name)}, {_lit(f.record_type)}, {_lit(f.name)}, {_lit(f.fmt)}::varchar, {_lit(f.default)}::varchar, {_lit(f.min_value)}::double, {_lit(f.max_value)}::double)"
                      for s in (layouts.ACH, layouts.CARD) for f in s.fields)


@query("j3_enrich_spec", LEARN_SQL + f""", base(spec_name, record_type, field, fmt, dflt, mn, mx) AS (VALUES {SPEC_ROWS})
  SELECT spec_name, record_type, base.field, coalesce(fmt, l.format_string) AS format_string, coalesce(dflt, l.default_value) AS default_value,
    coalesce(mn, l.min_value) AS min_value, coalesce(mx, l.max_value) AS max_value, samples FROM base LEFT JOIN learned l ON base.field = l.field""")
def j3(spark, folder):
    base = layouts.spec_table(spark, layouts.ACH, layouts.CARD)
    return profile.enrich_spec(base, profile.learn(long(spark, folder))).select(
        "spec_name", "record_type", "field", "format_string", "default_value", "min_value", "max_value", "samples")


@query("j4_merge_specs", f"""WITH {LONG_SQL}, base(spec_name, record_type, field) AS (VALUES {", ".join(f"('ACH', {_lit(f.record_type)}, {_lit(f.name)})" for f in layouts.ACH.fields)}),
  other AS (SELECT DISTINCT 'orders' AS spec_name, CASE WHEN field LIKE '%date' THEN '6' ELSE 'RECORD' END AS record_type, field FROM long)
  SELECT * FROM base UNION ALL SELECT * FROM other WHERE record_type NOT IN (SELECT record_type FROM base)""")
def j4(spark, folder):
    base = layouts.spec_table(spark, layouts.ACH).select("spec_name", "record_type", "field")
    other = long(spark, folder).select("field").distinct().selectExpr(
        "'orders' as spec_name", "if(field like '%date', '6', 'RECORD') as record_type", "field")
    return profile.merge_specs(base, other)


@query("u2_rule_union", """SELECT DISTINCT rule FROM (SELECT 'status = ' || o_orderstatus AS rule FROM orders
  UNION ALL SELECT 'status = ' || l_linestatus FROM lineitem)""")
def u2(spark, folder):
    left = derived.table(spark, folder, "orders").selectExpr("concat('status = ', o_orderstatus) as rule")
    right = derived.table(spark, folder, "lineitem").selectExpr("concat('status = ', l_linestatus) as rule")
    return left.union(right).distinct()


# ------------------------------------------------------------------------------------------------- whole files
MIXED = f"""{LINES}, {shared.GL_LINES}, csv AS (SELECT 'csv-' || c_mktsegment AS file_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS line_no,
    concat_ws(',', c_custkey, c_name, c_nationkey, cast(c_acctbal AS decimal(18,2))) || CASE WHEN c_custkey % 7 = 0 THEN ',' ELSE '' END AS line FROM customer),
  mixed AS (SELECT file_id, line_no, line FROM lines UNION ALL SELECT file_id, line_no, line FROM gl_lines UNION ALL SELECT * FROM csv)"""


def mixed(spark, folder):
    customers = derived.table(spark, folder, "customer").selectExpr(
        "concat('csv-', c_mktsegment) as file_id", "c_custkey",
        "concat(concat_ws(',', c_custkey, c_name, c_nationkey, cast(c_acctbal as decimal(18,2))), if(c_custkey % 7 = 0, ',', '')) as line")
    from tallyframe.operators import ordered
    csv = ordered.numbered(customers, ["file_id"], ["c_custkey"], "line_no", sparse=True).select("file_id", "line_no", "line")
    return shared.raw(spark, folder).unionByName(shared.gl_lines(spark, folder)).unionByName(csv)


@query("a23_delimiter", f"""WITH {MIXED}, c AS (SELECT file_id, line_no, length(line) AS len, {", ".join(f"length(line) - length(replace(line, '{d}', '')) AS c{i}" for i, d in enumerate(['|', chr(9), ',', ';', '~']))} FROM mixed),
  a AS (SELECT file_id, {", ".join(f"min(c{i}) = max(c{i}) AND min(c{i}) > 0 AS e{i}" for i in range(5))}, stddev_samp(c2) AS sd, min_by(c2, line_no) AS f, max(len) - min(len) AS spread FROM c GROUP BY 1)
  SELECT file_id, CASE WHEN e0 THEN '|' WHEN e1 THEN chr(9) WHEN e2 THEN ',' WHEN e3 THEN ';' WHEN e4 THEN '~' WHEN sd < 2 AND f > 0 THEN ',' WHEN spread <= 2 THEN '' ELSE ',' END AS delimiter,
    NOT (e0 OR e1 OR e2 OR e3 OR e4 OR coalesce(sd < 2 AND f > 0, false)) AND spread <= 2 AS fixed_width FROM a""")
def a23(spark, folder):
    return profile.detect_delimiter(mixed(spark, folder))


@query("a22_header_trailer", f"""WITH {LINES}, {shared.CARD_LINES}, m AS (SELECT file_id, line_no, length(line) AS len FROM lines UNION ALL SELECT file_id, line_no, length(trim(line)) FROM card_lines),
  a AS (SELECT file_id, median(len) AS md, min_by(len, line_no) AS f, max_by(len, line_no) AS l, count(*) AS n FROM m GROUP BY 1)
  SELECT file_id, md::double AS median_len, cast(f AS int) AS first_len, cast(l AS int) AS last_len, abs(f - md) / (md + 1) > 0.25 AS has_header, n > 2 AND abs(l - md) / (md + 1) > 0.3 AS has_trailer FROM a""")
def a22(spark, folder):
    both = shared.raw(spark, folder).unionByName(
        shared.card_lines(spark, folder).withColumn("line", F.trim("line")))
    return profile.header_trailer(both)


@query("w2_first_last_line", f"""WITH {LINES} SELECT file_id, min_by(line, line_no) AS first_line, max_by(line, line_no) AS last_line, max(line_no) AS lines FROM lines GROUP BY 1""")
def w2(spark, folder):
    return shared.raw(spark, folder).groupBy("file_id").agg(
        F.expr("min_by(line, line_no) as first_line"), F.expr("max_by(line, line_no) as last_line"), F.max("line_no").alias("lines"))


@query("a41_format_guess", f"""WITH {MIXED}, f AS (SELECT file_id, min_by(line, line_no) AS first FROM mixed GROUP BY 1)
  SELECT file_id, CASE WHEN length(first) = 94 AND first LIKE '1%' THEN 'ACH' ELSE 'FIXED_WIDTH' END AS format FROM f""")
def a41(spark, folder):
    return profile.format_guess(mixed(spark, folder))


FREQ = f"""WITH {LINES}, w AS (SELECT file_id, count(*) AS n, max(length(line)) AS width FROM lines GROUP BY 1),
  freq AS (SELECT file_id, cast(pos AS int) AS pos, width, round((n - filled) / n::double, 6) AS space_freq FROM (
    SELECT w.file_id, p.pos, any_value(w.n) AS n, any_value(cast(w.width AS int)) AS width, sum(CASE WHEN substr(l.line, cast(p.pos + 1 AS int), 1) NOT IN ('', ' ') THEN 1 ELSE 0 END) AS filled
    FROM w, unnest(range(width)) AS p(pos), lines l WHERE l.file_id = w.file_id GROUP BY 1, 2))"""


@query("a17_space_frequency", FREQ + " SELECT file_id, pos, space_freq FROM freq")
def a17(spark, folder):
    return profile.space_frequency(shared.raw(spark, folder)).select("file_id", "pos", "space_freq")


@query("w13_column_ranges", FREQ + """, r AS (SELECT *, space_freq > 0.8 AS blank, pos - row_number() OVER (PARTITION BY file_id, space_freq > 0.8 ORDER BY pos) AS run FROM freq)
  SELECT file_id, min(pos) AS start, max(pos) + 1 AS "end" FROM r WHERE NOT blank GROUP BY file_id, run""")
def w13(spark, folder):
    return profile.column_ranges(profile.space_frequency(shared.raw(spark, folder)))


@query("w13_column_ranges_compat", FREQ + """, r AS (SELECT *, space_freq > 0.8 AS blank, pos - row_number() OVER (PARTITION BY file_id, space_freq > 0.8 ORDER BY pos) AS run FROM freq),
  c AS (SELECT file_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY file_id, blank, run ORDER BY pos) AS nth FROM r) WHERE blank AND nth % 2 = 1
    UNION ALL SELECT file_id, 0 FROM w UNION ALL SELECT file_id, cast(width AS int) FROM w),
  b AS (SELECT file_id, pos AS start, lead(pos) OVER (PARTITION BY file_id ORDER BY pos) AS "end" FROM c)
  SELECT * FROM b WHERE "end" - start > 1""")
def w13b(spark, folder):
    return profile.column_ranges(profile.space_frequency(shared.raw(spark, folder)), compat=True)


TRANS = f"""WITH {LINES}, g AS (SELECT CASE WHEN regexp_full_match(substr(line, 1, 1), '[0-9]') THEN substr(line, 1, 1) ELSE '0' END AS rid, line FROM lines),
  ok AS (SELECT rid, list_transform(string_split(line, ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z]') THEN 'a' WHEN regexp_full_match(c, '[0-9]') THEN 'd' WHEN c = ' ' THEN ' ' ELSE 's' END) AS c FROM g WHERE length(line) >= 94),
  pr AS (SELECT rid, unnest(range(1, 94)) AS pos, c FROM ok),
  sc AS (SELECT rid, cast(pos AS int) AS pos, sum(CASE WHEN replace(c[pos + 1], ' ', 's') <> replace(c[pos], ' ', 's') THEN 1.0 ELSE 0 END + CASE WHEN c[pos + 1] = ' ' AND c[pos] <> ' ' THEN 0.5 ELSE 0 END)::double AS score FROM pr GROUP BY 1, 2)"""


def grouped(spark, folder):
    return shared.raw(spark, folder).withColumn("rid", fixed.learned_record_id(F.col("line"), False))


@query("a18_class_transitions", TRANS + " SELECT * FROM sc WHERE score > 0")
def a18(spark, folder):
    return profile.transitions(grouped(spark, folder), ["rid"], "94")


@query("a18_learned_boundaries", TRANS + """, t AS (SELECT rid, count(*) AS n FROM g GROUP BY 1),
  b AS (SELECT rid, pos FROM sc JOIN t USING (rid) WHERE score >= n * 0.3 UNION SELECT rid, 0 FROM t UNION SELECT rid, 94 FROM t),
  o AS (SELECT rid, pos AS start, lead(pos) OVER w AS "end", cast(row_number() OVER w - 1 AS int) AS field_no FROM b WINDOW w AS (PARTITION BY rid ORDER BY pos))
  SELECT * FROM o WHERE "end" IS NOT NULL""")
def a18b(spark, folder):
    return profile.learned_boundaries(grouped(spark, folder), ["rid"], "94")
