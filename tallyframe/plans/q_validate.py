"""Queries: scans of lines, slicing, classification, field checks, caps and reports."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from tallyframe.functions import checks, fixed
from tallyframe.operators import reconcile, synth, validate
from tallyframe.plans import shared
from tallyframe.plans.registry import ORACLES, query
from tallyframe.plans.shared import ACH_TYPED, LINES
from tallyframe.sources import derived, layouts
from tallyframe.sources.layouts import ACH, CARD, GL

ACH_SQL, GL_SQL, CARD_SQL = shared.ach_checks(), shared.gl_checks(), shared.card_checks()


def ach_result(spark, folder):
    return validate.checked(shared.raw(spark, folder), ACH)


def ach_errors(spark, folder):
    return validate.errors(ach_result(spark, folder))


def gl_errors(spark, folder):
    return validate.errors(validate.checked(shared.gl_lines(spark, folder), GL))


def card_errors(spark, folder):
    return validate.errors(validate.checked(shared.card_lines(spark, folder), CARD, "strict"))


def code_sql(base: str, table: str, codes: str) -> str:
    return f"""{base} SELECT file_id, line_no, record_type, field, code, v AS value
      FROM (SELECT *, unnest(codes) AS code FROM {table}) WHERE code IN ({codes})"""


KEEP = ["file_id", "line_no", "record_type", "field", "code", "value"]


def with_codes(found, *codes):
    return found.filter(F.col("code").isin(*codes)).select(*KEEP)


@query("p1_fixed_slice", f"""WITH {LINES} SELECT file_id, line_no, trim(CASE WHEN length(line) >= 39 THEN substr(line, 30, 10) ELSE '' END) AS amount,
  trim(CASE WHEN length(line) >= 94 THEN substr(line, 80, 15) ELSE '' END) AS trace_number FROM lines WHERE substr(line, 1, 1) = '6'""")
def p1(spark, folder):
    return shared.raw(spark, folder).filter("substring(line, 1, 1) = '6'").selectExpr(
        "file_id", "line_no", f"trim({fixed.slice_field('line', 30, 39)}) as amount",
        f"trim({fixed.slice_field('line', 80, 94)}) as trace_number")


@query("p5_record_class", f"WITH {LINES}, {ACH_TYPED} SELECT file_id, record_type, cast(count(*) AS bigint) AS n FROM typed GROUP BY 1, 2")
def p5(spark, folder):
    kinds = shared.raw(spark, folder).withColumn("record_type", fixed.classify(F.col("line"), ACH.record_types, "9" * 94))
    return kinds.groupBy("file_id", "record_type").agg(F.count(F.lit(1)).alias("n"))


@query("p13_learned_record_id", f"""WITH {LINES} SELECT trim(substr(line, 1, 2)) AS ach_id,
  CASE WHEN regexp_full_match(substr(line, 1, 1), '[0-9]') THEN substr(line, 1, 1) ELSE '0' END AS plain_id,
  cast(count(*) AS bigint) AS n FROM lines GROUP BY 1, 2""")
def p13(spark, folder):
    return shared.raw(spark, folder).groupBy(
        fixed.learned_record_id(F.col("line"), True).alias("ach_id"),
        fixed.learned_record_id(F.col("line"), False).alias("plain_id")).agg(F.count(F.lit(1)).alias("n"))


@query("j1_field_values", f"""WITH {LINES}, {ACH_TYPED}, {shared.spec_values(ACH)}
  SELECT record_type, field, cast(count(*) AS bigint) AS n, cast(sum(length(v)) AS bigint) AS chars,
    cast(count(DISTINCT v) AS bigint) AS distinct_values, min(v) AS low, max(v) AS high
  FROM (SELECT t.record_type, field, trim(CASE WHEN length(line) >= e THEN substr(line, s, e - s + 1) ELSE '' END) AS v
        FROM typed t JOIN spec USING (record_type)) GROUP BY 1, 2""")
def j1(spark, folder):
    values = validate.field_values(shared.raw(spark, folder), ACH)
    return values.groupBy("record_type", "field").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("value").cast("bigint")).alias("chars"),
        F.countDistinct("value").alias("distinct_values"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("j2_unknown_lines", f"""WITH {LINES} SELECT file_id, line_no, substr(line, 1, 1) AS record_type FROM lines
  WHERE substr(line, 1, 1) NOT IN ('1', '5', '6', '7', '8', '9')""")
def j2(spark, folder):
    return validate.unknown_lines(shared.raw(spark, folder), ACH).select("file_id", "line_no", "record_type")


@query("j15_prefix_definitions", f"""WITH {LINES}, defs(record_id, record_name) AS (VALUES ('1', 'file header'), ('5', 'batch header'),
    ('52', 'mixed batch'), ('6', 'entry'), ('622', 'checking credit'), ('627', 'checking debit'), ('8', 'batch control'), ('9', 'file control'))
  SELECT record_id, record_name, cast(count(*) AS bigint) AS n, cast(sum(line_no) AS bigint) AS line_sum
  FROM lines JOIN defs ON starts_with(line, record_id) GROUP BY 1, 2""")
def j15(spark, folder):
    defs = spark.createDataFrame([("1", "file header"), ("5", "batch header"), ("52", "mixed batch"), ("6", "entry"),
                                  ("622", "checking credit"), ("627", "checking debit"), ("8", "batch control"),
                                  ("9", "file control")], "record_id string, record_name string")
    found = validate.prefix_matches(shared.raw(spark, folder), defs, [1, 2, 3])
    return found.groupBy("record_id", "record_name").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("line_sum"))


@query("j15_generic_errors", f"""WITH {LINES}, defs(record_id) AS (VALUES ('1'), ('5'), ('6'), ('7'), ('8'), ('9')), m AS (SELECT * FROM lines JOIN defs ON starts_with(line, record_id)),
  f(record_id, field, s, e) AS (VALUES {", ".join(f"('{f.record_type}', '{f.name}', {f.start}, {f.end})" for f in ACH.fields if f.data_type in ("numeric", "amount"))}),
  v AS (SELECT file_id, line_no, m.record_id, field, trim(substr(line, s, e - s + 1)) AS value FROM m JOIN f USING (record_id) WHERE length(line) >= e)
  SELECT * FROM v WHERE value <> '' AND NOT regexp_full_match(value, '[0-9]+')""")
def j15_generic(spark, folder):
    """Number and amount fields that are no digits, for lines by the prefix of their record definition."""
    defs = spark.createDataFrame([(t,) for t in ACH.record_types], "record_id string")
    return validate.generic_errors(validate.prefix_matches(shared.raw(spark, folder), defs, [1]), ACH)


@query("f1_required_gate", code_sql(GL_SQL, "lenient", "'REQUIRED'"))
def f1(spark, folder):
    return with_codes(gl_errors(spark, folder), "REQUIRED")


@query("f2_length_bounds", code_sql(GL_SQL, "lenient", "'LENGTH'"))
def f2(spark, folder):
    return with_codes(gl_errors(spark, folder), "LENGTH")


@query("f3_type_predicates", code_sql(ACH_SQL, "lenient", "'TYPE', 'DATE', 'ROUTING'"))
def f3(spark, folder):
    return with_codes(ach_errors(spark, folder), "TYPE", "DATE", "ROUTING")


@query("f3_type_predicates_delimited", code_sql(GL_SQL, "lenient", "'TYPE', 'DATE', 'ROUTING'"))
def f3b(spark, folder):
    return with_codes(gl_errors(spark, folder), "TYPE", "DATE", "ROUTING")


@query("f4_allowed_values", code_sql(CARD_SQL, "strict", "'ALLOWED'"))
def f4(spark, folder):
    return with_codes(card_errors(spark, folder), "ALLOWED")


@query("f5_numeric_range", code_sql(CARD_SQL, "strict", "'NOT_NUMERIC', 'MIN_VALUE', 'MAX_VALUE'"))
def f5(spark, folder):
    return with_codes(card_errors(spark, folder), "NOT_NUMERIC", "MIN_VALUE", "MAX_VALUE")


@query("f6_pattern", code_sql(CARD_SQL, "strict", "'PATTERN'"))
def f6(spark, folder):
    return with_codes(card_errors(spark, folder), "PATTERN")


@query("f7_fixed_value", f"""WITH {LINES}, v AS (SELECT file_id, line_no, CASE WHEN length(line) >= 87 THEN trim(substr(line, 80, 8)) ELSE '' END AS value FROM lines
  WHERE substr(line, 1, 1) IN ('5', '8') AND line <> repeat('9', 94)) SELECT * FROM v WHERE value <> '02100002'""")
def f7(spark, folder):
    """The layout with the originator's number as a fixed value: findings FIXED."""
    fixed_odfi = dataclasses.replace(ACH, fields=tuple(dataclasses.replace(f, fixed="02100002") if f.record_type in "58" and f.start == 80 else f for f in ACH.fields))
    found = validate.errors(validate.checked(shared.raw(spark, folder), fixed_odfi))
    return found.filter("code = 'FIXED' and record_type in ('5', '8') and value <> '02100002' and field in (" + ", ".join(f"'{f.name}'" for f in fixed_odfi.fields if f.fixed == "02100002") + ")").select("file_id", "line_no", "value")


@query("f8_record_length", f"WITH {LINES} SELECT file_id, line_no, cast(length(line) AS int) AS line_len FROM lines WHERE length(line) <> 94")
def f8(spark, folder):
    return ach_errors(spark, folder).filter("code = 'RECORD_LENGTH'").select("file_id", "line_no", F.length("value").alias("line_len"))


@query("x30_check_fold", code_sql(ACH_SQL, "lenient", "'REQUIRED', 'LENGTH', 'TYPE', 'DATE', 'ROUTING', 'ALLOWED', 'FIXED'"))
def x30(spark, folder):
    return ach_errors(spark, folder).filter("severity = 'ERROR'").select(*KEEP)


@query("x30_check_fold_strict", code_sql(CARD_SQL, "strict", "'REQUIRED', 'MIN_LENGTH', 'MAX_LENGTH', 'ALLOWED', 'PATTERN', 'NOT_NUMERIC', 'MIN_VALUE', 'MAX_VALUE', 'LUHN'"))
def x30b(spark, folder):
    return card_errors(spark, folder).filter("severity = 'ERROR'").select(*KEEP)


REPORT_SQL = """ SELECT file_id, cast(count(*) AS bigint) AS total_records, cast(sum(good) AS bigint) AS passed,
  cast(sum(bad) AS bigint) AS failed, cast(sum(notes) AS bigint) AS warnings,
  cast(count(*) FILTER (WHERE bad > 0) AS bigint) AS records_with_errors, sum(bad) = 0 AS is_valid,
  CASE WHEN sum(good) + sum(bad) = 0 THEN 0 ELSE round(100.0::double * sum(good) / (sum(good) + sum(bad)), 2) END AS score
  FROM per_line GROUP BY file_id"""


@query("a1_validation_report", ACH_SQL + """, per_line AS (SELECT t.file_id, t.line_no, coalesce(sum(good), 0) AS good,
    coalesce(sum(len(codes)), 0) AS bad, any_value(CASE WHEN length(line) <> 94 THEN 1 ELSE 0 END
      + CASE WHEN t.record_type IS NULL THEN 1 ELSE 0 END) AS notes
  FROM typed t LEFT JOIN lenient l ON t.file_id = l.file_id AND t.line_no = l.line_no GROUP BY 1, 2)""" + REPORT_SQL)
def a1(spark, folder):
    return validate.report(ach_result(spark, folder))


@query("a1_validation_report_delimited", GL_SQL + """, per_line AS (SELECT t.file_id, t.line_no, coalesce(sum(good), 0) AS good,
    coalesce(sum(len(codes)), 0) AS bad, 0 AS notes
  FROM typed t LEFT JOIN lenient l ON t.file_id = l.file_id AND t.line_no = l.line_no GROUP BY 1, 2)""" + REPORT_SQL)
def a1b(spark, folder):
    return validate.report(validate.checked(shared.gl_lines(spark, folder), GL))


@query("a1_validation_report_strict", CARD_SQL + """, per_line AS (SELECT t.file_id, t.line_no, coalesce(sum(good), 0) AS good,
    coalesce(sum(len(codes)), 0) AS bad, 0 AS notes
  FROM typed t LEFT JOIN strict l ON t.file_id = l.file_id AND t.line_no = l.line_no GROUP BY 1, 2)""" + REPORT_SQL)
def a1c(spark, folder):
    return validate.report(validate.checked(shared.card_lines(spark, folder), CARD, "strict"))


@query("a2_error_counts", ACH_SQL + """ SELECT record_type, field, code, cast(count(*) FILTER (WHERE sev = 'E') AS bigint) AS errors,
    cast(count(*) FILTER (WHERE sev = 'W') AS bigint) AS warnings FROM (
  SELECT record_type, field, unnest(codes) AS code, 'E' AS sev FROM lenient
  UNION ALL SELECT record_type, 'RECORD_LENGTH', 'RECORD_LENGTH', 'W' FROM typed WHERE length(line) <> 94
  UNION ALL SELECT record_type, 'RECORD_TYPE', 'RECORD_TYPE', 'W' FROM typed WHERE record_type IS NULL) GROUP BY 1, 2, 3""")
def a2(spark, folder):
    return validate.error_counts(ach_errors(spark, folder))


@query("w4_field_error_cap", CARD_SQL + """, e AS (SELECT file_id, line_no, record_type, field, unnest(codes) AS code FROM strict),
  c AS (SELECT *, count(*) OVER (PARTITION BY file_id, record_type, field ORDER BY line_no
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
  SELECT file_id, line_no, record_type, field, code FROM c WHERE before < 5""")
def w4(spark, folder):
    return validate.capped_field_errors(card_errors(spark, folder)).select("file_id", "line_no", "record_type", "field", "code")


@query("t4_report_caps", ACH_SQL + """, e AS (SELECT file_id, line_no, pos, field, unnest(codes) AS code, 'ERROR' AS severity, substr(v, 1, 80) AS value FROM lenient
  UNION ALL SELECT file_id, line_no, 0, 'RECORD_LENGTH', 'RECORD_LENGTH', 'WARNING', substr(line, 1, 80) FROM typed WHERE length(line) <> 94
  UNION ALL SELECT file_id, line_no, 0, 'RECORD_TYPE', 'RECORD_TYPE', 'WARNING', substr(line, 1, 1) FROM typed WHERE record_type IS NULL),
  r AS (SELECT *, cast(row_number() OVER (PARTITION BY file_id, severity ORDER BY line_no, pos, code) AS int) AS rank FROM e)
  SELECT file_id, severity, rank, line_no, field, code, value FROM r WHERE rank <= CASE WHEN severity = 'ERROR' THEN 200 ELSE 100 END""")
def t4(spark, folder):
    return validate.capped_report(ach_errors(spark, folder)).select(
        "file_id", "severity", "rank", "line_no", "field", "code", "value")


@query("t5_preview", f"WITH {LINES} SELECT file_id, line_no, line FROM lines WHERE line_no <= 20")
def t5(spark, folder):
    return shared.raw(spark, folder).filter("line_no <= 20")


@query("v2_record_rules", f"""WITH {shared.ENTRIES} SELECT src_key, unnest(list_filter([
    CASE WHEN NOT (amount_cents < 40000000) THEN 'amount_limit' END,
    CASE WHEN NOT (transaction_code <> '32' OR has_addenda = 0) THEN 'no_addenda_on_savings' END], lambda x: x IS NOT NULL)) AS rule FROM entries""")
def v2(spark, folder):
    return validate.apply_rules(shared.entries(spark, folder), {
        "amount_limit": F.expr("amount_cents < 40000000"),
        "no_addenda_on_savings": F.expr("transaction_code <> '32' or has_addenda = 0")}).select("src_key", "rule")


@query("v3_file_rules", f"""WITH {shared.CARD_LINES}, s AS (SELECT file_id,
    cast(count(*) FILTER (WHERE substr(line, 1, 1) NOT IN ('H', 'T')) AS varchar) AS details,
    cast(max(CASE WHEN substr(line, 1, 1) = 'T' THEN cast(substr(line, 2, 10) AS bigint) END) AS varchar) AS declared,
    cast(count(*) FILTER (WHERE substr(line, 1, 1) = 'H') AS varchar) AS headers FROM card_lines GROUP BY 1)
  SELECT file_id, 'total_records' AS rule, declared AS expected, details AS actual FROM s WHERE declared IS DISTINCT FROM details
  UNION ALL SELECT file_id, 'one_header', '1', headers FROM s WHERE headers <> '1'""")
def v3(spark, folder):
    return validate.file_rules(shared.card_lines(spark, folder), "file_id", {
        "total_records": ("max(if(substring(line, 1, 1) = 'T', try_cast(substring(line, 2, 10) as bigint), null))",
                          "count_if(substring(line, 1, 1) not in ('H', 'T'))"),
        "one_header": ("1", "count_if(substring(line, 1, 1) = 'H')")})


# ------------------------------------------------------------------------------------------- scalar checks
@query("x1_luhn", f"""WITH {shared.CARD_LINES} SELECT file_id, line_no, substr(line, 5, 16) AS pan, {shared.LUHN_OK.replace("(v,", "(substr(line, 5, 16),")} AS luhn
  FROM card_lines WHERE substr(line, 1, 1) NOT IN ('H', 'T')""")
def x1(spark, folder):
    return shared.card_lines(spark, folder).filter("substring(line, 1, 1) not in ('H', 'T')").selectExpr(
        "file_id", "line_no", "substring(line, 5, 16) as pan", f"{checks.luhn_ok('substring(line, 5, 16)')} as luhn")


@query("x2_luhn_digit", f"""SELECT l_orderkey, l_partkey, cast({shared.luhn_sql("('4' || lpad(cast(l_orderkey AS varchar), 8, '0') || lpad(cast(l_partkey AS varchar), 6, '0'))")} AS int) AS digit FROM lineitem""")
def x2(spark, folder):
    partial = "concat('4', lpad(cast(l_orderkey as string), 8, '0'), lpad(cast(l_partkey as string), 6, '0'))"
    return derived.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", f"cast({checks.luhn_check_digit(partial)} as int) as digit")


@query("x3_aba", f"""WITH {LINES} SELECT file_id, line_no, substr(line, 4, 9) AS routing, {shared.aba9("substr(line, 4, 9)")} AS valid
  FROM lines WHERE substr(line, 1, 1) = '6'""")
def x3(spark, folder):
    return shared.raw(spark, folder).filter("substring(line, 1, 1) = '6'").selectExpr(
        "file_id", "line_no", "substring(line, 4, 9) as routing", f"{checks.aba_ok('substring(line, 4, 9)')} as valid")


@query("x4_aba_digit", f"""SELECT c_custkey, cast({shared.aba_sql("lpad(cast(c_custkey * 7919 % 100000000 AS varchar), 8, '0')")} AS int) AS digit FROM customer""")
def x4(spark, folder):
    return derived.table(spark, folder, "customer").selectExpr(
        "c_custkey", f"{checks.aba_check_digit("lpad(cast(c_custkey * 7919 % 100000000 as string), 8, '0')")} as digit")


@query("x5_date_valid", f"""WITH d AS (SELECT l_orderkey, fmt, v FROM (SELECT l_orderkey,
    unnest(['YYMMDD', 'YYYYMMDD', 'MMDD', 'DD-MON-YYYY']) AS fmt,
    unnest([strftime(l_shipdate, '%y%m') || lpad(cast(l_orderkey % 40 AS varchar), 2, '0'),
      strftime(l_shipdate, '%Y') || lpad(cast(l_partkey % 15 AS varchar), 2, '0') || strftime(l_shipdate, '%d'),
      lpad(cast(l_partkey % 13 AS varchar), 2, '0') || lpad(cast(l_orderkey % 33 AS varchar), 2, '0'),
      lpad(cast(l_orderkey % 33 AS varchar), 2, '0') || upper(strftime(l_shipdate, '-%b-%Y'))]) AS v FROM lineitem))
  SELECT fmt, v, {shared.DATE_OK} AS ok, cast(count(*) AS bigint) AS n FROM d GROUP BY 1, 2, 3""")
def x5(spark, folder):
    pair = """inline(array(
      struct('YYMMDD' as fmt, concat(date_format(l_shipdate, 'yyMM'), lpad(cast(l_orderkey % 40 as string), 2, '0')) as v),
      struct('YYYYMMDD' as fmt, concat(date_format(l_shipdate, 'yyyy'), lpad(cast(l_partkey % 15 as string), 2, '0'), date_format(l_shipdate, 'dd')) as v),
      struct('MMDD' as fmt, concat(lpad(cast(l_partkey % 13 as string), 2, '0'), lpad(cast(l_orderkey % 33 as string), 2, '0')) as v),
      struct('DD-MON-YYYY' as fmt, concat(lpad(cast(l_orderkey % 33 as string), 2, '0'), upper(date_format(l_shipdate, '-MMM-yyyy'))) as v)))"""
    rows = derived.table(spark, folder, "lineitem").selectExpr(pair)
    ok = " ".join(f"when '{f}' then {checks.date_ok('v', f)}" for f in checks.DATE_FORMATS)
    return rows.withColumn("ok", F.expr(f"case fmt {ok} end")).groupBy("fmt", "v", "ok").agg(F.count(F.lit(1)).alias("n"))


@query("p8_numeric_coercion", f"""WITH t AS (SELECT unnest([cast(cast(o_totalprice AS decimal(18,2)) AS varchar), '$' || cast(o_custkey AS varchar) || ',000', o_orderpriority,
    ' ' || cast(o_orderkey AS varchar) || '.']) AS v FROM orders)
  SELECT v, try_cast(CASE WHEN regexp_full_match(trim(replace(replace(v, ',', ''), '$', '')), {shared.NUM})
    THEN trim(replace(replace(v, ',', ''), '$', '')) END AS double) AS num, cast(count(*) AS bigint) AS n FROM t GROUP BY 1, 2""")
def p8(spark, folder):
    rows = derived.table(spark, folder, "orders").selectExpr(
        "explode(array(cast(cast(o_totalprice as decimal(18,2)) as string), concat('$', cast(o_custkey as string), ',000'), o_orderpriority, "
        "concat(' ', cast(o_orderkey as string), '.'))) as v")
    return rows.withColumn("num", F.expr(checks.to_number("v"))).groupBy("v", "num").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------- reconciliation
BATCHED = f"""WITH {LINES}, {ACH_TYPED},
runs AS (SELECT *, sum(CASE WHEN record_type = '5' THEN 1 ELSE 0 END) OVER w AS opened,
    sum(CASE WHEN record_type = '8' THEN 1 ELSE 0 END) OVER w AS closed FROM typed
  WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
rec AS (SELECT file_id, line_no, line, record_type, CASE WHEN opened > 0 AND (opened > closed OR record_type = '8')
    THEN cast(opened AS bigint) END AS batch_id,
    coalesce(try_cast(substr(line, 30, 10) AS bigint), 0) AS amt, coalesce(try_cast(substr(line, 4, 8) AS bigint), 0) AS rt8,
    substr(line, 2, 2) IN ('22','32','23','33','24','34') AS credit FROM runs),
tot AS (SELECT file_id, batch_id, cast(count(*) FILTER (WHERE record_type = '6') AS bigint) AS entries, cast(count(*) AS bigint) AS entry_addenda_count,
    cast(sum(CASE WHEN record_type = '6' THEN rt8 ELSE 0 END) % 10000000000 AS bigint) AS entry_hash,
    cast(sum(CASE WHEN record_type = '6' AND NOT credit THEN amt ELSE 0 END) AS bigint) AS total_debit_amount,
    cast(sum(CASE WHEN record_type = '6' AND credit THEN amt ELSE 0 END) AS bigint) AS total_credit_amount
  FROM rec WHERE batch_id IS NOT NULL AND record_type IN ('6', '7') GROUP BY 1, 2)"""


def records(spark, folder):
    return reconcile.with_batch(shared.raw(spark, folder))


@query("w3_enclosing_batch", BATCHED + " SELECT file_id, line_no, record_type, batch_id FROM rec")
def w3(spark, folder):
    return records(spark, folder).select("file_id", "line_no", "record_type", "batch_id")


@query("a3_computed_batches", BATCHED + " SELECT * FROM tot")
def a3c(spark, folder):
    return reconcile.computed_batches(records(spark, folder))


@query("a4_file_totals", f"WITH {shared.ENTRIES} SELECT * FROM files")
def a4(spark, folder):
    return synth.ach_file_totals(synth.ach_batch_totals(shared.entries(spark, folder), "file_id", "file_no", "batch_no"),
                                 "file_id", "file_no")


@query("a5_card_totals", """SELECT 'card-' || cast(l_suppkey AS varchar) AS file_id, cast(count(*) AS bigint) AS total_records,
  cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS bigint) AS total_amount FROM lineitem GROUP BY 1""")
def a5(spark, folder):
    return synth.card_totals(derived.card_details(spark, folder), "file_id")


@query("a6_rollup_totals", BATCHED + """ SELECT file_id, batch_id, cast(count(*) AS bigint) AS entries,
    cast(sum(CASE WHEN credit THEN 0 ELSE amt END) AS bigint) AS debit_cents, cast(sum(CASE WHEN credit THEN amt ELSE 0 END) AS bigint) AS credit_cents,
    cast(grouping(file_id, batch_id) AS int) AS level FROM rec WHERE record_type = '6' AND batch_id IS NOT NULL GROUP BY ROLLUP (file_id, batch_id)""")
def a6(spark, folder):
    return reconcile.rollup_totals(records(spark, folder))


J5_SQL = BATCHED + """, ctl AS (SELECT file_id, batch_id, try_cast(substr(line, 5, 6) AS bigint) AS c1, try_cast(substr(line, 11, 10) AS bigint) AS c2,
    try_cast(substr(line, 21, 12) AS bigint) AS c3, try_cast(substr(line, 33, 12) AS bigint) AS c4 FROM rec WHERE record_type = '8' AND batch_id IS NOT NULL),
  x AS (SELECT coalesce(tot.file_id, ctl.file_id) AS file_id, coalesce(tot.batch_id, ctl.batch_id) AS batch_id,
    unnest(['entry_addenda_count', 'entry_hash', 'total_debit_amount', 'total_credit_amount']) AS field,
    unnest([entry_addenda_count, entry_hash, total_debit_amount, total_credit_amount]) AS expected, unnest([c1, c2, c3, c4]) AS actual
    FROM tot FULL JOIN ctl ON tot.file_id = ctl.file_id AND tot.batch_id = ctl.batch_id)
  SELECT * FROM x WHERE expected IS DISTINCT FROM actual"""


@query("j5_batch_mismatches", J5_SQL)
def j5(spark, folder):
    return reconcile.batch_mismatches(records(spark, folder))


J6_SQL = BATCHED + """, f AS (SELECT file_id, cast(count(*) FILTER (WHERE record_type = '5') AS bigint) AS b, cast(ceil(count(*) / 10.0) AS bigint) AS bl,
    cast(count(*) FILTER (WHERE record_type IN ('6', '7') AND batch_id IS NOT NULL) AS bigint) AS n,
    cast(sum(CASE WHEN record_type = '6' AND batch_id IS NOT NULL THEN rt8 ELSE 0 END) % 10000000000 AS bigint) AS h,
    cast(sum(CASE WHEN record_type = '6' AND batch_id IS NOT NULL AND NOT credit THEN amt ELSE 0 END) AS bigint) AS d,
    cast(sum(CASE WHEN record_type = '6' AND batch_id IS NOT NULL AND credit THEN amt ELSE 0 END) AS bigint) AS c FROM rec GROUP BY 1),
  k AS (SELECT file_id, line FROM rec WHERE record_type = '9'),
  x AS (SELECT file_id, unnest(['batch_count', 'block_count', 'entry_addenda_count', 'entry_hash', 'total_debit_amount', 'total_credit_amount']) AS field,
    unnest([b, bl, n, h, d, c]) AS expected, unnest([try_cast(substr(line, 2, 6) AS bigint), try_cast(substr(line, 8, 6) AS bigint), try_cast(substr(line, 14, 8) AS bigint),
    try_cast(substr(line, 22, 10) AS bigint), try_cast(substr(line, 32, 12) AS bigint), try_cast(substr(line, 44, 12) AS bigint)]) AS actual
    FROM f LEFT JOIN k USING (file_id))
  SELECT * FROM x WHERE expected IS DISTINCT FROM actual"""


@query("j6_file_mismatches", J6_SQL)
def j6(spark, folder):
    return reconcile.file_mismatches(records(spark, folder))


@query("j8_header_control", BATCHED + """, h AS (SELECT file_id, batch_id, substr(line, 2, 3) AS a, substr(line, 41, 10) AS b, substr(line, 80, 8) AS c, substr(line, 88, 7) AS d FROM rec WHERE record_type = '5'),
  t AS (SELECT file_id, batch_id, substr(line, 2, 3) AS e, substr(line, 45, 10) AS f, substr(line, 80, 8) AS g, substr(line, 88, 7) AS i FROM rec WHERE record_type = '8'),
  x AS (SELECT file_id, batch_id, unnest(['service_class_code', 'company_identification', 'odfi_identification', 'batch_number']) AS field,
    unnest([a, b, c, d]) AS expected, unnest([e, f, g, i]) AS actual FROM h FULL JOIN t USING (file_id, batch_id))
  SELECT * FROM x WHERE expected IS DISTINCT FROM actual""")
def j8(spark, folder):
    return reconcile.header_control_mismatches(records(spark, folder))


@query("j9_orphan_addenda", BATCHED + """ SELECT file_id, batch_id, line_no, substr(line, 88, 7) AS parent FROM rec a WHERE record_type = '7' AND NOT EXISTS (
    SELECT 1 FROM rec e WHERE e.record_type = '6' AND e.file_id = a.file_id AND e.batch_id = a.batch_id AND substr(e.line, 79, 1) = '1'
      AND substr(e.line, 88, 7) = substr(a.line, 88, 7))""")
def j9(spark, folder):
    return reconcile.orphan_addenda(records(spark, folder))


@query("j9_missing_addenda", BATCHED + """ SELECT file_id, batch_id, line_no, substr(line, 88, 7) AS parent FROM rec e WHERE record_type = '6' AND substr(line, 79, 1) = '1' AND NOT EXISTS (
    SELECT 1 FROM rec a WHERE a.record_type = '7' AND e.file_id = a.file_id AND e.batch_id = a.batch_id AND substr(e.line, 88, 7) = substr(a.line, 88, 7))""")
def j9b(spark, folder):
    return reconcile.entries_without_addenda(records(spark, folder))


@query("j13_card_trailer", f"""WITH {shared.CARD_LINES}, s AS (SELECT file_id,
    cast(count(*) FILTER (WHERE substr(line, 1, 1) NOT IN ('H', 'T')) AS bigint) AS n,
    cast(sum(CASE WHEN substr(line, 1, 1) NOT IN ('H', 'T') THEN coalesce(try_cast(substr(line, 27, 10) AS bigint), 0) ELSE 0 END) AS bigint) AS a,
    max(CASE WHEN substr(line, 1, 1) = 'T' THEN cast(substr(line, 2, 10) AS bigint) END) AS rn, max(CASE WHEN substr(line, 1, 1) = 'T' THEN cast(substr(line, 12, 14) AS bigint) END) AS ra
    FROM card_lines GROUP BY 1),
  x AS (SELECT file_id, unnest(['total_records', 'total_amount']) AS field, unnest([n, a]) AS expected, unnest([rn, ra]) AS actual FROM s)
  SELECT * FROM x WHERE expected IS DISTINCT FROM actual""")
def j13(spark, folder):
    return reconcile.card_mismatches(shared.card_lines(spark, folder))


@query("w16_sequence_rules", BATCHED + """, b AS (SELECT file_id, line_no, 'BATCH_NUMBER' AS rule, cast(try_cast(substr(line, 88, 7) AS bigint) AS varchar) AS actual, cast(batch_id AS varchar) AS expected FROM rec WHERE record_type = '5'),
  s AS (SELECT *, last_value(CASE WHEN record_type = '5' THEN substr(line, 80, 8) END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS odfi FROM rec),
  t AS (SELECT file_id, batch_id, line_no, odfi, substr(line, 80, 15) AS trace FROM s WHERE record_type = '6' AND batch_id IS NOT NULL AND length(line) = 94),
  l AS (SELECT *, lag(trace) OVER (PARTITION BY file_id, batch_id ORDER BY line_no) AS prev FROM t)
  SELECT * FROM b WHERE actual IS DISTINCT FROM expected
  UNION ALL SELECT file_id, line_no, 'TRACE_ORIGIN', substr(trace, 1, 8), odfi FROM t WHERE substr(trace, 1, 8) <> odfi
  UNION ALL SELECT file_id, line_no, 'TRACE_ORDER', trace, prev FROM l WHERE prev >= trace""")
def w16(spark, folder):
    return reconcile.sequence_errors(records(spark, folder))


@query("a39_native_stats", f"""WITH {LINES} SELECT file_id, cast(count(*) AS bigint) AS total_lines, cast(count(*) FILTER (WHERE length(line) <> 94) AS bigint) AS malformed_lines,
  array_to_string(list_sort(list(DISTINCT substr(line, 1, 1)) FILTER (WHERE substr(line, 1, 1) IN ('1', '5', '6', '7', '8', '9'))), ',') AS found_types FROM lines GROUP BY 1""")
def a39(spark, folder):
    return reconcile.native_stats(shared.raw(spark, folder))


@query("c1_validate_files", ACH_SQL + """, per_line AS (SELECT t.file_id, t.line_no, coalesce(sum(good), 0) AS good, coalesce(sum(len(codes)), 0) AS bad,
    any_value(CASE WHEN length(line) <> 94 THEN 1 ELSE 0 END + CASE WHEN t.record_type IS NULL THEN 1 ELSE 0 END) AS notes
  FROM typed t LEFT JOIN lenient l ON t.file_id = l.file_id AND t.line_no = l.line_no GROUP BY 1, 2),
  rep AS (""" + REPORT_SQL + """), e AS (SELECT file_id, line_no, record_type, field, cast(pos AS int) AS pos, 'ERROR' AS severity, unnest(codes) AS code, v AS value FROM lenient
    UNION ALL SELECT file_id, line_no, record_type, 'RECORD_LENGTH', 0, 'WARNING', 'RECORD_LENGTH', line FROM typed WHERE length(line) <> 94
    UNION ALL SELECT file_id, line_no, record_type, 'RECORD_TYPE', 0, 'WARNING', 'RECORD_TYPE', line FROM typed WHERE record_type IS NULL)
  SELECT rep.*, e.* EXCLUDE (file_id) FROM rep LEFT JOIN e USING (file_id)""")
def c1(spark, folder):
    """Every finding of every file next to the file's report."""
    return validate.all_findings(ach_result(spark, folder))


def _c2_sql():
    def inner(name):
        return ORACLES[name]
    return f"""SELECT file_id, 'BATCH_TOTAL' AS "check", field, cast(batch_id AS varchar) AS "at", cast(expected AS varchar) AS expected, cast(actual AS varchar) AS actual FROM ({inner("j5_batch_mismatches")})
      UNION ALL SELECT file_id, 'FILE_TOTAL', field, '', cast(expected AS varchar), cast(actual AS varchar) FROM ({inner("j6_file_mismatches")})
      UNION ALL SELECT file_id, 'HEADER_CONTROL', field, cast(batch_id AS varchar), expected, actual FROM ({inner("j8_header_control")})
      UNION ALL SELECT file_id, 'ORPHAN_ADDENDA', 'trace', cast(line_no AS varchar), NULL, parent FROM ({inner("j9_orphan_addenda")})
      UNION ALL SELECT file_id, 'MISSING_ADDENDA', 'trace', cast(line_no AS varchar), parent, NULL FROM ({inner("j9_missing_addenda")})
      UNION ALL SELECT file_id, 'RECORD_LENGTH', 'line', cast(line_no AS varchar), '94', cast(length(line) AS varchar) FROM ({BATCHED} SELECT * FROM rec) WHERE length(line) <> 94
      UNION ALL SELECT file_id, 'SEQUENCE', rule, cast(line_no AS varchar), expected, actual FROM ({inner("w16_sequence_rules")})"""


@query("c2_reconcile_files", _c2_sql())
def c2(spark, folder):
    """All cross-record findings of each file as one table."""
    return reconcile.findings(shared.raw(spark, folder))
