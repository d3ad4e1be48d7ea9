"""Inputs shared by the registered queries, and the same inputs as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.operators import synth
from tallyframe.session import scratch_path
from tallyframe.sources import derived

_LANDED: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, folder: str, label: str, build) -> DataFrame:
    """A derived input, written once per application to the shared folder and read back from there: the queries on
    it then start from a table, as they would on delivered files."""
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _LANDED:
        path = scratch_path(spark, label)
        build(spark, folder).write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return derived.ach_entries(spark, folder)


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    return synth.ach_files(entries(spark, folder))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """ACH lines with injected defects: file_id, file_no, batch_no, src_key, line_no, record_type, line."""
    return landed(spark, folder, "ach-lines", lambda s, f: derived.damage_ach(clean_lines(s, f)))


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines as a reader delivers them: file_id, line_no, line."""
    return lines(spark, folder).select("file_id", "line_no", "line")


def aba_sql(x: str) -> str:
    terms = "+".join(f"{w}*cast(substr({x},{i + 1},1) AS int)" for i, w in enumerate((3, 7, 1, 3, 7, 1, 3, 7)))
    return f"((10-({terms})%10)%10)"


ENTRIES = f"""
entries AS (
  SELECT 'ach-' || cast(year(o_orderdate) AS varchar) AS file_id, cast(year(o_orderdate) AS int) AS file_no,
    cast(month(o_orderdate) AS int) AS batch_no, o_orderkey AS src_key,
    CASE o_orderstatus WHEN 'F' THEN '22' WHEN 'O' THEN '27' ELSE '32' END AS transaction_code,
    lpad(cast(o_custkey AS varchar), 8, '0') AS rdfi8,
    cast({aba_sql("lpad(cast(o_custkey AS varchar), 8, '0')")} AS varchar) AS check_digit,
    lpad(cast(o_orderkey AS varchar), 12, '0') AS account,
    cast(round(o_totalprice * 100) AS bigint) AS amount_cents, o_orderpriority AS individual_id,
    coalesce(c_name, 'UNKNOWN') AS name, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS has_addenda
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
batches AS (
  SELECT file_id, file_no, batch_no, cast(count(*) AS bigint) AS entries, cast(sum(has_addenda) AS bigint) AS addenda,
    cast(sum(cast(rdfi8 AS bigint)) % 10000000000 AS bigint) AS entry_hash,
    cast(sum(CASE WHEN transaction_code NOT IN ('22','32','23','33','24','34') THEN amount_cents ELSE 0 END) AS bigint)
      AS debit_cents,
    cast(sum(CASE WHEN transaction_code IN ('22','32','23','33','24','34') THEN amount_cents ELSE 0 END) AS bigint)
      AS credit_cents
  FROM entries GROUP BY 1, 2, 3),
files AS (
  SELECT file_id, file_no, cast(count(*) AS bigint) AS batches, cast(sum(entries + addenda) AS bigint) AS entry_addenda,
    cast(sum(entry_hash) % 10000000000 AS bigint) AS entry_hash, cast(sum(debit_cents) AS bigint) AS debit_cents,
    cast(sum(credit_cents) AS bigint) AS credit_cents, cast(sum(entries + addenda + 2) + 2 AS bigint) AS lines,
    cast(ceil((sum(entries + addenda + 2) + 2) / 10.0) AS bigint) AS blocks
  FROM batches GROUP BY 1, 2)"""

CLEAN_LINES = ENTRIES + """,
placed AS (
  SELECT *, cast(1 + coalesce(sum(entries + addenda + 2) OVER w, 0) AS bigint) AS start,
    cast(coalesce(sum(entries) OVER w, 0) AS bigint) AS entries_before
  FROM batches WINDOW w AS (PARTITION BY file_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (
  SELECT e.*, p.start, cast(sum(1 + has_addenda) OVER w AS bigint) AS used_to,
    lpad(cast((entries_before + row_number() OVER w) % 10000000 AS varchar), 7, '0') AS seq7
  FROM entries e JOIN placed p USING (file_id, file_no, batch_no)
  WINDOW w AS (PARTITION BY e.file_id, e.batch_no ORDER BY src_key)),
clean_lines AS (
  SELECT file_id, file_no, batch_no, src_key, start + 1 + used_to - has_addenda AS line_no, '6' AS record_type,
    '6' || transaction_code || rdfi8 || check_digit || rpad(account, 17, ' ')
      || lpad(cast(amount_cents AS varchar), 10, '0') || rpad(individual_id, 15, ' ') || rpad(name, 22, ' ') || '  '
      || cast(has_addenda AS varchar) || '02100002' || seq7 AS line FROM numbered
  UNION ALL
  SELECT file_id, file_no, batch_no, src_key, start + 1 + used_to, '7',
    '705' || rpad('ORDER ' || account, 80, ' ') || '0001' || seq7 FROM numbered WHERE has_addenda = 1
  UNION ALL
  SELECT file_id, file_no, batch_no, NULL, start + 1, '5',
    '5200' || rpad('ACME CORP', 16, ' ') || repeat(' ', 20) || '1234567890PPD' || rpad('PAYROLL', 10, ' ')
      || repeat(' ', 6) || substr(cast(file_no AS varchar), 3, 2) || lpad(cast(batch_no AS varchar), 2, '0') || '15'
      || '   1' || '02100002' || lpad(cast(batch_no AS varchar), 7, '0') FROM placed
  UNION ALL
  SELECT file_id, file_no, batch_no, NULL, start + 2 + entries + addenda, '8',
    '8200' || lpad(cast(entries + addenda AS varchar), 6, '0') || lpad(cast(entry_hash AS varchar), 10, '0')
      || lpad(cast(debit_cents AS varchar), 12, '0') || lpad(cast(credit_cents AS varchar), 12, '0') || '1234567890'
      || repeat(' ', 25) || '02100002' || lpad(cast(batch_no AS varchar), 7, '0') FROM placed
  UNION ALL
  SELECT file_id, file_no, NULL, NULL, 1, '1',
    '101 0210000211234567890' || substr(cast(file_no AS varchar), 3, 2) || '12311200A094101'
      || rpad('FEDERAL RESERVE BK', 23, ' ') || rpad('ACME CORP', 23, ' ') || repeat(' ', 8) FROM files
  UNION ALL
  SELECT file_id, file_no, NULL, NULL, lines, '9',
    '9' || lpad(cast(batches AS varchar), 6, '0') || lpad(cast(blocks AS varchar), 6, '0')
      || lpad(cast(entry_addenda AS varchar), 8, '0') || lpad(cast(entry_hash AS varchar), 10, '0')
      || lpad(cast(debit_cents AS varchar), 12, '0') || lpad(cast(credit_cents AS varchar), 12, '0')
      || repeat(' ', 39) FROM files
  UNION ALL
  SELECT file_id, file_no, NULL, NULL, unnest(range(lines + 1, blocks * 10 + 1)), 'padding', repeat('9', 94) FROM files)"""

LINES = CLEAN_LINES + """,
lines AS (
  SELECT file_id, file_no, batch_no, src_key, cast(line_no AS bigint) AS line_no, record_type,
    CASE WHEN record_type = '6' AND src_key % 101 = 0 THEN substr(d4, 1, 93) ELSE d4 END AS line
  FROM (SELECT *, CASE
      WHEN record_type = '6' AND src_key % 509 = 0 THEN 'X' || substr(d2, 2)
      WHEN record_type = '7' AND src_key % 83 = 0 THEN substr(d2, 1, 87) || '9999999'
      WHEN record_type = '8' AND (file_no * 12 + batch_no) % 13 = 0
        THEN substr(d2, 1, 4) || lpad(cast(cast(substr(d2, 5, 6) AS int) + 1 AS varchar), 6, '0') || substr(d2, 11)
      WHEN record_type = '5' AND (file_no * 12 + batch_no) % 17 = 0 THEN substr(d2, 1, 79) || '02100009' || substr(d2, 88)
      WHEN record_type = '9' AND file_no % 5 = 0
        THEN substr(d2, 1, 1) || lpad(cast(cast(substr(d2, 2, 6) AS int) + 1 AS varchar), 6, '0') || substr(d2, 8)
      ELSE d2 END AS d4
    FROM (SELECT *, CASE WHEN record_type = '6' AND src_key % 89 = 0
        THEN substr(d1, 1, 29) || 'X' || substr(d1, 31) ELSE d1 END AS d2
      FROM (SELECT *, CASE WHEN record_type = '6' AND src_key % 97 = 0
          THEN substr(line, 1, 11) || cast((cast(substr(line, 12, 1) AS int) + 1) % 10 AS varchar) || substr(line, 13)
          ELSE line END AS d1 FROM clean_lines))))"""


# --------------------------------------------------------------------------------------------- card and GL files
CARD_VALUES = {
    "record_type": "case l_returnflag when 'A' then '05' when 'R' then '07' else '06' end",
    "transaction_code": "if(l_linestatus = 'F', '00', '20')", "primary_account_number": "pan",
    "processing_code": "'000000'", "transaction_amount": "amount_cents", "transaction_currency": "'840'",
    "transaction_date": "day", "transaction_time": "'120000'", "expiry_date": "'2912'", "pos_entry_mode": "'051'",
    "pos_condition_code": "'00'", "acquirer_institution_id": "l_suppkey",
    "retrieval_reference_number": "lpad(cast(l_orderkey as string), 12, '0')",
    "authorization_code": "lpad(cast(l_partkey as string), 6, '0')", "response_code": "'00'",
    "terminal_id": "lpad(cast(l_suppkey as string), 8, '0')", "merchant_id": "lpad(cast(l_suppkey as string), 16, '0')",
    "merchant_name": "concat('MERCHANT ', cast(l_suppkey as string))", "merchant_city": "'CHICAGO'",
    "merchant_country": "'840'", "mcc": "'5411'", "network_id": "'0001'", "cvv2_result_code": "'M'",
    "avs_result_code": "'Y'", "settle_date": "day", "interchange_fee": "cast(round(l_tax * 100) as int)",
    "cardholder_name": "concat('HOLDER ', cast(l_orderkey as string))",
}
GL_VALUES = {n: n for n in ("status effective_date code_combination_id segment1 segment2 segment3 segment4 segment5 "
                            "entered_dr entered_cr description").split()}
GL_HEADER = {"status": "'N'", "ledger_id": "'1001'", "accounting_date": "'01-JAN-2026'", "currency_code": "'USD'",
             "actual_flag": "'A'", "user_je_source_name": "'Payables'", "user_je_category_name": "'Accrual'",
             "balanced_je_flag": "'Y'"}


def card_lines(spark: SparkSession, folder: str) -> DataFrame:
    def build(s, f):
        return derived.damage_card(synth.card_files(derived.card_details(s, f), derived.CARD_ORDER, CARD_VALUES))
    return landed(spark, folder, "card-lines", build).select("file_id", "line_no", "line")


def gl_lines(spark: SparkSession, folder: str) -> DataFrame:
    def build(s, f):
        return synth.gl_files(derived.gl_rows(s, f), derived.CARD_ORDER, GL_VALUES, GL_HEADER)
    return landed(spark, folder, "gl-lines", build)


def luhn_sql(x: str) -> str:
    """Check digit of a 15-digit partial number."""
    terms = "+".join(f"cast(substr('0246813579', cast(substr({x},{i},1) AS int)+1, 1) AS int)" if i % 2 == 1
                     else f"cast(substr({x},{i},1) AS int)" for i in range(1, 16))
    return f"((10-({terms})%10)%10)"


_ORDER = ("l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, "
          "l_returnflag, l_linestatus")
CARD_LINES = f"""
card_details AS (
  SELECT *, 'card-' || cast(l_suppkey AS varchar) AS file_id, cast(round(l_extendedprice * 100) AS bigint) AS amount_cents,
    strftime(l_shipdate, '%y%m%d') AS day, pan15 || cast({luhn_sql('pan15')} AS varchar) AS pan,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) AS seq
  FROM (SELECT *, '4' || lpad(cast(l_orderkey AS varchar), 8, '0') || lpad(cast(l_partkey AS varchar), 6, '0') AS pan15
        FROM lineitem)),
card_body AS (
  SELECT file_id, l_orderkey AS k, cast(seq + 1 AS bigint) AS line_no,
    CASE l_returnflag WHEN 'A' THEN '05' WHEN 'R' THEN '07' ELSE '06' END
      || CASE WHEN l_linestatus = 'F' THEN '00' ELSE '20' END
      || CASE WHEN l_orderkey % 97 = 0 THEN substr(pan, 1, 15) || cast((cast(substr(pan, 16, 1) AS int) + 1) % 10 AS varchar)
         ELSE pan END || '000000'
      || CASE WHEN l_orderkey % 89 = 0 THEN 'X' || substr(lpad(cast(amount_cents AS varchar), 10, '0'), 2)
         ELSE lpad(cast(amount_cents AS varchar), 10, '0') END
      || '840' || day || '120000' || CASE WHEN l_orderkey % 103 = 0 THEN 'ABCD' ELSE '2912' END || '05100'
      || lpad(cast(l_suppkey AS varchar), 11, '0') || lpad(cast(l_orderkey AS varchar), 12, '0')
      || lpad(cast(l_partkey AS varchar), 6, '0') || CASE WHEN l_orderkey % 101 = 0 THEN '99' ELSE '00' END
      || lpad(cast(l_suppkey AS varchar), 8, '0') || lpad(cast(l_suppkey AS varchar), 16, '0')
      || rpad('MERCHANT ' || cast(l_suppkey AS varchar), 25, ' ') || rpad('CHICAGO', 13, ' ') || '84054110001MY' || day
      || lpad(cast(cast(round(l_tax * 100) AS int) AS varchar), 8, '0')
      || rpad('HOLDER ' || cast(l_orderkey AS varchar), 26, ' ') || repeat(' ', 14) AS line
  FROM card_details),
card_totals AS (SELECT file_id, cast(count(*) AS bigint) AS n, cast(sum(amount_cents) AS bigint) AS amount
  FROM card_details GROUP BY 1),
card_lines AS (
  SELECT file_id, line_no, line FROM card_body
  UNION ALL SELECT file_id, 1, rpad('H260101000000000010001', 220, ' ') FROM card_totals
  UNION ALL SELECT file_id, n + 2, rpad('T' || lpad(cast(n + CASE WHEN length(file_id) = 6 THEN 1 ELSE 0 END AS varchar), 10, '0')
    || lpad(cast(amount AS varchar), 14, '0'), 220, ' ') FROM card_totals)"""

GL_LINES = f"""
gl_rows AS (
  SELECT 'gl-' || cast(year(l_shipdate) AS varchar) AS file_id, *,
    row_number() OVER (PARTITION BY year(l_shipdate) ORDER BY {_ORDER}) AS seq,
    upper(strftime(l_shipdate, '%d-%b-%Y')) AS day, cast(round(l_extendedprice * 100) AS bigint) AS c FROM lineitem),
gl_lines AS (
  SELECT file_id, cast(seq + 2 AS bigint) AS line_no, concat_ws('|',
    CASE WHEN l_orderkey % 97 = 0 THEN 'N1' ELSE 'N' END,
    CASE WHEN l_orderkey % 101 = 0 THEN '31-FEB' || substr(day, 7) ELSE day END, cast(l_partkey AS varchar),
    CASE WHEN l_orderkey % 103 = 0 THEN '' ELSE cast(1000 + l_suppkey AS varchar) END, l_returnflag,
    cast(l_linenumber AS varchar), l_linestatus, '',
    cast(c // 100 AS varchar) || '.' || lpad(cast(c % 100 AS varchar), 2, '0')
      || CASE WHEN l_orderkey % 89 = 0 THEN 'X' ELSE '' END, '0', '', '',
    'JOURNAL ENTRY ' || cast(l_orderkey AS varchar), '', '', '', '') AS line FROM gl_rows
  UNION ALL SELECT DISTINCT file_id, 1, '{"|".join(f.name.upper() for f in synth.GL.of("HEADER"))}' FROM gl_rows
  UNION ALL SELECT DISTINCT file_id, 2, 'N|1001|01-JAN-2026|USD|||A|Payables|Accrual|||Y|' FROM gl_rows)"""


# ------------------------------------------------------------------------------------- oracle: generic field checks
def _lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (tuple, list)):
        return "[" + ", ".join(_lit(v) for v in x) + "]::varchar[]"
    return "'" + x.replace("'", "''") + "'"


def spec_values(spec) -> str:
    """The spec as an inline table, so that the oracle checks values by a join instead of compiled expressions."""
    rows = []
    for f in spec.fields:
        rows.append("(" + ", ".join([
            _lit(f.record_type), str(f.pos), _lit(f.name), _lit(f.data_type), f"{_lit(f.start)}::int",
            f"{_lit(f.end)}::int", f"{_lit(f.length)}::int", _lit(f.required), f"{_lit(f.fixed)}::varchar",
            f"{_lit(f.fmt)}::varchar", _lit(f.allowed), f"{_lit(f.min_len)}::int", f"{_lit(f.max_len)}::int",
            f"{_lit(f.min_value)}::double", f"{_lit(f.max_value)}::double", f"{_lit(f.pattern)}::varchar",
            f"{_lit(f.checksum)}::varchar"]) + ")")
    return ("spec(record_type, pos, field, dt, s, e, len, req, fixed, fmt, allowed, minl, maxl, minv, maxv, pattern, cks)"
            " AS (VALUES " + ",\n".join(rows) + ")")


NUM = r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'"
ABA9 = ("(regexp_full_match({x}, '[0-9]{{9}}') AND list_sum([cast(substr({x}, i, 1) AS int) * [3,7,1,3,7,1,3,7,1][i] "
        "FOR i IN range(1, 10)]) % 10 = 0)")


def aba9(x: str) -> str:
    return ABA9.format(x=x)


DATE_OK = """(CASE coalesce(fmt, 'YYMMDD')
    WHEN 'YYYYMMDD' THEN regexp_full_match(v, '[0-9]{8}') AND try_strptime(v, '%Y%m%d') IS NOT NULL
    WHEN 'MMDD' THEN regexp_full_match(v, '[0-9]{4}') AND try_strptime('1970' || v, '%Y%m%d') IS NOT NULL
    WHEN 'DD-MON-YYYY' THEN regexp_full_match(v, '[0-9]{2}-[A-Za-z]{3}-[0-9]{4}') AND try_strptime(v, '%d-%b-%Y') IS NOT NULL
    ELSE regexp_full_match(v, '[0-9]{6}') AND try_strptime('20' || v, '%Y%m%d') IS NOT NULL END)"""

LENIENT_CHECKS = f"""
lenient AS (SELECT *, CASE
    WHEN fixed IS NOT NULL AND v <> fixed THEN ['FIXED']
    WHEN v = '' THEN CASE WHEN req THEN ['REQUIRED'] ELSE []::varchar[] END
    ELSE list_filter([
      CASE WHEN length(v) > len THEN 'LENGTH' END,
      CASE WHEN NOT tok THEN CASE dt WHEN 'date' THEN 'DATE' WHEN 'routing_number' THEN 'ROUTING' ELSE 'TYPE' END END,
      CASE WHEN len(allowed) > 0 AND NOT list_contains(allowed, v) THEN 'ALLOWED' END], lambda x: x IS NOT NULL) END AS codes,
    CASE WHEN fixed IS NOT NULL AND v <> fixed THEN 0 WHEN v = '' THEN CASE WHEN req THEN 0 ELSE 1 END
      ELSE CASE WHEN length(v) > len THEN 0 ELSE 1 END + CASE WHEN tok THEN 1 ELSE 0 END END AS good
  FROM (SELECT *, CASE dt WHEN 'numeric' THEN regexp_full_match(v, '[0-9]+')
      WHEN 'alpha' THEN regexp_full_match(v, '[A-Za-z ]+')
      WHEN 'amount' THEN regexp_full_match(v, '[0-9]+(\\.[0-9]{{0,2}})?')
      WHEN 'date' THEN {DATE_OK}
      WHEN 'routing_number' THEN CASE
        WHEN len = 8 AND record_type = '6' THEN {aba9("v || nxt")}
        WHEN len = 8 THEN regexp_full_match(v, '[0-9]{{8}}')
        ELSE {aba9("regexp_replace(v, '[^0-9]', '', 'g')")} END
      ELSE true END AS tok FROM fv))"""

ACH_TYPED = """
typed AS (SELECT file_id, line_no, line, CASE WHEN line = repeat('9', 94) THEN 'padding'
    WHEN substr(line, 1, 1) IN ('1', '5', '6', '7', '8', '9') THEN substr(line, 1, 1) END AS record_type FROM lines)"""


def ach_checks() -> str:
    from tallyframe.sources.layouts import ACH
    return f"""WITH {LINES}, {ACH_TYPED}, {spec_values(ACH)},
fv AS (SELECT t.file_id, t.line_no, s.*, trim(CASE WHEN length(line) >= e THEN substr(line, s, e - s + 1) ELSE '' END) AS v,
    trim(CASE WHEN length(line) >= 12 THEN substr(line, 12, 1) ELSE '' END) AS nxt
  FROM typed t JOIN spec s USING (record_type)), {LENIENT_CHECKS}"""


def gl_checks() -> str:
    from tallyframe.sources.layouts import GL
    return f"""WITH {GL_LINES}, {spec_values(GL)},
typed AS (SELECT *, CASE WHEN line_no = 1 THEN 'names' WHEN len(string_split(line, '|')) = 13 THEN 'HEADER'
  ELSE 'LINE' END AS record_type FROM gl_lines),
fv AS (SELECT t.file_id, t.line_no, s.*, trim(coalesce(string_split(line, '|')[pos], '')) AS v, '' AS nxt
  FROM typed t JOIN spec s USING (record_type)), {LENIENT_CHECKS}"""


LUHN_OK = """(length(regexp_replace(v, '[^0-9]', '', 'g')) >= 13 AND list_sum([
    CASE WHEN i % 2 = 0 THEN cast(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS int) * 2
      - CASE WHEN cast(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS int) * 2 > 9 THEN 9 ELSE 0 END
    ELSE cast(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS int) END
    FOR i IN range(1, length(regexp_replace(v, '[^0-9]', '', 'g')) + 1)]) % 10 = 0)"""


def card_checks() -> str:
    from tallyframe.sources.layouts import CARD
    num = "try_cast(CASE WHEN regexp_full_match(trim(replace(v, ',', '')), " + NUM + ") THEN trim(replace(v, ',', '')) END AS double)"
    return f"""WITH {CARD_LINES}, {spec_values(CARD)},
typed AS (SELECT *, CASE substr(line, 1, 1) WHEN 'H' THEN 'HEADER' WHEN 'T' THEN 'TRAILER' ELSE 'DETAIL' END AS record_type
  FROM card_lines),
fv AS (SELECT t.file_id, t.line_no, s.*, CASE WHEN length(line) >= e THEN substr(line, s, e - s + 1) ELSE '' END AS v
  FROM typed t JOIN spec s USING (record_type)),
tested AS (SELECT *, [
    CASE WHEN minl IS NOT NULL THEN CASE WHEN length(v) < minl THEN 'MIN_LENGTH' ELSE '' END END,
    CASE WHEN maxl IS NOT NULL THEN CASE WHEN length(v) > maxl THEN 'MAX_LENGTH' ELSE '' END END,
    CASE WHEN len(allowed) > 0 THEN CASE WHEN NOT list_contains(allowed, v) THEN 'ALLOWED' ELSE '' END END,
    CASE WHEN pattern IS NOT NULL THEN CASE WHEN NOT regexp_full_match(v, pattern) THEN 'PATTERN' ELSE '' END END,
    CASE WHEN dt IN ('numeric', 'amount') THEN CASE WHEN {num} IS NULL THEN 'NOT_NUMERIC' ELSE '' END END,
    CASE WHEN dt IN ('numeric', 'amount') AND minv IS NOT NULL THEN CASE WHEN {num} < minv THEN 'MIN_VALUE' ELSE '' END END,
    CASE WHEN dt IN ('numeric', 'amount') AND maxv IS NOT NULL THEN CASE WHEN {num} > maxv THEN 'MAX_VALUE' ELSE '' END END,
    CASE WHEN cks = 'luhn' THEN CASE WHEN NOT {LUHN_OK} THEN 'LUHN' ELSE '' END END] AS t FROM fv),
strict AS (SELECT *, CASE WHEN trim(v) = '' THEN CASE WHEN req THEN ['REQUIRED'] ELSE []::varchar[] END
    ELSE list_filter(t, lambda x: x <> '') END AS codes,
  CASE WHEN trim(v) = '' THEN CASE WHEN req THEN 0 ELSE 1 END ELSE len(list_filter(t, lambda x: x = '')) END AS good
  FROM tested)"""
