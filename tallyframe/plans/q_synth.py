"""Queries: value generators, rendering, sources and sinks (round trips through written files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import checks, fixed, seeded
from tallyframe.operators import computed, generate, ordered, sinks, synth, validate
from tallyframe.plans import shared
from tallyframe.plans.registry import query
from tallyframe.plans.shared import LINES, _lit
from tallyframe.session import scratch_path, spread
from tallyframe.sources import derived, files, layouts
from tallyframe.sources.layouts import CARD, GL, TCR0, Field

SEED, AS_OF = 7, "2026-04-15"


# ------------------------------------------------------------------------- the same seeded formulas in oracle SQL
def u(row: str, field: str) -> str:
    return f"(('0x' || substr(md5('{SEED}|' || cast({row} AS varchar) || '|{field}'), 1, 8))::bigint)"


def o_pick(row, field, values):
    return f"([{', '.join(_lit(v) for v in values)}])[{u(row, field)} % {len(values)} + 1]"


def o_between(row, field, low, high):
    drawn = u(row, field) if high - low < 1 << 24 else f"(('0x' || substr({o_md5(row, field)}, 1, 15))::bigint)"
    return f"({drawn} % {high - low + 1} + {low})"


def o_md5(row, field):
    return f"md5('{SEED}|' || cast({row} AS varchar) || '|{field}')"


def o_digits(row, field, width):
    halves = " || ".join(f"lpad(cast(('0x' || substr({o_md5(row, f'{field}#{i // 2}')}, {i % 2 * 16 + 1}, 15))::bigint % 100000000 AS varchar), 8, '0')" for i in range((width + 7) // 8))
    return f"substr({halves}, 1, {width})"


def o_symbols(row, field, width, kept):
    """Symbols of ``kept`` out of base-64 text, in upper case."""
    blocks = " || ".join(f"substr(to_base64(unhex({o_md5(row, f'{field}#{i}')})), 1, 21)" for i in range(seeded.blocks_for(width)))
    return f"substr(upper(regexp_replace({blocks}, '[^{kept}]', '', 'g')), 1, {width})"


def o_alnum(row, field, width):
    return o_symbols(row, field, width, "a-z0-9")


def o_letters(row, field, width):
    return o_symbols(row, field, width, "A-Za-z")


def o_other(row, field, other, values):
    """A value that differs from the one drawn for ``other``."""
    n = len(values)
    return f"([{', '.join(_lit(v) for v in values)}])[({u(row, other)} % {n} + 1 + {u(row, field)} % {n - 1}) % {n} + 1]"


def o_person(row, field):
    return f"{o_pick(row, field + '.first', generate.FIRST_NAMES)} || ' ' || {o_pick(row, field + '.last', generate.LAST_NAMES)}"


def o_account(row, field, width):
    return f"(cast({o_between(row, field + '.lead', 1, 9)} AS varchar) || {o_digits(row, field, width - 1)})"


def o_amount(row, field, width, low=100, high=999_999):
    return f"lpad(cast({o_between(row, field, low, high)} AS varchar), {width}, '0')"


def o_near(row, field, days=30):
    return f"(DATE '{AS_OF}' + cast({o_between(row, field, 0, 2 * days)} - {days} AS int))"


def customers(spark, folder):
    """What drives the generators, in many tasks: a generated row costs far more than a read one."""
    return spread(derived.table(spark, folder, "customer"))


K = "c_custkey"


def gen(spark, folder, **cols):
    return customers(spark, folder).select("c_custkey", *[F.expr(text).alias(name) for name, text in cols.items()])


@query("g2_card_numbers", f"""SELECT c_custkey, partial || cast({shared.luhn_sql('partial')} AS varchar) AS pan FROM (
  SELECT c_custkey, {o_pick(K, 'pan.bin', generate.CARD_PREFIXES)} || {o_digits(K, 'pan', 11)} AS partial FROM customer)""")
def g2(spark, folder):
    return gen(spark, folder, pan=generate.card_number(SEED, K))


@query("g3_routing_numbers", f"""SELECT c_custkey, {o_pick(K, 'routing', generate.ROUTING_NUMBERS)} AS listed, d || cast({shared.aba_sql('d')} AS varchar) AS computed
  FROM (SELECT c_custkey, {o_digits(K, 'own', 8)} AS d FROM customer)""")
def g3(spark, folder):
    return gen(spark, folder, listed=generate.listed_routing(SEED, K), computed=generate.computed_routing(SEED, K, "own"))


@query("g4_account_numbers", f"SELECT c_custkey, {o_account(K, 'acct', 12)} AS account, {o_account(K, 'long', 17)} AS longest FROM customer")
def g4(spark, folder):
    return gen(spark, folder, account=generate.account_number(SEED, K, "acct", 12), longest=generate.account_number(SEED, K, "long", 40))


@query("g5_amounts", f"SELECT c_custkey, {o_amount(K, 'amt', 10)} AS amount, {o_amount(K, 'small', 10, 5, 9)} AS small FROM customer")
def g5(spark, folder):
    return gen(spark, folder, amount=generate.amount(SEED, K, "amt", 10), small=generate.amount(SEED, K, "small", 10, 5, 9))


@query("g6_primitive_values", f"""SELECT c_custkey, lpad(cast({o_between(K, 'num', 1, 9999)} AS varchar), 6, '0') AS numeric_value, {o_alnum(K, 'an', 40)} AS alphanumeric_value,
  {o_letters(K, 'al', 8)} AS alpha_value, {o_pick(K, 'bool', ('true', 'false'))} AS boolean_value, cast({o_between(K, 'cvv', 100, 999)} AS varchar) AS cvv FROM customer""")
def g6(spark, folder):
    cvv = generate.raw_value(Field("R", "cvv", "cvv", length=3), SEED, K, AS_OF)
    flag = generate.raw_value(Field("R", "bool", "boolean"), SEED, K, AS_OF)
    return gen(spark, folder, numeric_value=generate.numeric(SEED, K, "num", 6), alphanumeric_value=seeded.alnum(SEED, K, "an", 40),
               alpha_value=seeded.letters(SEED, K, "al", 8), boolean_value=flag, cvv=cvv)


@query("g7_dates", f"""SELECT c_custkey, strftime(DATE '{AS_OF}' - cast({o_between(K, 'd', 0, 180)} AS int), '%Y%m%d') AS recent, strftime({o_near(K, 'n')}, '%y%m%d') AS near,
  strftime(DATE '{AS_OF}' + to_months(cast({o_between(K, 'e', 6, 60)} AS int)), '%y%m') AS expiry, strftime(DATE '{AS_OF}' + to_months(cast({o_between(K, 'e', 6, 60)} AS int)), '%m/%y') AS expiry_slash,
  lpad(cast({o_between(K, 't.h', 0, 23)} AS varchar), 2, '0') || lpad(cast({o_between(K, 't.m', 0, 59)} AS varchar), 2, '0') AS clock FROM customer""")
def g7(spark, folder):
    return gen(spark, folder, recent=generate.render_date(generate.recent_date(SEED, K, "d", AS_OF), "YYYYMMDD"),
               near=generate.render_date(generate.near_date(SEED, K, "n", AS_OF), "YYMMDD"),
               expiry=generate.expiry(SEED, K, "e", AS_OF), expiry_slash=generate.expiry(SEED, K, "e", AS_OF, "MM/YY"),
               clock=generate.clock(SEED, K, "t"))


@query("g8_named_strings", f"""SELECT c_custkey, rpad({o_person(K, 'cardholder_name')}, 26, ' ') AS cardholder, rpad({o_pick(K, 'merchant_name', generate.MERCHANTS)}, 25, ' ') AS merchant,
  rpad({o_pick(K, 'company_name', generate.COMPANIES)}, 16, ' ') AS company, rpad({o_pick(K, 'merchant_city', generate.CITIES)}, 13, ' ') AS city,
  rpad({o_pick(K, 'description', generate.DESCRIPTIONS)} || ' ' || cast({o_between(K, 'description.no', 1000, 9999)} AS varchar), 20, ' ') AS description FROM customer""")
def g8(spark, folder):
    def text(name, width):
        return generate.value(Field("R", name, "string", length=width), SEED, K, AS_OF)
    return gen(spark, folder, cardholder=text("cardholder_name", 26), merchant=text("merchant_name", 25),
               company=text("company_name", 16), city=text("merchant_city", 13), description=text("description", 20))


@query("g9_enum_constant_sequence", f"""SELECT c_custkey, {o_pick(K, 'sec', ('PPD', 'CCD', 'CTX'))} AS enum_value, '094' AS constant_value,
  lpad(cast(row_number() OVER (ORDER BY c_custkey) AS varchar), 7, '0') AS sequence_value FROM customer""")
def g9(spark, folder):
    numbered = ordered.numbered(customers(spark, folder), [], ["c_custkey"], "rn", sparse=True)
    enum = generate.value(Field("R", "sec", "enum", length=3, allowed=("PPD", "CCD", "CTX")), SEED, K, AS_OF)
    const = generate.value(Field("R", "size", "constant", length=3, default="094"), SEED, K, AS_OF)
    seq = generate.value(Field("R", "n", "sequence", length=7, justify="right", pad="0"), SEED, K, AS_OF, "rn")
    return numbered.selectExpr("c_custkey", f"{enum} as enum_value", f"{const} as constant_value", f"{seq} as sequence_value")


@query("g10_card_totals", """SELECT 'card-' || cast(l_suppkey AS varchar) AS file_id, lpad(cast(count(*) AS varchar), 8, '0') AS total_records,
  lpad(cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS varchar), 15, '0') AS total_amount,
  lpad(cast(sum(cast(round(l_extendedprice * 100) AS bigint)) % 10000000000 AS varchar), 10, '0') AS file_hash FROM lineitem GROUP BY 1""")
def g10_totals(spark, folder):
    formulas = {"total_records": ("total_records", 8), "total_amount": ("total_amount", 15), "file_hash": ("total_amount % 10000000000", 10)}
    totals = synth.card_totals(derived.card_details(spark, folder), "file_id")
    return totals.selectExpr("file_id", *[f"{fixed.fit(t, w, 'right', '0')} as {n}" for n, (t, w) in formulas.items()])


def _pay_spec():
    """A settlement batch whose totals, nets and check digits follow from its other fields."""
    cells = {"HDR": (("record_id", 3, "constant", "HDR"), ("declared", 8, "computed", None), ("declared_check", 1, "checksum", None)),
             "TXN": (("record_id", 3, "constant", "TXN"), ("pan_body", 15, "numeric", None), ("pan_check", 1, "checksum", None), ("amount", 12, "amount", None), ("fee", 12, "computed", None),
                     ("net", 12, "computed", None), ("account", 10, "account_number", None), ("account_check", 2, "checksum", None)),
             "TRL": (("record_id", 3, "constant", "TRL"), ("total_records", 8, "computed", None), ("total_amount", 15, "computed", None), ("total_net", 15, "computed", None), ("file_hash", 10, "checksum", None))}
    fields = []
    for kind, row in cells.items():
        at = 1
        for pos, (name, width, data_type, default) in enumerate(row, 1):
            text = data_type == "constant"
            fields.append(Field(kind, name, data_type, at, at + width - 1, width, default=default, justify="left" if text else "right", pad=" " if text else "0", pos=pos))
            at += width
    records = tuple(layouts.Record(kind, kind, category, i, sum(w for _, w, _, _ in cells[kind])) for i, (kind, category) in enumerate((("HDR", "header"), ("TXN", "detail"), ("TRL", "trailer"))))
    return layouts.Spec("settlement", "fixed_width", "", records, tuple(fields))


PAY = _pay_spec()
PAY_FORMULAS = [
    computed.Formula("HDR", "declared", ("TRL.total_records",), "copy", "cast(total_records as bigint) + 2"),
    computed.Formula("HDR", "declared_check", ("declared",), "aba", ""),
    computed.Formula("TXN", "pan_check", ("pan_body",), "luhn", ""),
    computed.Formula("TXN", "fee", ("amount",), "row", "cast(amount as bigint) * 15 div 1000"),
    computed.Formula("TXN", "net", ("amount", "fee"), "row", "cast(amount as bigint) - cast(fee as bigint)"),
    computed.Formula("TXN", "account_check", ("account",), "mod97", ""),
    computed.Formula("TRL", "total_records", ("TXN.amount",), "total", "count(amount)"),
    computed.Formula("TRL", "total_amount", ("TXN.amount",), "total", "sum(cast(amount as bigint))"),
    computed.Formula("TRL", "total_net", ("TXN.net",), "total", "sum(cast(net as bigint))"),
    computed.Formula("TRL", "file_hash", ("total_amount",), "row", "cast(total_amount as bigint) % 10000000000"),
]
_TXN_KEY = "concat(l_orderkey, '-', l_linenumber)"
_O_KEY = "(l_orderkey || '-' || l_linenumber)"


@query("g10_computed_fields", f"""WITH txn AS (SELECT 'pay-' || l_suppkey AS file_id, {_O_KEY} AS txn, {o_digits(_O_KEY, 'pan_body', 15)} AS pan, cast(round(l_extendedprice * 100) AS bigint) AS amount,
    {o_account(_O_KEY, 'account', 10)} AS account FROM lineitem),
  paid AS (SELECT *, amount * 15 // 1000 AS fee, amount - amount * 15 // 1000 AS net, cast({shared.luhn_sql('pan')} AS varchar) AS pan_check, lpad(cast(98 - cast(account AS hugeint) * 100 % 97 AS varchar), 2, '0') AS account_check FROM txn),
  sums AS (SELECT file_id, count(*) AS n, sum(amount) AS amount, sum(net) AS net FROM paid GROUP BY 1),
  heads AS (SELECT file_id, lpad(cast(n + 2 AS varchar), 8, '0') AS declared FROM sums)
  SELECT file_id, '' AS txn, 'HDR' || declared || cast({shared.aba_sql('declared')} AS varchar) AS line FROM heads
  UNION ALL SELECT file_id, txn, 'TXN' || pan || pan_check || lpad(cast(amount AS varchar), 12, '0') || lpad(cast(fee AS varchar), 12, '0') || lpad(cast(net AS varchar), 12, '0') || account || account_check FROM paid
  UNION ALL SELECT file_id, '', 'TRL' || lpad(cast(n AS varchar), 8, '0') || lpad(cast(amount AS varchar), 15, '0') || lpad(cast(net AS varchar), 15, '0') || lpad(cast(amount % 10000000000 AS varchar), 10, '0') FROM sums""")
def g10(spark, folder):
    """Whole settlement files: rows generated first, then every field that follows from others, rendered as lines."""
    items = derived.table(spark, folder, "lineitem").withColumns({"file_id": F.concat(F.lit("pay-"), "l_suppkey"), "txn": F.expr(_TXN_KEY)})
    drives = {"TXN": items, "HDR": items.select("file_id").distinct().withColumn("txn", F.lit("")), "TRL": items.select("file_id").distinct().withColumn("txn", F.lit(""))}
    batch = {kind: generate.rows(drive, PAY, kind, SEED, _TXN_KEY if kind == "TXN" else "file_id", AS_OF, keep=("file_id", "txn"),
                                 overrides={"amount": "cast(round(l_extendedprice * 100) as bigint)"}) for kind, drive in drives.items()}
    done = computed.filled(batch, PAY, PAY_FORMULAS, ["file_id"])
    parts = [generate.lines(rows, PAY, kind, keep=("file_id", "txn")) for kind, rows in done.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def o_tcr0():
    r = K
    cells = {
        "transaction_code": o_pick(r, "transaction_code", ("05", "06", "08", "25", "26", "28")),
        "function_code": o_digits(r, "function_code", 3), "message_reason_code": o_digits(r, "message_reason_code", 4),
        "card_acceptor_bin": o_digits(r, "card_acceptor_bin", 6), "acquirer_country_code": o_pick(r, "acquirer_country_code", generate.COUNTRIES),
        "acquirer_currency_code": o_digits(r, "acquirer_currency_code", 3), "account_number": o_account(r, "account_number", 14),
        "account_number_ext": o_account(r, "account_number_ext", 6), "purchase_date": f"strftime({o_near(r, 'purchase_date')}, '%m%d')",
        "transaction_amount": o_amount(r, "transaction_amount", 12), "transaction_currency": o_digits(r, "transaction_currency", 3),
        "cardholder_amount": o_amount(r, "cardholder_amount", 12), "cardholder_currency": o_digits(r, "cardholder_currency", 3),
        "authorization_code": o_alnum(r, "authorization_code", 6), "authorization_date": f"strftime({o_near(r, 'authorization_date')}, '%m%d')",
        "merchant_name": f"rpad({o_pick(r, 'merchant_name', generate.MERCHANTS)}, 25, ' ')",
        "merchant_city": f"rpad({o_pick(r, 'merchant_city', generate.CITIES)}, 13, ' ')",
        "merchant_country_code": o_pick(r, "merchant_country_code", generate.COUNTRIES),
        "merchant_zip": f"rpad(cast({o_between(r, 'merchant_zip', 10000, 99999)} AS varchar), 9, ' ')",
        "merchant_state": o_pick(r, "merchant_state", generate.STATES), "merchant_category_code": o_pick(r, "merchant_category_code", generate.MCC_CODES),
        "pos_entry_mode": o_pick(r, "pos_entry_mode", ("01", "02", "03", "05", "07", "10", "90", "91")),
    }
    return cells


@query("g1_spec_rows", "SELECT c_custkey, " + ", ".join(f"{v} AS {n}" for n, v in o_tcr0().items()) + " FROM customer")
def g1(spark, folder):
    return generate.rows(customers(spark, folder), TCR0, "TCR0", SEED, K, AS_OF, keep=("c_custkey",))


@query("p2_render_fixed", "SELECT c_custkey, rpad(" + " || ".join(o_tcr0().values()) + ", 145, ' ') AS line FROM customer")
def p2(spark, folder):
    return generate.lines(g1(spark, folder), TCR0, "TCR0", keep=("c_custkey",))


@query("c7_generate_and_validate", """SELECT 'generated' AS file_id, cast(count(*) AS bigint) AS total_records, cast(count(*) * 44 AS bigint) AS passed, 0::bigint AS failed,
  0::bigint AS warnings, 0::bigint AS records_with_errors, true AS is_valid, 100.0::double AS score FROM customer""")
def c7(spark, folder):
    """Generated card records validated with the spec they came from; the report must show no failure."""
    lines = generate.lines(g1(spark, folder), TCR0, "TCR0", keep=("c_custkey",)).selectExpr(
        "'generated' as file_id", "c_custkey as line_no", "line")
    return validate.report(validate.checked(lines, TCR0))


@query("g13_delimited_from_spec", f"""SELECT c_custkey, concat_ws('|', {o_pick(K, 'status', ('Y', 'N'))}, upper(strftime({o_near(K, 'effective_date')}, '%d-%b-%Y')), {o_digits(K, 'code_combination_id', 15)},
  {", ".join(f"cast({o_between(K, f'segment{i}', 1000, 9999)} AS varchar)" for i in range(1, 6))}, {", ".join(o_amount(K, n, 22) for n in ('entered_dr', 'entered_cr', 'accounted_dr', 'accounted_cr'))},
  {o_pick(K, 'description', generate.DESCRIPTIONS)} || ' ' || cast({o_between(K, 'description.no', 1000, 9999)} AS varchar), {", ".join(o_alnum(K, n, next(f.length or f.max_len for f in GL.fields if f.name == n)) for n in ('attribute1', 'attribute2', 'reference1', 'reference2'))}) AS line FROM customer""")
def g13(spark, folder):
    return generate.lines(generate.rows(customers(spark, folder), GL, "LINE", SEED, K, AS_OF, keep=("c_custkey",)), GL, "LINE", keep=("c_custkey",))


@query("g12_card_files", f"WITH {shared.CARD_LINES} SELECT * FROM card_lines")
def g12(spark, folder):
    return shared.card_lines(spark, folder)


@query("g13_journal_files", f"WITH {shared.GL_LINES} SELECT * FROM gl_lines")
def g13b(spark, folder):
    return shared.gl_lines(spark, folder)


@query("p3_render_delimited", """SELECT s_suppkey, concat_ws('|', cast(s_suppkey AS varchar), trim('  ' || s_name || ' '), coalesce(cast(nullif(s_nationkey, 3) AS varchar), '')) AS line FROM supplier""")
def p3(spark, folder):
    return derived.table(spark, folder, "supplier").selectExpr("s_suppkey", fixed.render_delimited(
        ["s_suppkey", "concat('  ', s_name, ' ')", "nullif(s_nationkey, 3)"], "|") + " as line")


@query("p4_fit_values", """SELECT p_partkey, rpad(p_name, 8, ' ') AS left_cut, lpad(cast(p_size AS varchar), 5, '0') AS right_zero, lpad(p_type, 4, '*') AS right_star FROM part""")
def p4(spark, folder):
    return derived.table(spark, folder, "part").selectExpr(
        "p_partkey", f"{fixed.fit('p_name', 8)} as left_cut", f"{fixed.fit('p_size', 5, 'right')} as right_zero", f"{fixed.fit('p_type', 4, 'right', '*')} as right_star")


@query("p11_constant_fill", """SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), '094') AS record_size, 'X' AS blocking FROM orders""")
def p11(spark, folder):
    return derived.table(spark, folder, "orders").select(
        "o_orderkey", F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("094")).alias("record_size"), F.lit("X").alias("blocking"))


@query("p12_overrides", f"""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN '021000021' ELSE {o_pick(K, 'odfi_routing', generate.ROUTING_NUMBERS)} END AS odfi_routing FROM customer""")
def p12(spark, folder):
    drawn = generate.listed_routing(SEED, K, "odfi_routing")
    return customers(spark, folder).selectExpr("c_custkey", f"coalesce(if(c_nationkey % 2 = 0, '021000021', null), {drawn}) as odfi_routing")


@query("p10_json_payload", """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')""")
def p10(spark, folder):
    rows = derived.table(spark, folder, "lineitem").selectExpr("l_returnflag as _record_type", "l_suppkey as _raw_length", "l_orderkey", "l_partkey", "l_quantity")
    return sinks.payload(rows, ["A", "R"])


@query("w7_sequence_counter", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS seq FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)")
def w7(spark, folder):
    rows = derived.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return ordered.numbered(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "seq", sparse=True)


@query("w8_trace_numbers", "SELECT o_orderkey, '02100002' || lpad(cast(row_number() OVER (ORDER BY o_orderkey) AS varchar), 7, '0') AS trace FROM orders")
def w8(spark, folder):
    numbered = ordered.numbered(derived.table(spark, folder, "orders").select("o_orderkey"), [], ["o_orderkey"], "rn", sparse=True)
    return numbered.selectExpr("o_orderkey", f"{generate.trace_number("'021000021'", 'rn')} as trace")


@query("w9_batch_assignment", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
  b AS (SELECT *, greatest(1, n // 5) AS batches FROM r) SELECT o_orderkey, cast(least((rn - 1) // greatest(1, n // batches), batches - 1) AS bigint) AS batch FROM b""")
def w9(spark, folder):
    orders = derived.table(spark, folder, "orders").select("o_orderkey").withColumn("run", F.lit("all"))
    total = orders.groupBy("run").agg(F.count(F.lit(1)).alias("total"))
    numbered = ordered.numbered(orders, ["run"], ["o_orderkey"], "rn", per_group=total, sparse=True)
    return numbered.selectExpr("o_orderkey", f"{generate.batch_of('rn', 'total')} as batch")


@query("t3_file_order", f"""WITH {shared.CLEAN_LINES} SELECT file_id, record_type, cast(count(*) AS bigint) AS n, cast(min(line_no) AS bigint) AS first_line, cast(max(line_no) AS bigint) AS last_line FROM clean_lines GROUP BY 1, 2""")
def t3(spark, folder):
    return shared.clean_lines(spark, folder).groupBy("file_id", "record_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query("x6_date_rendering", """SELECT o_orderkey, strftime(o_orderdate, '%y%m%d') AS yymmdd, strftime(o_orderdate, '%Y%m%d') AS yyyymmdd, strftime(o_orderdate, '%m%d') AS mmdd,
  upper(strftime(o_orderdate, '%d-%b-%Y')) AS dd_mon_yyyy, strftime(o_orderdate, '%m%d%Y') AS mmddyyyy FROM orders""")
def x6(spark, folder):
    names = {"YYMMDD": "yymmdd", "YYYYMMDD": "yyyymmdd", "MMDD": "mmdd", "DD-MON-YYYY": "dd_mon_yyyy", "MMDDYYYY": "mmddyyyy"}
    return derived.table(spark, folder, "orders").selectExpr("o_orderkey", *[f"{generate.render_date('o_orderdate', f)} as {n}" for f, n in names.items()])


@query("x26_swift_amounts", """SELECT o_orderkey, cast(c // 100 AS varchar) || ',' || lpad(cast(c % 100 AS varchar), 2, '0') AS amount, c AS cents,
  strftime(o_orderdate, '%y%m%d') || 'USD' || cast(c // 100 AS varchar) || ',' || lpad(cast(c % 100 AS varchar), 2, '0') AS tag_32a
  FROM (SELECT *, cast(round(o_totalprice * 100) AS bigint) AS c FROM orders)""")
def x26(spark, folder):
    rows = derived.table(spark, folder, "orders").selectExpr("o_orderkey", "o_orderdate", f"{checks.cents_to_swift_amount('cast(round(o_totalprice * 100) as bigint)')} as amount")
    return rows.selectExpr("o_orderkey", "amount", f"{checks.swift_amount_to_cents('amount')} as cents", "concat(date_format(o_orderdate, 'yyMMdd'), 'USD', amount) as tag_32a")


@query("x27_iso_text", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM orders""")
def x27(spark, folder):
    return files.iso_text(derived.table(spark, folder, "orders").selectExpr("o_orderkey", "o_orderdate", "to_date(o_orderdate) as day", "o_totalprice"))


def supplier_rows(spark, folder):
    return derived.table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "s_name as MERCHANT_NAME", "if(s_suppkey % 4 = 0, '', 'SPRINGFIELD') as merchant_city",
        "lpad(cast(cast(round(s_acctbal * 100) as bigint) as string), 12, '0') as TRANSACTION_AMOUNT")


J7_CELLS = {**o_tcr0(), "merchant_name": f"coalesce(s_name, {o_tcr0()['merchant_name']})",
            "merchant_city": f"CASE WHEN s_suppkey % 4 <> 0 THEN 'SPRINGFIELD' ELSE {o_tcr0()['merchant_city']} END",
            "transaction_amount": f"coalesce(lpad(cast(cast(round(s_acctbal * 100) AS bigint) AS varchar), 12, '0'), {o_tcr0()['transaction_amount']})"}
J7_FROM = " FROM customer LEFT JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) ON c_custkey + 1 = i"


def source_driven(spark, folder):
    generated = generate.rows(customers(spark, folder), TCR0, "TCR0", SEED, K, AS_OF, keep=("c_custkey",)).withColumn("i", F.col("c_custkey") + 1).drop("c_custkey")
    return generate.from_table(generated, "i", supplier_rows(spark, folder), ["s_suppkey"], TCR0, "TCR0")


@query("j7_positional_source_join", "SELECT c_custkey + 1 AS i, " + ", ".join(f"{v} AS {n}" for n, v in J7_CELLS.items()) + J7_FROM)
def j7(spark, folder):
    return source_driven(spark, folder)


@query("g15_render_from_table", "SELECT c_custkey + 1 AS i, rpad(" + " || ".join(f"rpad({J7_CELLS[f.name]}, {f.length}, ' ')" for f in TCR0.fields) + ", 145, ' ') AS line" + J7_FROM)
def g15(spark, folder):
    return generate.lines(source_driven(spark, folder), TCR0, "TCR0", keep=("i",))


@query("s15_mock_rows", f"""SELECT c_custkey AS row_id, 'JOHN SMITH ' || cast(c_custkey + 1 AS varchar) AS individual_name, cast({o_between(K, 'dfi', 100000000, 999999999)} AS varchar) AS dfi_account_number,
  {o_amount(K, 'amount', 10, 1000, 9999900)} AS amount, '02100002' AS rdfi_routing_transit, '1' AS check_digit, {o_pick(K, 'code', ('22', '27'))} AS transaction_code, {o_alnum(K, 'id', 10)} AS individual_identification_number FROM customer""")
def s15(spark, folder):
    return customers(spark, folder).selectExpr(
        "c_custkey as row_id", "concat('JOHN SMITH ', cast(c_custkey + 1 as string)) as individual_name",
        f"cast({seeded.between(SEED, K, 'dfi', 100000000, 999999999)} as string) as dfi_account_number",
        f"{generate.amount(SEED, K, 'amount', 10, 1000, 9999900)} as amount", "'02100002' as rdfi_routing_transit",
        f"cast({checks.aba_check_digit("'02100002'")} as string) as check_digit", f"{seeded.pick(SEED, K, 'code', ('22', '27'))} as transaction_code",
        f"{seeded.alnum(SEED, K, 'id', 10)} as individual_identification_number")


# ------------------------------------------------------------------------------------------------------- MT103
def messages(spark, folder):
    return generate.mt103(derived.table(spark, folder, "orders"), SEED, "o_orderkey", AS_OF, "cast(round(o_totalprice * 100) as bigint)", keep=("o_orderkey",))


O = "o_orderkey"
_BIC = f"[{', '.join(_lit(b) for b in generate.BICS)}]"
_RECV = f"({_BIC})[({u(O, 'sender')} % 10 + 1 + {u(O, 'receiver')} % 9) % 10 + 1]"
MT_SQL = f"""SELECT o_orderkey, 'TXN' || lpad(cast(o_orderkey AS varchar), 12, '0') AS tag_20_sender_reference, 'CRED' AS tag_23b_bank_operation_code,
  '/' || {o_digits(O, 'payer', 16)} || chr(10) || {o_person(O, 'payer_name')} || chr(10) || {o_pick(O, 'payer_city', generate.CITIES)} AS tag_50_ordering_customer_account,
  {_RECV} AS tag_57a_account_with_institution,
  '/' || {o_digits(O, 'payee', 16)} || chr(10) || {o_other(O, 'payee_name.first', 'payer_name.first', generate.FIRST_NAMES)} || ' ' || {o_pick(O, 'payee_name.last', generate.LAST_NAMES)} || chr(10) || {o_pick(O, 'payee_city', generate.CITIES)} AS tag_59_beneficiary_customer,
  '/INV/' || cast(o_orderkey AS varchar) || chr(10) || 'GOODS DELIVERED AS AGREED' AS tag_70_remittance_information,
  {o_pick(O, 'charge', generate.CHARGES)} AS tag_71a_details_of_charges, '' AS tag_72_sender_to_receiver_info,
  strftime({o_near(O, 'day', 1)}, '%y%m%d') AS tag_32a_value_date, {o_pick(O, 'ccy', generate.MT_CURRENCIES)} AS tag_32a_currency,
  cast(c // 100 AS varchar) || ',' || lpad(cast(c % 100 AS varchar), 2, '0') AS tag_32a_amount FROM (SELECT *, cast(round(o_totalprice * 100) AS bigint) AS c FROM orders)"""


@query("s7_message_tags", MT_SQL)
def s7(spark, folder):
    return generate.parse_mt103(messages(spark, folder), "o_orderkey")


@query("g14_messages", f"""SELECT o_orderkey, concat_ws(chr(10), '{{1:F01' || ({_BIC})[{u(O, 'sender')} % 10 + 1] || '0000000000}}', '{{2:I103' || {_RECV} || 'N}}', '{{3:{{108:REF' || {o_digits(O, 'ref', 4)} || '}}}}', '{{4:',
  ':20:' || tag_20_sender_reference, ':23B:' || tag_23b_bank_operation_code, ':32A:' || upper(tag_32a_value_date) || tag_32a_currency || tag_32a_amount, ':50K:' || tag_50_ordering_customer_account, ':57A:' || tag_57a_account_with_institution,
  ':59:' || tag_59_beneficiary_customer, ':70:' || tag_70_remittance_information, ':71A:' || tag_71a_details_of_charges, '-}}', '{{5:{{CHK:' || {o_alnum(O, 'chk', 12)} || '}}}}') AS message FROM ({MT_SQL})""")
def g14(spark, folder):
    return messages(spark, folder)


# --------------------------------------------------------------------------------------------- sources and sinks
def round_trip(spark, label, write):
    path = scratch_path(spark, label)
    write(path)
    return path


@query("k1_s1_ordered_lines", f"WITH {LINES} SELECT file_id, line_no, line FROM lines")
def s1(spark, folder):
    """Lines written as ordered text files and read back with their numbers."""
    path = round_trip(spark, "lines", lambda p: sinks.write_lines(shared.raw(spark, folder), p))
    return files.read_lines(spark, path, files.partition_file_id())


@query("k2_s2_delimited", """SELECT cast(c_custkey AS varchar) AS c_custkey, 'say "' || c_name || '", ok' AS c_name, c_mktsegment FROM customer""")
def s2(spark, folder):
    rows = customers(spark, folder).selectExpr("c_custkey", "concat('say \"', c_name, '\", ok') as c_name", "c_mktsegment")
    path = round_trip(spark, "delimited", lambda p: sinks.write_delimited(rows, p, ","))
    return files.read_delimited(spark, path, ",")


@query("s2_detected_header", """SELECT kind, cast(c_custkey AS varchar) AS custkey, c_name AS name FROM customer CROSS JOIN (VALUES ('named'), ('bare')) k(kind)""")
def s2b(spark, folder):
    """The same rows with and without a row of names; the reader finds out."""
    rows, out = customers(spark, folder).select("c_custkey", "c_name"), []
    for kind, header in (("named", True), ("bare", False)):
        path = round_trip(spark, f"delimited-{kind}", lambda p, h=header: sinks.write_delimited(rows, p, ";", header=h))
        out.append(files.read_delimited(spark, path, ";", header=None).toDF("custkey", "name").withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


@query("s3_plain_split", f"""WITH {shared.GL_LINES} SELECT file_id, line_no, coalesce(string_split(line, '|')[1], '') AS status, coalesce(string_split(line, '|')[9], '') AS entered_dr,
  coalesce(string_split(line, '|')[17], '') AS reference2, coalesce(string_split(line, '|')[40], '') AS beyond FROM gl_lines""")
def s3(spark, folder):
    return shared.gl_lines(spark, folder).selectExpr("file_id", "line_no", *[f"{fixed.split_field('line', '|', i)} as {n}" for n, i in
                                                                            (("status", 1), ("entered_dr", 9), ("reference2", 17), ("beyond", 40))])


@query("k3_s4_json_rows", """SELECT event_id, event_type, cast(json_extract(props, '$.k') AS bigint) AS k FROM events""")
def s4(spark, folder):
    rows = derived.table(spark, folder, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("p")).select("event_id", "event_type", "p.k")
    path = round_trip(spark, "json", lambda p: sinks.write_json(rows, p))
    return files.read_json_rows(spark, path, "event_id bigint, event_type string, k bigint", multiline=False)


SPEC_DOC = """to_json(named_struct('spec_name', concat('spec-', p_partkey), 'records', array(named_struct('record_type_id', p_type, 'ordering', p_size, 'fields', array(
    named_struct('name', 'Record ID', 'type', 'CONSTANT', 'length', 3, 'default_value', 'TXN', 'required', true),
    named_struct('name', p_name, 'type', if(p_size % 2 = 0, 'amount', 'string'), 'length', p_size, 'default_value', cast(null as string), 'required', p_size > 5)))))) as doc"""


@query("s5_spec_documents", """SELECT 'spec-' || p_partkey AS spec_name, p_type AS record_type, 'Record 0' AS record_name, 'unknown' AS category, p_size AS ordering, unnest([1, 2]) AS pos,
  unnest(['record_id', regexp_replace(lower(trim(p_name)), '[\\s\\-/]+', '_', 'g')]) AS field, unnest(['constant', CASE WHEN p_size % 2 = 0 THEN 'amount' ELSE 'string' END]) AS field_type,
  unnest([3, p_size]) AS max_len, unnest([true, p_size > 5]) AS required, 'left' AS justify, unnest(['TXN', NULL]) AS default_value FROM part""")
def s5(spark, folder):
    docs = derived.table(spark, folder, "part").selectExpr(SPEC_DOC)
    path = round_trip(spark, "specs", lambda p: docs.write.text(p))
    parsed = spark.read.schema(files.SPEC_JSON).json(path)
    return files.spec_fields(parsed).select("spec_name", "record_type", "record_name", "category", "ordering", "pos", "field", "field_type", "max_len", "required", "justify", "default_value")


TAGGED_S = "concat('RECORD_TYPE=', if(l_returnflag = 'A', '05', '06'), '|PAN=', cast(l_partkey as string), '|AMOUNT=', cast(cast(round(l_extendedprice * 100) as bigint) as string), if(l_tax > 0.05D, concat('|TAX_CODE=T', cast(l_linenumber as string)), ''))"
TAGGED_D = "'RECORD_TYPE=' || CASE WHEN l_returnflag = 'A' THEN '05' ELSE '06' END || '|PAN=' || l_partkey || '|AMOUNT=' || cast(round(l_extendedprice * 100) AS bigint) || CASE WHEN l_tax > 0.05::double THEN '|TAX_CODE=T' || l_linenumber ELSE '' END"


def tagged(spark, folder):
    return files.tagged_pairs(derived.table(spark, folder, "lineitem").selectExpr("l_orderkey", f"{TAGGED_S} as line"), "l_orderkey")


@query("s8_tagged_pairs", f"""SELECT l_orderkey, split_part(p, '=', 1) AS tag, split_part(p, '=', 2) AS value, cast(count(*) AS bigint) AS n FROM (
  SELECT l_orderkey, unnest(string_split({TAGGED_D}, '|')) AS p FROM lineitem) GROUP BY 1, 2, 3""")
def s8(spark, folder):
    return tagged(spark, folder).groupBy("l_orderkey", "tag", "value").agg(F.count(F.lit(1)).alias("n"))


@query("u3_unknown_tags", """SELECT unnest(['AMOUNT', 'PAN', 'RECORD_TYPE', 'TAX_CODE']) AS tag EXCEPT SELECT field FROM (VALUES ('AMOUNT'), ('PAN')) t(field)""")
def u3(spark, folder):
    known = spark.createDataFrame([("AMOUNT",), ("PAN",)], "field string")
    return files.unknown_tags(tagged(spark, folder), known)


@query("u8_extended_layout", f"""WITH b(record_type, field, field_type) AS (VALUES {", ".join(f"({_lit(f.record_type)}, {_lit(f.name)}, {_lit(f.data_type)})" for f in CARD.fields)})
  SELECT * FROM b UNION ALL SELECT 'DETAIL', t, 'string' FROM (SELECT DISTINCT lower(split_part(p, '=', 1)) AS t FROM (SELECT unnest(string_split({TAGGED_D}, '|')) AS p FROM lineitem))
  WHERE t NOT IN (SELECT field FROM b WHERE record_type = 'DETAIL')""")
def u8(spark, folder):
    base = layouts.spec_table(spark, CARD).select("record_type", "field", "field_type")
    return files.append_tags(base, tagged(spark, folder).select("tag").distinct())


@query("s9_text_files", """SELECT page_id, cast(length(html) AS int) AS chars, md5(html) AS digest FROM pages""")
def s9(spark, folder):
    """Each page written as its own text file, read back whole with the file as document boundary."""
    path = round_trip(spark, "texts", lambda p: sinks.write_texts(derived.table(spark, folder, "pages"), "page_id", "html", p))
    docs = files.read_texts(spark, path)
    body = F.expr("substring(text, 1, length(text) - 1)")
    return docs.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("bigint").alias("page_id"), F.length(body).alias("chars"), F.md5(body).alias("digest"))


@query("t9_file_heads", """SELECT page_id, cast(strlen(html) + 1 AS bigint) AS length, md5((encode(html || chr(10)))[1:500]) AS digest FROM pages""")
def t9_heads(spark, folder):
    """Each page as a file of its own, of which detection reads the first 500 bytes."""
    path = round_trip(spark, "texts", lambda p: sinks.write_texts(derived.table(spark, folder, "pages"), "page_id", "html", p))
    heads = files.read_heads(spark, path, 500).filter(F.col("path").like("%.txt"))
    return heads.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("bigint").alias("page_id"), "length", F.md5("head").alias("digest"))


@query("k6_report_json", None)
def k6(spark, folder):
    result = validate.checked(shared.raw(spark, folder), layouts.ACH)
    return sinks.report_json(validate.report(result), validate.capped_report(validate.errors(result)))


@query("s14_built_in_layouts", f"""WITH s(record_type, n, width) AS (VALUES {", ".join(f"({_lit(sp.name + '/' + r.record_type)}, {len(sp.of(r.record_type))}::bigint, {sum(f.length for f in sp.of(r.record_type))}::bigint)" for sp in layouts.BUILT_IN.values() for r in sp.records)}),
  {LINES.strip()}, u AS (SELECT 'ACH/' || substr(line, 1, 1) AS record_type, count(*) AS c FROM lines GROUP BY 1)
  SELECT s.record_type, n AS fields, width, cast(coalesce(c, 0) AS bigint) AS lines FROM s LEFT JOIN u USING (record_type)""")
def s14(spark, folder):
    spec = layouts.spec_table(spark).groupBy(F.concat_ws("/", "spec_name", "record_type").alias("record_type")).agg(
        F.count(F.lit(1)).alias("fields"), F.sum(F.col("length").cast("bigint")).alias("width"))
    used = shared.raw(spark, folder).groupBy(F.concat(F.lit("ACH/"), F.substring("line", 1, 1)).alias("record_type")).agg(F.count(F.lit(1)).alias("lines"))
    return spec.join(used, "record_type", "left").fillna({"lines": 0})


@query("f13_conditional_requirement", """SELECT 'gl-' || cast(year(l_shipdate) AS varchar) AS file_id, l_orderkey, 'segment1' AS field FROM lineitem WHERE l_orderkey % 103 = 0 AND l_returnflag = 'A'""")
def f13(spark, folder):
    wide = validate.wide_records(shared.gl_lines(spark, folder), GL, "LINE")
    found = validate.conditional_requirements(wide, {"segment1": "segment2 = 'A'"})
    keys = wide.select("file_id", "line_no", F.expr("cast(substring(description, 15) as bigint) as l_orderkey"))
    return found.join(keys, ["file_id", "line_no"]).select("file_id", "l_orderkey", "field")


@query("f6_message_patterns", None)
def f6m(spark, folder):
    """MT103 messages through the field checks: patterns, allowed values, amount notation, slashes."""
    parsed = generate.parse_mt103(messages(spark, folder), "o_orderkey").withColumns({
        "tag_20_sender_reference": F.expr("if(o_orderkey % 97 = 0, concat('/', tag_20_sender_reference), tag_20_sender_reference)"),
        "tag_57a_account_with_institution": F.expr("if(o_orderkey % 89 = 0, 'bad', tag_57a_account_with_institution)")})
    from dataclasses import replace
    spec = replace(layouts.MT103, delimiter="\x1f")
    return validate.error_counts(validate.errors(validate.checked(generate.mt103_lines(parsed, "o_orderkey", spec), spec)))
