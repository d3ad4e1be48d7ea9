"""Flat-file inputs derived from warehouse tables: payment entries, card details, journal lines, raw text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.functions import checks


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def ach_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One payment entry per order: file = order year, batch = order month."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customer.select("c_custkey", "c_name"), orders.o_custkey == customer.c_custkey, "left")
    rdfi = "lpad(cast(o_custkey as string), 8, '0')"
    return joined.selectExpr(
        "concat('ach-', cast(year(o_orderdate) as string)) as file_id",
        "year(o_orderdate) as file_no",
        "month(o_orderdate) as batch_no",
        "o_orderkey as src_key",
        "case o_orderstatus when 'F' then '22' when 'O' then '27' else '32' end as transaction_code",
        f"{rdfi} as rdfi8",
        f"cast({checks.aba_check_digit(rdfi)} as string) as check_digit",
        "lpad(cast(o_orderkey as string), 12, '0') as account",
        "cast(round(o_totalprice * 100) as bigint) as amount_cents",
        "o_orderpriority as individual_id",
        "coalesce(c_name, 'UNKNOWN') as name",
        "if(o_orderpriority = '1-URGENT', 1, 0) as has_addenda",
    )


def damage_ach(lines: DataFrame) -> DataFrame:
    """Inject a fixed set of defects so that every check has something to find: wrong check digits, letters in
    amounts, short lines, unknown record types, wrong control counts, header/control mismatches, orphan addenda."""
    def bumped(at: int, width: int) -> str:
        return f"lpad(cast(try_cast(substring(line, {at}, {width}) as int) + 1 as string), {width}, '0')"

    def swap(value: str, at: int, width: int) -> str:
        return f"concat(substring(line, 1, {at - 1}), {value}, substring(line, {at + width}, 94))"

    entry = """concat(
        if(src_key % 509 = 0, 'X', substring(line, 1, 1)), substring(line, 2, 10),
        if(src_key % 97 = 0, cast((try_cast(substring(line, 12, 1) as int) + 1) % 10 as string), substring(line, 12, 1)),
        substring(line, 13, 17), if(src_key % 89 = 0, 'X', substring(line, 30, 1)), substring(line, 31, 63),
        if(src_key % 101 = 0, '', substring(line, 94, 1)))"""
    return lines.withColumn("line", F.expr(f"""case
        when record_type = '6' then {entry}
        when record_type = '7' and src_key % 83 = 0 then {swap("'9999999'", 88, 7)}
        when record_type = '8' and (file_no * 12 + batch_no) % 13 = 0 then {swap(bumped(5, 6), 5, 6)}
        when record_type = '5' and (file_no * 12 + batch_no) % 17 = 0 then {swap("'02100009'", 80, 8)}
        when record_type = '9' and file_no % 5 = 0 then {swap(bumped(2, 6), 2, 6)}
        else line end"""))


CARD_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
              "l_shipdate", "l_returnflag", "l_linestatus"]


def card_details(spark: SparkSession, folder: str) -> DataFrame:
    """One card transaction per order line: file = supplier."""
    pan15 = "concat('4', lpad(cast(l_orderkey as string), 8, '0'), lpad(cast(l_partkey as string), 6, '0'))"
    day = "date_format(l_shipdate, 'yyMMdd')"
    return table(spark, folder, "lineitem").selectExpr(
        "*", "concat('card-', cast(l_suppkey as string)) as file_id",
        f"concat({pan15}, cast({checks.luhn_check_digit(pan15)} as string)) as pan",
        "cast(round(l_extendedprice * 100) as bigint) as amount_cents", f"{day} as day")


def damage_card(lines: DataFrame) -> DataFrame:
    """Fixed defects in card details and trailers: check digit, letter in amount, response code, expiry, total."""
    detail = """concat(substring(line, 1, 19),
        if(src_key % 97 = 0, cast((cast(substring(line, 20, 1) as int) + 1) % 10 as string), substring(line, 20, 1)),
        substring(line, 21, 6), if(src_key % 89 = 0, 'X', substring(line, 27, 1)), substring(line, 28, 24),
        if(src_key % 103 = 0, 'ABCD', substring(line, 52, 4)), substring(line, 56, 34),
        if(src_key % 101 = 0, '99', substring(line, 90, 2)), substring(line, 92, 129))"""
    trailer = "concat(substring(line, 1, 1), lpad(cast(cast(substring(line, 2, 10) as bigint) + 1 as string), 10, '0'), substring(line, 12, 209))"
    return lines.withColumn("line", F.expr(
        f"case when record_type = 'DETAIL' then {detail} when record_type = 'TRAILER' and length(file_id) = 6 "
        f"then {trailer} else line end"))


def gl_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One journal line per order line: file = ship year; a few fixed defects."""
    day = "upper(date_format(l_shipdate, 'dd-MMM-yyyy'))"
    return table(spark, folder, "lineitem").selectExpr(
        "*", "concat('gl-', cast(year(l_shipdate) as string)) as file_id",
        "if(l_orderkey % 97 = 0, 'N1', 'N') as status",
        f"if(l_orderkey % 101 = 0, concat('31-FEB', substring({day}, 7, 5)), {day}) as effective_date",
        "cast(l_partkey as string) as code_combination_id",
        "if(l_orderkey % 103 = 0, '', cast(1000 + l_suppkey as string)) as segment1",
        "l_returnflag as segment2", "cast(l_linenumber as string) as segment3", "l_linestatus as segment4",
        "'' as segment5",
        "concat(cast(cast(round(l_extendedprice * 100) as bigint) div 100 as string), '.', "
        "lpad(cast(cast(round(l_extendedprice * 100) as bigint) % 100 as string), 2, '0'), "
        "if(l_orderkey % 89 = 0, 'X', '')) as entered_dr",
        "'0' as entered_cr", "concat('JOURNAL ENTRY ', cast(l_orderkey as string)) as description")
