"""Cross-record reconciliation of ACH and card files: control records against computed totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions import fixed
from tallyframe.operators import ordered, synth
from tallyframe.session import written
from tallyframe.sources.layouts import ACH, CARD

HASH = synth.HASH_MODULUS
WIDTH = 94


def with_batch(lines: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Record type and enclosing batch of each line: the last type-5 header at or above it. ``batch_id`` counts the
    headers of the file; lines before the first header or after a control belong to none (null). ``before`` (file_id, opened,
    closed) has the headers and controls of lines that came earlier, for files that arrive in parts."""
    kinds = lines.withColumn("record_type", fixed.classify(F.col("line"), ACH.record_types, "9" * 94))
    counted = ordered.running_sums(kinds, ["file_id"], ["line_no"], {
        "_opened": (F.coalesce(F.col("record_type"), F.lit("")) == "5").cast("int"),
        "_closed": (F.coalesce(F.col("record_type"), F.lit("")) == "8").cast("int")}, per_group=before)
    if before is not None:
        counted = counted.withColumns({f"_{n}": F.col(f"_{n}") + F.coalesce(F.col(n), F.lit(0)) for n in ("opened", "closed")}).drop("opened", "closed")
    inside = (F.col("_opened") > F.col("_closed")) | (F.col("record_type") == "8")
    return counted.withColumn("batch_id", F.when(inside & (F.col("_opened") > 0), F.col("_opened"))) \
        .drop("_opened", "_closed")


def _cut(name: str, record_type: str) -> str:
    f = next(x for x in ACH.of(record_type) if x.name == name)
    return f"substring(line, {f.start}, {f.length})"


def computed_batches(records: DataFrame) -> DataFrame:
    """Totals per (file, batch) from the detail lines; an unreadable amount or routing number counts as zero."""
    code, amount = _cut("transaction_code", "6"), f"coalesce(try_cast({_cut('amount', '6')} as bigint), 0)"
    credit = synth.is_credit(code)
    return records.filter(F.col("batch_id").isNotNull() & F.col("record_type").isin("6", "7")) \
        .groupBy("file_id", "batch_id").agg(
        F.expr("count_if(record_type = '6') as entries"),
        F.expr("count(1) as entry_addenda_count"),
        F.expr(f"sum(if(record_type = '6', coalesce(try_cast({_cut('rdfi_routing_transit', '6')} as bigint), 0), 0))"
               f" % {HASH} as entry_hash"),
        F.expr(f"sum(if(record_type = '6' and not {credit}, {amount}, 0)) as total_debit_amount"),
        F.expr(f"sum(if(record_type = '6' and {credit}, {amount}, 0)) as total_credit_amount"))


TOTALS = ("entry_addenda_count", "entry_hash", "total_debit_amount", "total_credit_amount")


def _mismatches(joined: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    """One row per differing column; a missing side counts as a difference."""
    rows = [F.struct(F.lit(n).alias("field"), F.col(f"c_{n}").alias("expected"), F.col(f"r_{n}").alias("actual"))
            for n in names]
    return (joined.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*")
            .filter(~F.col("expected").eqNullSafe(F.col("actual"))))


def batch_mismatches(records: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Batch control records against computed totals. Given ``totals`` as of ``computed_batches``, headers and controls are all that
    ``records`` must have."""
    totals = computed_batches(records) if totals is None else totals
    control = records.filter((F.col("record_type") == "8") & F.col("batch_id").isNotNull()).select(
        "file_id", "batch_id", *[F.expr(f"try_cast({_cut(n, '8')} as bigint) as r_{n}") for n in TOTALS])
    headers = records.filter(F.col("record_type") == "5").select("file_id", "batch_id")
    expected = headers.join(totals, ["file_id", "batch_id"], "left").select(
        "file_id", "batch_id", *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(f"c_{n}") for n in TOTALS])
    return _mismatches(expected.join(control, ["file_id", "batch_id"], "full_outer"), ["file_id", "batch_id"], TOTALS)


def computed_files(records: DataFrame) -> DataFrame:
    """File totals in one pass over the lines, pre-aggregated before the shuffle."""
    code, amount = _cut("transaction_code", "6"), f"coalesce(try_cast({_cut('amount', '6')} as bigint), 0)"
    credit, detail = synth.is_credit(code), "record_type = '6' and batch_id is not null"
    return records.groupBy("file_id").agg(
        F.expr("count_if(record_type = '5') as batch_count"),
        F.expr("cast(ceil(count(1) / 10) as bigint) as block_count"),
        F.expr("count_if(record_type in ('6', '7') and batch_id is not null) as entry_addenda_count"),
        F.expr(f"sum(if({detail}, coalesce(try_cast({_cut('rdfi_routing_transit', '6')} as bigint), 0), 0)) % {HASH}"
               " as entry_hash"),
        F.expr(f"sum(if({detail} and not {credit}, {amount}, 0)) as total_debit_amount"),
        F.expr(f"sum(if({detail} and {credit}, {amount}, 0)) as total_credit_amount"),
        F.expr("count(1) as lines"))


FILE_TOTALS = ("batch_count", "block_count") + TOTALS


def file_mismatches(records: DataFrame, computed: DataFrame | None = None) -> DataFrame:
    """File control record against computed totals, which may be given as of ``computed_files``."""
    control = records.filter(F.col("record_type") == "9").select(
        "file_id", *[F.expr(f"try_cast({_cut(n, '9')} as bigint) as r_{n}") for n in FILE_TOTALS])
    computed = (computed_files(records) if computed is None else computed).select("file_id", *[F.col(n).alias(f"c_{n}") for n in FILE_TOTALS])
    return _mismatches(computed.join(control, "file_id", "full_outer"), ["file_id"], FILE_TOTALS)


def detail_sums(records: DataFrame) -> DataFrame:
    """Sums of detail lines per (file, batch) that may be added up over parts of a file (the hash sum is not cut yet)."""
    code, amount = _cut("transaction_code", "6"), f"coalesce(try_cast({_cut('amount', '6')} as bigint), 0)"
    credit, entry = synth.is_credit(code), "record_type = '6'"
    return records.filter(F.col("batch_id").isNotNull() & F.col("record_type").isin("6", "7")).groupBy("file_id", "batch_id").agg(
        F.expr(f"count_if({entry}) as entries"), F.expr("count(1) as entry_addenda_count"),
        F.expr(f"sum(if({entry}, coalesce(try_cast({_cut('rdfi_routing_transit', '6')} as bigint), 0), 0)) as entry_hash"),
        F.expr(f"sum(if({entry} and not {credit}, {amount}, 0)) as total_debit_amount"), F.expr(f"sum(if({entry} and {credit}, {amount}, 0)) as total_credit_amount"))


def rollup_totals(records: DataFrame) -> DataFrame:
    """Batch, file and grand totals in one pass."""
    code, amount = _cut("transaction_code", "6"), f"coalesce(try_cast({_cut('amount', '6')} as bigint), 0)"
    detail = records.filter((F.col("record_type") == "6") & F.col("batch_id").isNotNull())
    return detail.rollup("file_id", "batch_id").agg(
        F.expr("count(1) as entries"),
        F.expr(f"sum(if({synth.is_credit(code)}, 0, {amount})) as debit_cents"),
        F.expr(f"sum(if({synth.is_credit(code)}, {amount}, 0)) as credit_cents"),
        F.expr("cast(grouping_id() as int) as level"))


HEADER_CONTROL = ("service_class_code", "company_identification", "odfi_identification", "batch_number")


def header_control_mismatches(records: DataFrame) -> DataFrame:
    """Batch header and batch control must agree on class, company, originator and number."""
    sides = {}
    for kind, tag in (("5", "c"), ("8", "r")):
        sides[kind] = records.filter((F.col("record_type") == kind) & F.col("batch_id").isNotNull()).select(
            "file_id", "batch_id", *[F.expr(f"{_cut(n, kind)} as {tag}_{n}") for n in HEADER_CONTROL])
    return _mismatches(sides["5"].join(sides["8"], ["file_id", "batch_id"], "full_outer"), ["file_id", "batch_id"],
                       HEADER_CONTROL)


def orphan_addenda(records: DataFrame) -> DataFrame:
    """Addenda whose parent trace number (last seven digits) is no entry of the batch with the indicator set."""
    parents = records.filter(F.col("record_type") == "6").select(
        "file_id", "batch_id", F.expr("substring(line, 88, 7) as parent"),
        F.expr("substring(line, 79, 1) as indicator")).filter("indicator = '1'").drop("indicator").distinct()
    addenda = records.filter(F.col("record_type") == "7").select(
        "file_id", "batch_id", "line_no", F.expr("substring(line, 88, 7) as parent"))
    return addenda.join(parents, ["file_id", "batch_id", "parent"], "left_anti")


def entries_without_addenda(records: DataFrame) -> DataFrame:
    """Entries that announce an addenda record but have none."""
    announced = records.filter("record_type = '6' and substring(line, 79, 1) = '1'").select(
        "file_id", "batch_id", "line_no", F.expr("substring(line, 88, 7) as parent"))
    present = records.filter("record_type = '7'").select(
        "file_id", "batch_id", F.expr("substring(line, 88, 7) as parent")).distinct()
    return announced.join(present, ["file_id", "batch_id", "parent"], "left_anti")


def sequence_errors(records: DataFrame) -> DataFrame:
    """Batch numbers run 1, 2, 3 ...; trace numbers start with the batch's originator and ascend in the batch."""
    number = F.expr(f"try_cast({_cut('batch_number', '5')} as bigint)")
    batches = records.filter(F.col("record_type") == "5").select(
        "file_id", "line_no", F.lit("BATCH_NUMBER").alias("rule"), number.cast("string").alias("actual"),
        F.col("batch_id").cast("string").alias("expected")).filter(~F.col("actual").eqNullSafe(F.col("expected")))
    own = F.expr("case record_type when '5' then substring(line, 80, 8) end")
    seen = ordered.last_seen(records.filter("record_type in ('5', '6')"), ["file_id"], "line_no", own, "odfi")
    entries = seen.filter("record_type = '6' and batch_id is not null and length(line) = 94").withColumn(
        "trace", F.expr("substring(line, 80, 15)"))
    origin = entries.filter("substring(trace, 1, 8) <> odfi").select(
        "file_id", "line_no", F.lit("TRACE_ORIGIN").alias("rule"), F.expr("substring(trace, 1, 8) as actual"),
        F.col("odfi").alias("expected"))
    paired = ordered.neighbour(entries, ["file_id", "batch_id"], "line_no", {"trace": "previous"}, forward=False)
    order = paired.filter("previous >= trace").select(
        "file_id", "line_no", F.lit("TRACE_ORDER").alias("rule"), F.col("trace").alias("actual"),
        F.col("previous").alias("expected"))
    return batches.unionByName(origin).unionByName(order)


def findings(lines: DataFrame) -> DataFrame:
    """All cross-record findings as one table (file_id, check, field, at, expected, actual). Seven checks read the lines
    with their batch, so that table is written once."""
    rec = written(with_batch(lines), "batched-lines")
    parts = [
        batch_mismatches(rec).selectExpr("file_id", "'BATCH_TOTAL' as check", "field", "cast(batch_id as string) as at",
                                         "cast(expected as string) as expected", "cast(actual as string) as actual"),
        file_mismatches(rec).selectExpr("file_id", "'FILE_TOTAL' as check", "field", "'' as at",
                                        "cast(expected as string) as expected", "cast(actual as string) as actual"),
        header_control_mismatches(rec).selectExpr("file_id", "'HEADER_CONTROL' as check", "field",
                                                  "cast(batch_id as string) as at", "expected", "actual"),
        orphan_addenda(rec).selectExpr("file_id", "'ORPHAN_ADDENDA' as check", "'trace' as field", "cast(line_no as string) as at",
                                       "cast(null as string) as expected", "parent as actual"),
        entries_without_addenda(rec).selectExpr("file_id", "'MISSING_ADDENDA' as check", "'trace' as field", "cast(line_no as string) as at",
                                                "parent as expected", "cast(null as string) as actual"),
        rec.filter(F.length("line") != WIDTH).selectExpr("file_id", "'RECORD_LENGTH' as check", "'line' as field", "cast(line_no as string) as at",
                                                         f"'{WIDTH}' as expected", "cast(length(line) as string) as actual"),
        sequence_errors(rec).selectExpr("file_id", "'SEQUENCE' as check", "rule as field", "cast(line_no as string) as at",
                                        "expected", "actual"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def native_stats(lines: DataFrame) -> DataFrame:
    """Per file: lines, lines not 94 wide, record types found."""
    kind = F.substring("line", 1, 1)
    return lines.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(F.length("line") != 94).alias("malformed_lines"),
        F.array_join(F.sort_array(F.collect_set(F.when(kind.isin(*ACH.record_types), kind))), ",").alias("found_types"))


def card_mismatches(lines: DataFrame) -> DataFrame:
    """Card trailer against detail totals, with the amount hash modulo 10^10."""
    kind = "case substring(line, 1, 1) when 'H' then 'HEADER' when 'T' then 'TRAILER' else 'DETAIL' end"
    f = next(x for x in CARD.of("DETAIL") if x.name == "transaction_amount")
    amount = f"coalesce(try_cast(substring(line, {f.start}, {f.length}) as bigint), 0)"
    rows = lines.withColumn("record_type", F.expr(kind))
    both = rows.groupBy("file_id").agg(
        F.expr("count_if(record_type = 'DETAIL') as c_total_records"),
        F.expr(f"sum(if(record_type = 'DETAIL', {amount}, 0)) as c_total_amount"),
        F.expr("max(if(record_type = 'TRAILER', try_cast(substring(line, 2, 10) as bigint), null)) as r_total_records"),
        F.expr("max(if(record_type = 'TRAILER', try_cast(substring(line, 12, 14) as bigint), null)) as r_total_amount"))
    return _mismatches(both, ["file_id"], ("total_records", "total_amount"))
