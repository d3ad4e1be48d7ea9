"""Synthetic and table-driven flat files. All values are pure functions of (seed, row id, field)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions import checks, fixed, seeded
from tallyframe.functions.sqltext import in_list, q
from tallyframe.operators import ordered
from tallyframe.sources.layouts import ACH, CARD, GL, Field, Spec

# Transaction codes that credit the receiver.
CREDIT_CODES = ("22", "32", "23", "33", "24", "34")
HASH_MODULUS = 10 ** 10


def render_record(spec: Spec, record_type: str, values: Mapping[str, str]) -> str:
    """One fixed-width line; a field takes the given value, else its fixed or default value, else blanks."""
    parts = []
    for f in spec.of(record_type):
        if f.name in values:
            value = fixed.fit(values[f.name], f.length, f.justify, f.pad)
        else:
            value = q((f.fixed or f.default or "").ljust(f.length)[:f.length])
        parts.append((f.start, f.end, value))
    return fixed.render_fixed(parts, spec.record(record_type).length)


def render_row(spec: Spec, record_type: str, values: Mapping[str, str]) -> str:
    """One delimited line in field order."""
    return fixed.render_delimited([values.get(f.name, q(f.fixed or f.default or "")) for f in spec.of(record_type)],
                                  spec.delimiter or "|")


# ------------------------------------------------------------------------------------------------ ACH files
def is_credit(code: str = "transaction_code") -> str:
    return f"{code} in {in_list(CREDIT_CODES)}"


def ach_batch_totals(entries: DataFrame, *keys: str) -> DataFrame:
    """Entry and addenda counts, entry hash, debit and credit sums per batch."""
    return entries.groupBy(*keys).agg(
        F.expr("count(1) as entries"),
        F.expr("sum(cast(has_addenda as bigint)) as addenda"),
        F.expr(f"coalesce(sum(try_cast(rdfi8 as bigint)), 0) % {HASH_MODULUS} as entry_hash"),
        F.expr(f"sum(if({is_credit()}, 0, coalesce(amount_cents, 0))) as debit_cents"),
        F.expr(f"sum(if({is_credit()}, coalesce(amount_cents, 0), 0)) as credit_cents"),
    )


def ach_file_totals(batches: DataFrame, *keys: str) -> DataFrame:
    """File totals from batch totals; blocks of ten lines, rounded up."""
    return batches.groupBy(*keys).agg(
        F.expr("count(1) as batches"),
        F.expr("sum(entries + addenda) as entry_addenda"),
        F.expr(f"sum(entry_hash) % {HASH_MODULUS} as entry_hash"),
        F.expr("sum(debit_cents) as debit_cents"),
        F.expr("sum(credit_cents) as credit_cents"),
        F.expr("sum(entries + addenda + 2) + 2 as lines"),
        F.expr("cast(ceil((sum(entries + addenda + 2) + 2) / 10) as bigint) as blocks"),
    )


def ach_files(entries: DataFrame, odfi8: str = "02100002", company_id: str = "1234567890",
              company: str = "ACME CORP", destination: str = " 021000021",
              destination_name: str = "FEDERAL RESERVE BK") -> DataFrame:
    """Balanced ACH files from entries (file_id, file_no, batch_no, src_key, ...): header, batches with entries and
    addenda, batch control, file control, padding to a multiple of ten.

    Line numbers are arithmetic on batch totals plus a chunked running sum inside the batch; no file is ever sorted
    in one task. Entries cross the network once."""
    batches = ach_batch_totals(entries, "file_id", "file_no", "batch_no")
    earlier = Window.partitionBy("file_id").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = batches.withColumns({  # batch numbers have seven digits, which bounds the batches of one file
        "start": 1 + F.coalesce(F.sum(F.expr("entries + addenda + 2")).over(earlier), F.lit(0)),
        "entries_before": F.coalesce(F.sum("entries").over(earlier), F.lit(0))})
    numbered = ordered.running_sums(
        entries, ["file_id", "batch_no"], ["src_key"], {"used_to": F.expr("1 + has_addenda"), "seq": F.lit(1)},
        per_group=placed.select("file_id", "batch_no", "start", "entries_before"), sparse=True)
    seq7 = "lpad(cast((entries_before + seq) % 10000000 as string), 7, '0')"
    entry = render_record(ACH, "6", {
        "transaction_code": "transaction_code", "rdfi_routing_transit": "rdfi8", "check_digit": "check_digit",
        "dfi_account_number": "account", "amount": "amount_cents",
        "individual_identification_number": "individual_id", "individual_name": "name",
        "addenda_record_indicator": "has_addenda", "trace_number": f"concat({q(odfi8)}, {seq7})"})
    addenda = render_record(ACH, "7", {
        "addenda_type_code": "'05'", "payment_related_information": "concat('ORDER ', account)",
        "sequence_number": "'0001'", "entry_detail_sequence_number": seq7})
    keep = ["file_id", "file_no", "batch_no", "src_key"]
    detail = numbered.select(*keep, F.expr(f"""inline(array_compact(array(
        struct(start + 1 + used_to - has_addenda as line_no, '6' as record_type, {entry} as line),
        if(has_addenda = 1, struct(start + 1 + used_to as line_no, '7' as record_type, {addenda} as line), null))))"""))

    batch_no7 = "lpad(cast(batch_no as string), 7, '0')"
    day = "concat(substring(cast(file_no as string), 3, 2), lpad(cast(batch_no as string), 2, '0'), '15')"
    header = render_record(ACH, "5", {
        "service_class_code": "'200'", "company_name": q(company), "company_identification": q(company_id),
        "standard_entry_class_code": "'PPD'", "company_entry_description": "'PAYROLL'",
        "effective_entry_date": day, "originator_status_code": "'1'", "odfi_identification": q(odfi8),
        "batch_number": batch_no7})
    control = render_record(ACH, "8", {
        "service_class_code": "'200'", "entry_addenda_count": "entries + addenda", "entry_hash": "entry_hash",
        "total_debit_amount": "debit_cents", "total_credit_amount": "credit_cents",
        "company_identification": q(company_id), "odfi_identification": q(odfi8), "batch_number": batch_no7})
    frame = placed.select("file_id", "file_no", "batch_no", F.expr("cast(null as bigint) as src_key"), F.expr(
        f"""inline(array(struct(start + 1 as line_no, '5' as record_type, {header} as line),
            struct(start + 2 + entries + addenda as line_no, '8' as record_type, {control} as line)))"""))

    files = ach_file_totals(batches, "file_id", "file_no")
    first = render_record(ACH, "1", {
        "immediate_destination": q(destination), "immediate_origin": q(company_id),
        "file_creation_date": "concat(substring(cast(file_no as string), 3, 2), '1231')",
        "file_creation_time": "'1200'", "file_id_modifier": "'A'",
        "immediate_destination_name": q(destination_name), "immediate_origin_name": q(company)})
    last = render_record(ACH, "9", {
        "batch_count": "batches", "block_count": "blocks", "entry_addenda_count": "entry_addenda",
        "entry_hash": "entry_hash", "total_debit_amount": "debit_cents", "total_credit_amount": "credit_cents"})
    outer = files.select("file_id", "file_no", F.expr("cast(null as int) as batch_no"),
                         F.expr("cast(null as bigint) as src_key"), F.expr(f"""inline(concat(
        array(struct(1L as line_no, '1' as record_type, {first} as line),
              struct(lines as line_no, '9' as record_type, {last} as line)),
        transform(if(blocks * 10 > lines, sequence(lines + 1, blocks * 10), array()),
                  n -> struct(n as line_no, 'padding' as record_type, repeat('9', 94) as line))))"""))
    return detail.unionByName(frame).unionByName(outer)


# ----------------------------------------------------------------------------------------------- card files
def card_totals(details: DataFrame, *keys: str) -> DataFrame:
    """Trailer totals: detail count and amount."""
    return details.groupBy(*keys).agg(F.expr("count(1) as total_records"),
                                      F.expr("sum(coalesce(amount_cents, 0)) as total_amount"))


def card_files(details: DataFrame, order: list[str], values: Mapping[str, str], file_date: str = "'260101'",
               institution: str = "'00000000001'") -> DataFrame:
    """Header, numbered details and a trailer with computed totals. ``values`` maps detail fields to SQL text;
    ``order[0]`` is an integer column."""
    totals = card_totals(details, "file_id")
    numbered = ordered.numbered(details, ["file_id"], order, "seq", sparse=True)
    body = numbered.select("file_id", F.col(order[0]).cast("bigint").alias("src_key"), F.expr("seq + 1 as line_no"),
                           F.lit("DETAIL").alias("record_type"),
                           F.expr(render_record(CARD, "DETAIL", values)).alias("line"))
    first = render_record(CARD, "HEADER", {"file_creation_date": file_date, "institution_id": institution,
                                           "file_sequence": "'0001'"})
    last = render_record(CARD, "TRAILER", {"total_records": "total_records", "total_amount": "total_amount"})
    frame = totals.select("file_id", F.expr("cast(null as bigint) as src_key"), F.expr(
        f"inline(array(struct(1L as line_no, 'HEADER' as record_type, {first} as line), "
        f"struct(total_records + 2 as line_no, 'TRAILER' as record_type, {last} as line)))"))
    return body.unionByName(frame)


def gl_files(rows: DataFrame, order: list[str], values: Mapping[str, str], header: Mapping[str, str]) -> DataFrame:
    """Journal files: a row of column names, one journal header, numbered journal lines."""
    spec = GL
    numbered = ordered.numbered(rows, ["file_id"], order, "seq", sparse=True)
    body = numbered.select("file_id", F.expr("seq + 2 as line_no"), F.expr(render_row(spec, "LINE", values)).alias("line"))
    names = q(spec.delimiter.join(f.name.upper() for f in spec.of("HEADER")))
    top = rows.select("file_id").distinct().select("file_id", F.expr(
        f"inline(array(struct(1L as line_no, {names} as line), "
        f"struct(2L as line_no, {render_row(spec, 'HEADER', header)} as line)))"))
    return body.unionByName(top)
