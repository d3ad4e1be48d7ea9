"""Spec-driven generation: every field value is SQL text over (seed, row id), so rows are generated where they live.

The row id is a column of the driving table; calendar values depend on ``as_of``, never on the clock.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions import checks, fixed, seeded
from tallyframe.functions.sqltext import q
from tallyframe.operators import ordered
from tallyframe.sources.layouts import Field, Spec

# ---------------------------------------------------------------------------------------------------------------
# Invented vocabularies and codes of public registers; generated values need not match anyone else's.
# ---------------------------------------------------------------------------------------------------------------
FIRST_NAMES = ("AMARA", "BRENNAN", "CELESTE", "DORIAN", "ESTHER", "FELIX", "GRETA", "HAMISH", "INGRID", "JULIAN", "KEIKO",
               "LEANDRO", "MIRIAM", "NIKOLAI", "ODETTE", "PIOTR")
LAST_NAMES = ("ASHWORTH", "BLACKWELL", "CASTELLANO", "DRUMMOND", "EKSTROM", "FAIRBANKS", "GALLOWAY", "HOLMQVIST", "IBARRA",
              "JANKOWSKI", "KOVALENKO", "LINDGREN", "MONTROSE", "NAKAMURA", "OKONKWO", "PEMBERTON")
COMPANIES = ("ALDER MILLS", "BRIGHTWATER LTD", "COPPER QUARRY", "DUNE FREIGHT", "EASTGATE TOOLS", "FERNHILL FOODS")
MERCHANTS = ("ANCHOR BAKERY", "BLUE DOOR BOOKS", "CORNER GARAGE", "DAISY FLORIST", "ELM STREET CAFE", "FOXGLOVE PHARMACY",
             "GRANITE HARDWARE", "HARBOUR TEA ROOM")
CITIES = ("ALBANY", "BOISE", "CONCORD", "DOVER", "EUGENE", "FARGO", "GALVESTON", "HELENA", "ITHACA", "JUNEAU", "KNOXVILLE",
          "LARAMIE")
STATES = ("AK", "AL", "AR", "AZ", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "IA", "ID", "IL", "IN", "KS", "KY", "LA", "MA",
          "MD", "ME", "MI", "MN", "MO", "MS", "MT", "NC", "ND", "NE", "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "PA",
          "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY")
CURRENCIES = ("036", "124", "156", "208", "344", "348", "356", "392", "410", "484", "554", "578", "702", "710", "752", "756",
              "826", "840", "978", "985", "986")
COUNTRIES = ("036", "040", "056", "076", "124", "156", "208", "246", "250", "276", "300", "356", "372", "380", "392", "410",
             "484", "528", "554", "578", "616", "620", "702", "710", "724", "752", "756", "826", "840")
MCC_CODES = ("0742", "1711", "4121", "4814", "4900", "5045", "5251", "5462", "5541", "5691", "5814", "5942", "7230", "7523",
             "8011", "8220")
CARD_PREFIXES = tuple(str(n) for n in range(4000, 5000, 50))
ROUTING_NUMBERS = tuple(  # one for each Federal Reserve district, with its check digit
    f"{d:02}{d * 104729 % 10**6:06}{-sum(w * int(x) for w, x in zip((3, 7, 1, 3, 7, 1, 3, 7), f'{d:02}{d * 104729 % 10**6:06}')) % 10}"
    for d in range(1, 13))
GL_SOURCES = ("Billing", "Consolidation", "Inventory", "Leases", "Spreadsheet", "Treasury")
GL_CATEGORIES = ("Allocation", "Budget", "Depreciation", "Revaluation", "Tax", "Transfer")
DESCRIPTIONS = ("DEPOSIT", "DONATION", "INSTALMENT", "MEMBERSHIP", "PENSION", "PREMIUM", "REBATE", "RENT")
# The field-name rules that choose a vocabulary, first match wins.
NAME_RULES = (
    ("ROUTING|RDFI|ODFI|ABA|RTN", "routing"),
    ("ACCOUNT.*NUM|DFI_ACCOUNT", "account"),
    ("AMOUNT|AMT|DEBIT|CREDIT|DR$|CR$", "amount"),
    ("DATE", "date"),
    ("TIME$", "time"),
    ("INDIVIDUAL_NAME|CARDHOLDER|PERSON", "person"),
    ("COMPANY_NAME", "company"),
    ("MERCHANT_NAME", "merchant"),
    ("CITY", "city"),
    ("STATE", "state"),
    ("CURRENCY", "currency"),
    ("MCC|MERCHANT_CATEGORY", "mcc"),
    ("COUNTRY", "country"),
    ("AUTH.*CODE", "auth"),
    ("TRACE", "digits"),
    ("BATCH.*NUM", "digits"),
    ("COUNT", "count"),
    ("HASH", "digits"),
    ("ZIP|POSTAL", "zip"),
    ("DESC", "description"),
    (r"SEGMENT\d", "segment"),
    ("LEDGER", "segment"),
    ("SOURCE", "gl_source"),
    ("CATEGORY", "gl_category"),
    ("FILLER|RESERVED|BLANK", "blank"),
    ("FLAG|INDICATOR|STATUS", "flag"),
)
DATE_PATTERNS = {"YYMMDD": "yyMMdd", "YYYYMMDD": "yyyyMMdd", "MMDD": "MMdd", "DD-MON-YYYY": "dd-MMM-yyyy",
                 "MMDDYYYY": "MMddyyyy", "YYYY-MM-DD": "yyyy-MM-dd", "MM/DD/YYYY": "MM/dd/yyyy"}
# ---------------------------------------------------------------------------------------------------------------


def card_number(seed, row: str, field: str = "pan") -> str:
    """Prefix, eleven digits, Luhn digit."""
    partial = f"concat({seeded.pick(seed, row, field + '.bin', CARD_PREFIXES)}, {seeded.digits(seed, row, field, 11)})"
    return f"concat({partial}, cast({checks.luhn_check_digit(partial)} as string))"


def listed_routing(seed, row: str, field: str = "routing") -> str:
    return seeded.pick(seed, row, field, ROUTING_NUMBERS)


def computed_routing(seed, row: str, field: str = "routing") -> str:
    """Eight digits and their check digit."""
    first8 = seeded.digits(seed, row, field, 8)
    return f"concat({first8}, cast({checks.aba_check_digit(first8)} as string))"


def account_number(seed, row: str, field: str, length: int) -> str:
    """6 to 17 digits, first one not zero."""
    width = min(max(length, 6), 17)
    return f"concat(cast({seeded.between(seed, row, field + '.lead', 1, 9)} as string), {seeded.digits(seed, row, field, width - 1)})"


def amount(seed, row: str, field: str, width: int, low: int = 100, high: int = 999_999) -> str:
    """Whole cents in range, zero-filled."""
    high = min(high, 10 ** min(width, 17) - 1)
    return f"lpad(cast({seeded.between(seed, row, field, min(max(low, 1), high), high)} as string), {width}, '0')"


def numeric(seed, row: str, field: str, width: int, low: int = 1, high: int = 9999) -> str:
    high = min(high, 10 ** min(width, 17) - 1)
    return f"lpad(cast({seeded.between(seed, row, field, min(low, high), high)} as string), {width}, '0')"


def render_date(day: str, fmt: str | None) -> str:
    """A date expression in a spec format, upper case."""
    return f"upper(date_format({day}, {q(DATE_PATTERNS.get(fmt or 'YYMMDD', 'yyMMdd'))}))"


def recent_date(seed, row: str, field: str, as_of: str, days: int = 180) -> str:
    """A day within the last ``days`` days of ``as_of``."""
    return f"date_sub(date {q(as_of)}, cast({seeded.between(seed, row, field, 0, days)} as int))"


def near_date(seed, row: str, field: str, as_of: str, days: int = 30) -> str:
    """A day within ``days`` days around ``as_of``."""
    return f"date_add(date {q(as_of)}, cast({seeded.between(seed, row, field, 0, 2 * days)} - {days} as int))"


def expiry(seed, row: str, field: str, as_of: str, fmt: str | None = None) -> str:
    """A month 6 to 60 months ahead as YYMM or MM/YY."""
    month = f"add_months(date {q(as_of)}, cast({seeded.between(seed, row, field, 6, 60)} as int))"
    return f"date_format({month}, {q('MM/yy' if fmt and '/' in fmt else 'yyMM')})"


def clock(seed, row: str, field: str) -> str:
    """HHMM."""
    return (f"concat(lpad(cast({seeded.between(seed, row, field + '.h', 0, 23)} as string), 2, '0'), "
            f"lpad(cast({seeded.between(seed, row, field + '.m', 0, 59)} as string), 2, '0'))")


def person(seed, row: str, field: str) -> str:
    return f"concat({seeded.pick(seed, row, field + '.first', FIRST_NAMES)}, ' ', {seeded.pick(seed, row, field + '.last', LAST_NAMES)})"


def other_person(seed, row: str, field: str, other: str) -> str:
    """A person with another first name than that drawn for ``other``."""
    n = len(FIRST_NAMES)
    place = f"({seeded.u32(seed, row, other + '.first')} % {n} + 1 + {seeded.u32(seed, row, field + '.first')} % {n - 1}) % {n} + 1"
    first = f"element_at(array({', '.join(q(x) for x in FIRST_NAMES)}), cast({place} as int))"
    return f"concat({first}, ' ', {seeded.pick(seed, row, field + '.last', LAST_NAMES)})"


def _by_name(kind: str, f: Field, seed, row: str, as_of: str, width: int) -> str:
    name = f.name
    if kind == "routing":
        full = computed_routing(seed, row, name)
        return f"concat(' ', {full})" if width == 10 else f"substring({full}, 1, {width})"
    if kind == "account":
        return account_number(seed, row, name, width)
    if kind == "amount":
        return amount(seed, row, name, min(width, 12))
    if kind == "date":
        return render_date(near_date(seed, row, name, as_of), f.fmt)
    if kind == "time":
        return clock(seed, row, name)
    if kind == "person":
        return person(seed, row, name)
    if kind == "auth":
        return seeded.alnum(seed, row, name, min(width, 6))
    if kind == "digits":
        return seeded.digits(seed, row, name, width)
    if kind == "count":
        return numeric(seed, row, name, width, 1, 999)
    if kind == "zip":
        return f"cast({seeded.between(seed, row, name, 10000, 99999)} as string)"
    if kind == "segment":
        return f"cast({seeded.between(seed, row, name, 1000, 9999)} as string)"
    if kind == "description":
        return f"concat({seeded.pick(seed, row, name, DESCRIPTIONS)}, ' ', cast({seeded.between(seed, row, name + '.no', 1000, 9999)} as string))"
    if kind == "blank":
        return q(" " * width)
    if kind == "flag":
        return seeded.pick(seed, row, name, ("Y", "N"))
    lists = {"company": COMPANIES, "merchant": MERCHANTS, "city": CITIES, "state": STATES, "currency": CURRENCIES,
             "mcc": MCC_CODES, "country": COUNTRIES, "gl_source": GL_SOURCES, "gl_category": GL_CATEGORIES}
    return seeded.pick(seed, row, name, lists[kind])


def raw_value(f: Field, seed, row: str, as_of: str, sequence: str | None = None) -> str:
    """Unpadded value of a field: fixed, allowed, by strong type, by name, by weak type."""
    width = f.length or f.max_len or 10
    if f.fixed is not None:
        return q(f.fixed)
    if f.allowed:
        return seeded.pick(seed, row, f.name, f.allowed)
    kind = f.data_type
    if kind == "constant":
        return q(f.default or "")
    if kind == "sequence":
        return f"cast({sequence or row} as string)"
    if kind == "pan":
        return card_number(seed, row, f.name)
    if kind == "cvv":
        return f"cast({seeded.between(seed, row, f.name, 100, 999)} as string)"
    if kind == "expiry":
        return expiry(seed, row, f.name, as_of, f.fmt)
    if kind == "routing_number" and width == 9:
        return listed_routing(seed, row, f.name)
    if kind == "account_number":
        return account_number(seed, row, f.name, width)
    if kind == "datetime":
        return f"date_format({recent_date(seed, row, f.name, as_of)}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    if kind in ("checksum", "computed"):
        return "''"
    if kind == "boolean":
        return seeded.pick(seed, row, f.name, ("true", "false"))
    if kind == "amount" and f.max_value:
        return amount(seed, row, f.name, width, int(f.min_value or 100), int(f.max_value))
    rule = next((k for pattern, k in NAME_RULES if re.search(pattern, f.name.upper())), None)
    digits_only = kind == "numeric" and rule in ("flag", "description", "company", "merchant", "city", "state", "person",
                                                 "auth", "gl_source", "gl_category")
    if rule and not digits_only and (kind != "numeric" or width >= 4 or rule not in ("currency", "mcc", "segment", "zip")):
        return _by_name(rule, f, seed, row, as_of, width)
    if kind == "date":
        return render_date(recent_date(seed, row, f.name, as_of), f.fmt)
    if kind in ("numeric", "routing_number"):
        return seeded.digits(seed, row, f.name, width)
    if kind == "amount":
        return amount(seed, row, f.name, width)
    if kind == "alpha":
        return seeded.letters(seed, row, f.name, width)
    return seeded.alnum(seed, row, f.name, width)


def value(f: Field, seed, row: str, as_of: str, sequence: str | None = None) -> str:
    """Field value cut and justified to its width."""
    raw = raw_value(f, seed, row, as_of, sequence)
    width = f.length or f.max_len
    return fixed.fit(raw, width, f.justify, f.pad) if width else raw


def rows(drive: DataFrame, spec: Spec, record_type: str, seed, row: str, as_of: str, sequence: str | None = None,
         overrides: Mapping[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One generated record per row of ``drive``: a column per field. Overrides (SQL text) win over generated values."""
    cols = []
    for f in spec.of(record_type):
        generated = value(f, seed, row, as_of, sequence)
        if overrides and f.name in overrides:
            generated = f"coalesce({fixed.fit(overrides[f.name], f.length, f.justify, f.pad) if f.length else overrides[f.name]}, {generated})"
        cols.append(F.expr(generated).alias(f.name))
    return drive.select(*keep, *cols)


def lines(records: DataFrame, spec: Spec, record_type: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Render generated records as text lines, fixed width or delimited."""
    fields = spec.of(record_type)
    if spec.delimiter or not spec.record(record_type).length:
        text = fixed.render_delimited([f.name for f in fields], spec.delimiter or "|")
    else:
        text = fixed.render_fixed([(f.start, f.end, fixed.fit(f.name, f.length)) for f in fields], spec.record(record_type).length)
    return records.select(*keep, F.expr(text).alias("line"))


def from_table(generated: DataFrame, index: str, source: DataFrame, order: list[str], spec: Spec, record_type: str) -> DataFrame:
    """The i-th generated record takes the i-th source row: field names match exactly or in the other case; an empty
    value falls to the next candidate. Positions meet in an equi-join on the row number."""
    numbered = ordered.numbered(source, [], order, "_i", sparse=True) if order else source
    by_lower = {}
    for c in source.columns:
        by_lower.setdefault(c.lower(), []).append(c)
    fields = spec.of(record_type)
    used = sorted({c for f in fields for c in by_lower.get(f.name, [])})
    right = numbered.select(F.col("_i").alias("_row"), *[F.col(c).cast("string").alias(f"_src_{c}") for c in used])
    joined = generated.join(right, F.col(index) == F.col("_row"), "left")
    cols = []
    for f in fields:
        candidates = [f"nullif(`_src_{c}`, '')" for c in by_lower.get(f.name, [])]
        cols.append(F.expr(f"coalesce({', '.join([*candidates, f.name])})").alias(f.name))
    return joined.select(index, *cols)


def trace_number(odfi: str, sequence: str) -> str:
    """Originator's eight digits and a seven-digit running number; a number beyond 9,999,999 is an error, as trace numbers of a
    file must ascend."""
    number = f"if({sequence} > 9999999, raise_error('trace number over 9999999'), lpad(cast({sequence} as string), 7, '0'))"
    return f"concat(substring({odfi}, 1, 8), {number})"


def batch_of(position: str, total: str, per_batch: int = 5) -> str:
    """Zero-based batch of the 1-based position when total/per_batch equal batches take all rows and the last one the
    remainder (SQL text)."""
    batches = f"greatest(1L, {total} div {per_batch})"
    return f"least(({position} - 1) div greatest(1L, {total} div {batches}), {batches} - 1)"


# ----------------------------------------------------------------------------------------------- MT103 messages
BICS = tuple(f"{bank}{country}{n:02}XXX" for n, (bank, country) in enumerate(
    (("ALDR", "AT"), ("BRWT", "BE"), ("CPRQ", "CH"), ("DUNE", "DE"), ("ESTG", "ES"), ("FRNH", "FR"), ("GLDN", "GB"), ("HVEN", "HU"), ("ISLA", "IE"), ("JUNI", "IT")), 22))
MT_CURRENCIES = ("AUD", "CAD", "CHF", "CZK", "DKK", "EUR", "GBP", "HKD", "NOK", "NZD", "PLN", "SEK", "SGD", "USD", "ZAR")
CHARGES = ("SHA", "OUR", "BEN")


def mt103(drive: DataFrame, seed, row: str, as_of: str, cents: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One message per row. The receiver is picked at an offset from the sender, so the two always differ."""
    array = "array(" + ", ".join(q(b) for b in BICS) + ")"
    sender = f"cast({seeded.u32(seed, row, 'sender')} % {len(BICS)} as int)"
    receiver = f"element_at({array}, ({sender} + 1 + cast({seeded.u32(seed, row, 'receiver')} % {len(BICS) - 1} as int)) % {len(BICS)} + 1)"
    day = render_date(near_date(seed, row, "day", as_of, 1), "YYMMDD")
    parts = [
        f"concat('{{1:F01', element_at({array}, {sender} + 1), '0000000000}}')", f"concat('{{2:I103', {receiver}, 'N}}')",
        f"concat('{{3:{{108:REF', {seeded.digits(seed, row, 'ref', 4)}, '}}}}')", "'{4:'",
        f"concat(':20:TXN', lpad(cast({row} as string), 12, '0'))", "':23B:CRED'",
        f"concat(':32A:', {day}, {seeded.pick(seed, row, 'ccy', MT_CURRENCIES)}, {checks.cents_to_swift_amount(cents)})",
        f"concat(':50K:/', {seeded.digits(seed, row, 'payer', 16)})", person(seed, row, "payer_name"),
        seeded.pick(seed, row, "payer_city", CITIES), f"concat(':57A:', {receiver})",
        f"concat(':59:/', {seeded.digits(seed, row, 'payee', 16)})", other_person(seed, row, "payee_name", "payer_name"),
        seeded.pick(seed, row, "payee_city", CITIES), f"concat(':70:/INV/', cast({row} as string))",
        "'GOODS DELIVERED AS AGREED'", f"concat(':71A:', {seeded.pick(seed, row, 'charge', CHARGES)})", "'-}'",
        f"concat('{{5:{{CHK:', {seeded.alnum(seed, row, 'chk', 12)}, '}}}}')"]
    return drive.select(*keep, F.expr(f"concat_ws('\\n', {', '.join(parts)})").alias("message"))


TAG_FIELDS = {"20": "tag_20_sender_reference", "23B": "tag_23b_bank_operation_code",
              "50K": "tag_50_ordering_customer_account", "57A": "tag_57a_account_with_institution",
              "59": "tag_59_beneficiary_customer", "70": "tag_70_remittance_information",
              "71A": "tag_71a_details_of_charges", "72": "tag_72_sender_to_receiver_info"}


def parse_mt103(messages: DataFrame, key: str, message: str = "message") -> DataFrame:
    """Tags of each message; a tag's text runs to the next tag or the end of the block; 32A splits in three."""
    def tag(name: str) -> str:
        return f"regexp_extract({message}, {q(rf'(?s)(?:^|\n):{name}:(.*?)(?=\n:[0-9]{{2}}[A-Z]?:|\n-\}}|\z)')}, 1)"

    value32 = tag("32A")
    cols = [F.expr(tag(t)).alias(name) for t, name in TAG_FIELDS.items()]
    return messages.select(
        key, *cols, F.expr(f"substring({value32}, 1, 6)").alias("tag_32a_value_date"),
        F.expr(f"substring({value32}, 7, 3)").alias("tag_32a_currency"), F.expr(f"substring({value32}, 10)").alias("tag_32a_amount"))


def split_messages(files: DataFrame, key: str, text: str) -> DataFrame:
    """Whole files to messages: separator lines of three hyphens; blank pieces go."""
    pieces = files.select(key, F.expr(f"posexplode(split({text}, '(?m)^---$')) as (message_no, message)"))
    return pieces.withColumn("message", F.trim(F.regexp_replace("message", r"^\s+|\s+$", ""))).filter("message <> ''")


def mt103_lines(parsed: DataFrame, key: str, spec: Spec, quote: str = "\x1f") -> DataFrame:
    """Parsed messages as delimited lines in spec order, ready for the field checks."""
    return parsed.select(F.col(key).alias("line_no"), F.lit("mt103").alias("file_id"),
                         F.concat_ws(quote, *[F.coalesce(F.col(f.name), F.lit("")) for f in spec.fields]).alias("line"))


# ------------------------------------------------------------------------------------- learned fixed-width layouts
def learned_layout(lines: DataFrame, record_id: str, width: int) -> tuple[list[dict], DataFrame]:
    """Boundary-learned fields of one record id and the long table of their values.

    The field list (at most one entry per character position) comes to the driver to build the plan; values stay."""
    from tallyframe.operators import profile
    grouped = lines.filter(F.col("rid") == record_id)
    bounds = profile.learned_boundaries(grouped, ["rid"], str(width)).orderBy("field_no").collect()
    cells = ", ".join(f"struct('{b['field_no']:03d}' as field, trim(substring(line, {b['start'] + 1}, {b['end'] - b['start']})) as value)" for b in bounds)
    long = grouped.filter(F.length("line") >= width).select(F.expr(f"inline(array({cells}))"), F.col("line_no").alias("pos"))
    counts = profile.value_counts(long)
    kinds = {r["field"]: r for r in profile.strict_ladder(counts).join(
        counts.groupBy("field").agg(F.expr("min_by(value, first_pos) as example")), "field").collect()}
    fields = []
    for b in bounds:
        k = kinds.get(f"{b['field_no']:03d}")
        fields.append({"field": f"{b['field_no']:03d}", "start": b["start"] + 1, "length": b["end"] - b["start"],
                       "type": k["type"] if k else "BLANK", "example": k["example"] if k else ""})
    return fields, counts


def from_learned(drive: DataFrame, row: str, lines: DataFrame, record_id: str, width: int, seed: int, as_of: str) -> DataFrame:
    """One line per row of ``drive`` in a layout learned from sample lines: constants repeat, numbers, amounts, dates and
    times are drawn by type, text fields come from an n-gram model of their own values."""
    from tallyframe.operators import ngram
    fields, counts = learned_layout(lines, record_id, width)
    rows_ = drive.select(F.col(row).alias("row"))
    cols = {}
    for f in fields:
        name, n, kind = f"f{f['field']}", f["length"], f["type"]
        if kind == "FIXED":
            text = q(f["example"])
        elif kind == "AMOUNT":
            text = amount(seed, "row", name, n)
        elif kind.startswith("DATE"):
            text = render_date(near_date(seed, "row", name, as_of), "YYYYMMDD" if kind.endswith("YYYYMMDD") else "YYMMDD")
        elif kind == "TIME":
            text = clock(seed, "row", name)
        elif kind == "NUMERIC":
            text = seeded.digits(seed, "row", name, n)
        elif kind == "BLANK":
            text = "''"
        else:
            cols[name] = None
            continue
        cols[name] = fixed.fit(text, n)
    out = rows_.select("row", *[F.expr(t).alias(c) for c, t in cols.items() if t])
    for f in fields:
        name = f"f{f['field']}"
        if cols[name] is None:
            own = counts.filter(F.col("field") == f["field"])
            model = ngram.model(own, "field", "value", weight="n")
            drawn = ngram.generate_text(rows_.withColumn("field", F.lit(f["field"])), "row", "field", model, f["length"], seed=seed)
            out = out.join(drawn.select("row", F.col("text").alias(name)), "row")
    parts = ", ".join(f"rpad(f{f['field']}, {f['length']}, ' ')" for f in fields)
    return out.select("row", F.expr(f"concat({parts}) as line"))
