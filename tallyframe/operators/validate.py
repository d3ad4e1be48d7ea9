"""Field validation: the spec is compiled into native expressions, one per record type, that check all fields of a line in its own
row, so the whole pass is one stage without UDF, join or shuffle."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions import checks, fixed
from tallyframe.functions.sqltext import q
from tallyframe.session import written
from tallyframe.sources.layouts import Field, Spec, spec_table

FIELD_ERROR_CAP = 5
REPORT_ERRORS, REPORT_WARNINGS, VALUE_CHARS = 200, 100, 80
AMOUNT = r'^[0-9]+(\.[0-9]{0,2})?$'


# ------------------------------------------------------------------------------------------------- records
def classified(lines: DataFrame, spec: Spec) -> DataFrame:
    """Add ``record_type``: null when unknown, ``padding`` for all-nine lines of 94, ``names`` for a header row.

    A spec with one record type matches every line; a delimited spec picks the definition by its field count."""
    types = spec.record_types
    if spec.delimiter:
        width = F.size(F.split("line", fixed.regex_quote(spec.delimiter), -1))
        *others, last = types
        kind = F.lit(last)
        for rt in others:
            kind = F.when(width == len(spec.of(rt)), F.lit(rt)).otherwise(kind)
        if spec.has_header:
            kind = F.when(F.col("line_no") == 1, F.lit("names")).otherwise(kind)
        return lines.withColumn("record_type", kind)
    if len(types) == 1:
        return lines.withColumn("record_type", F.lit(types[0]))
    if any(len(t) > 2 for t in types):  # card file: sentinel letters around detail lines
        outer = {f.fixed: f.record_type for f in spec.fields if f.pos == 1 and f.fixed}
        detail = next(r.record_type for r in spec.records if r.category == "detail")
        kind = F.lit(detail)
        for sentinel, rt in outer.items():
            kind = F.when(F.substring("line", 1, len(sentinel)) == sentinel, F.lit(rt)).otherwise(kind)
        return lines.withColumn("record_type", kind)
    return lines.withColumn("record_type", fixed.classify(F.col("line"), types, "9" * 94))


# -------------------------------------------------------------------------------------------------- checks
FOUND = "array<struct<pos:int,field:string,value:string,codes:string>>"


def valid_pattern(pattern: str | None) -> bool:
    """An invalid pattern is ignored, not an error."""
    if not pattern:
        return False
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def type_ok(f: Field, v: str, nine: str | None) -> str | None:
    """Predicate of the lenient dialect for a field's data type on ``v``; None where everything is accepted.

    Routing fields eight wide carry no check digit: with a check-digit field behind them both are tested as nine
    digits (``nine``), else only the digits are."""
    if f.data_type == "date":
        return checks.date_ok(v, f.fmt)
    if f.data_type == "routing_number":
        if f.length != 8:
            return checks.aba_ok(checks.only_digits(v))
        return checks.aba_ok(nine) if nine else f"{v} rlike '^[0-9]{{8}}$'"
    return {"numeric": f"{v} rlike '^[0-9]+$'", "alpha": f"{v} rlike '^[A-Za-z ]+$'", "amount": f"{v} rlike {q(AMOUNT)}",
            "swift_amount": f"{v} rlike '^[0-9]+,[0-9]{{0,3}}$' and coalesce({checks.swift_amount_to_cents(v)}, 0) > 0"}.get(f.data_type)


def _texts(values) -> str:
    return f"array({', '.join(q(x) for x in values)})"


def _joined(tests: list[tuple[str, str]]) -> str:
    """Codes of the tests that hold, comma-separated."""
    if len(tests) == 1:
        return f"if({tests[0][0]}, '{tests[0][1]}', '')"
    arms = [f"if({test}, '{code}', null)" for test, code in tests]
    return f"concat_ws(',', {', '.join(arms)})" if arms else "''"


def lenient_field(f: Field, v: str, nine: str | None) -> tuple[str, int, str]:
    """Codes of a trimmed value ``v``, the checks that they count, and whether it is blank; PASS stands for one more that was passed."""
    ok, bad, counted = type_ok(f, v, nine), [], 1
    if f.length is not None:
        bad.append((f"length({v}) > {f.length}", "LENGTH"))
        counted += 1
    if ok:
        bad.append((f"not coalesce({ok}, false)", {"date": "DATE", "routing_number": "ROUTING"}.get(f.data_type, "TYPE")))
    if f.allowed:
        bad.append((f"not array_contains({_texts(f.allowed)}, {v})", "ALLOWED"))
    if valid_pattern(f.pattern):
        bad.append((f"not {checks.full_match(v, f.pattern)}", "PATTERN"))
    if f.name == "tag_20_sender_reference":
        bad.append((f"{v} like '/%' or {v} like '%/'", "SLASH"))
    if f.min_value is not None and f.max_value is not None and f.data_type != "amount":
        low, high = _double(f.min_value), _double(f.max_value)
        inside = f"{checks.to_number(v)} between {low} and {high}"
        bad += [(f"not ({inside})", "RANGE"), (inside, "PASS")]
    blank = f"{v} = ''"
    codes = f"if({blank}, '{'REQUIRED' if f.required else ''}', {_joined(bad)})"
    return codes if f.fixed is None else f"if({v} <> {q(f.fixed)}, 'FIXED', {codes})", counted, blank


def strict_field(f: Field, v: str, width: int | None) -> tuple[str, int, str]:
    """The same for an untrimmed value. One cut from a line is blank or as wide as its place, ``width``: bounds that hold for this
    are counted without a test."""
    plain, bad = f"{v} rlike '^[0-9]{{1,18}}$'", []  # what nearly all numbers are: told by one test, read without cleaning
    number = f"if({plain}, cast({v} as double), {checks.to_number(v)})"
    held = 0
    for bound, sign, code in ((f.min_len, "<", "MIN_LENGTH"), (f.max_len, ">", "MAX_LENGTH")):
        if bound is not None and width is not None and (width >= bound if sign == "<" else width <= bound):
            held += 1
        elif bound is not None:
            bad.append((f"length({v}) {sign} {bound}", code))
    if f.allowed:
        bad.append((f"not array_contains({_texts(f.allowed)}, {v})", "ALLOWED"))
    if valid_pattern(f.pattern):
        bad.append((f"not {checks.full_match(v, f.pattern)}", "PATTERN"))
    if f.data_type in ("numeric", "amount"):
        bad.append((f"not {plain} and {checks.to_number(v)} is null", "NOT_NUMERIC"))
        if f.min_value is not None:
            # digits alone are no less than zero
            bad.append((f"not {plain} and {checks.to_number(v)} < {_double(f.min_value)}" if f.min_value <= 0 else f"{number} < {_double(f.min_value)}", "MIN_VALUE"))
        if f.max_value is not None:
            bad.append((f"{number} > {_double(f.max_value)}", "MAX_VALUE"))
    if f.checksum == "luhn":
        bad.append((f"not {checks.luhn_ok(v)}", "LUHN"))
    if f.checksum in ("aba", "mod10") and f.data_type == "routing_number":
        bad.append((f"not {checks.aba_ok(f'trim({v})')}", "ABA"))
    blank = f"trim({v}) = ''"
    return f"if({blank}, '{'REQUIRED' if f.required else ''}', {_joined(bad)})", held + len(bad), blank


def _double(bound) -> str:
    return f"cast({q(repr(float(bound)))} as double)"


UNCOUNTED = {"strict": "('RECORD_LENGTH', 'RECORD_TYPE')", "lenient": "('RECORD_LENGTH', 'RECORD_TYPE', 'ALLOWED', 'PATTERN', 'SLASH', 'RANGE')"}


@dataclasses.dataclass
class RecordChecks:
    """SQL text for lines of one kind. ``cells``: the values of its fields; ``codes``: an array of codes, the line's own and one for
    each field; ``good``: the checks that a line without codes passes; ``counts``, ``places``, ``names``: by entry of ``codes``, the checks that
    the field counts, its position and its name. All that the spec says of a field is a literal, so a field costs only the tests it has."""

    cells: str
    codes: str
    good: str
    counts: str
    places: str
    names: str


def _strings(items: list[str]) -> str:
    return f"array({', '.join(items)})" if items else "cast(array() as array<string>)"


def record_checks(spec: Spec, kind: str, dialect: str) -> RecordChecks:
    width = None if spec.delimiter else max((r.length or 0) for r in spec.records) or None
    notes = [(f"length <> {width}", "RECORD_LENGTH")] if width else []
    notes += [("true", "RECORD_TYPE")] if kind == "?" else []
    fields = list(spec.of(kind)) if kind in spec.record_types else []
    cut, codes, total, blanks, counts = [], [_joined(notes)], 0, [], [0]
    nines = {}  # field number: its routing number with the check digit behind it, a further cell
    for i, f in enumerate(fields):
        if dialect == "lenient" and f.data_type == "routing_number" and f.length == 8 and any(x.pos == f.pos + 1 and x.name == "check_digit" for x in fields):
            nines[i] = len(fields) + len(nines)
    if spec.delimiter:
        cells = _strings([_trimmed(f"coalesce(try_element_at(parts, {f.pos}), '')", dialect) for f in fields] + ["cast(null as string)"] * len(nines))
    else:
        # a place in bytes is found at once; characters are counted from the line's start for each field
        for piece in ("cast(substring(bytes, {0}, {1}) as string)", "substring(line, {0}, {1})"):
            values = [_trimmed(f"if(length >= {f.end}, {piece.format(f.start, f.end - f.start + 1)}, '')", dialect) for f in fields]
            values += [f"concat({piece.format(fields[i].start, fields[i].length)}, {piece.format(fields[i].end + 1, 1)})" if fields[i].start else "cast(null as string)" for i in nines]
            cut.append(_strings(values))
        cells = f"if(bytes is not null, {cut[0]}, {cut[1]})"
    for i, f in enumerate(fields):
        if dialect == "lenient":
            found, counted, blank = lenient_field(f, f"cells[{i}]", f"cells[{nines[i]}]" if i in nines else None)
        else:
            found, counted, blank = strict_field(f, f"cells[{i}]", None if spec.delimiter else f.end - f.start + 1)
        codes.append(found)
        counts.append(counted)
        total += counted
        if not f.required and counted != 1:  # a blank value passes one check: that it may be blank
            blanks.append(f"if({blank} and codes[{i + 1}] = '', {1 - counted}, 0)")
    return RecordChecks(cells, _strings(codes), " + ".join([f"{total}L", *blanks]), f"array({', '.join(map(str, counts))})",
                        f"array({', '.join(['0', *[str(f.pos) for f in fields]])})", _texts(["LINE", *[f.name for f in fields]]))


def _trimmed(value: str, dialect: str) -> str:
    return f"trim({value})" if dialect == "lenient" else value


def _compiled(expression: str) -> str:
    """The expression in a projection of its own methods. Generated code for a whole stage puts all of a line's checks into one method, too
    long to be compiled; a lambda in it, here one over a single number, keeps an expression out of that."""
    return f"if(exists(array(length), x -> x < 0), null, {expression})"


def checked(lines: DataFrame, spec: Spec, dialect: str = "lenient") -> DataFrame:
    """One row per line with ``good``, the passed checks of its fields, and ``found``, an entry for each field (position 0 = the line)
    that has findings, its ``codes`` as comma-separated text.

    The spec is compiled into expressions per record type, so lines are read once, a line stays one row and nothing is shuffled;
    only findings and per-file sums travel. ``lenient`` trims and checks presence, fixed value, length, type, allowed
    values, pattern and range; ``strict`` checks the untrimmed value against length bounds, allowed values, pattern,
    number, range and checksums.

    A line goes through three projections: its values, their codes, the outcome. Values and codes are generated code without a lambda;
    the lambdas of the outcome run only for lines that have codes."""
    rows = classified(lines, spec).select("file_id", "line_no", "record_type", "line", F.coalesce("record_type", F.lit("?")).alias("kind"), F.length("line").alias("length"))
    if spec.delimiter:
        rows = rows.withColumn("parts", F.split("line", fixed.regex_quote(spec.delimiter), -1))
    else:
        rows = rows.withColumn("bytes", F.expr("if(octet_length(line) = length, cast(line as binary), null)"))
    by_kind = {kind: record_checks(spec, kind, dialect) for kind in [*spec.record_types, "?", "padding", "names"]}

    def arms(part: str) -> str:
        return "case kind " + " ".join(f"when {q(kind)} then {getattr(made, part)}" for kind, made in by_kind.items()) + " end"

    gained = f"""case when c = '' then 0 when c in ('REQUIRED', 'FIXED') then -element_at({arms("counts")}, i + 1)
        else aggregate(split(c, ','), 0, (n, x) -> n + if(x in {UNCOUNTED[dialect]}, 0, if(x = 'PASS', 1, -1))) end"""
    shown = "if(contains(c, 'PASS'), array_join(array_remove(split(c, ','), 'PASS'), ','), c)"
    found = f"""transform(filter(transform(codes, (c, i) -> struct(i as i, {shown} as codes)), h -> h.codes <> ''), h -> struct(
        element_at({arms("places")}, h.i + 1) as pos, element_at({arms("names")}, h.i + 1) as field, if(h.i = 0, line, element_at(cells, h.i)) as value, h.codes as codes))"""
    clean = "array_max(codes) = ''"
    done = (rows.withColumn("cells", F.expr(_compiled(arms("cells")))).drop("parts", "bytes").withColumn("codes", F.expr(_compiled(arms("codes"))))
            .withColumns({"good": F.expr(f"({arms('good')}) + if({clean}, 0L, aggregate(transform(codes, (c, i) -> {gained}), 0L, (a, x) -> a + x))"),
                          "found": F.expr(f"if({clean}, cast(array() as {FOUND}), cast({found} as {FOUND}))")}))
    # a one-element ``inline`` evaluates the outcome once per line; as plain columns the optimizer would repeat it in filters on findings
    return done.select("file_id", "line_no", "record_type", F.expr("inline(array(struct(good, found)))"))


def errors(result: DataFrame) -> DataFrame:
    """Long error table: file_id, line_no, record_type, field, pos, severity, code, value (whole; a line's own finding has the line)."""
    return _coded(result.select("file_id", "line_no", "record_type", F.inline("found")))


def _coded(cells: DataFrame) -> DataFrame:
    """A row per code of fields with findings."""
    found = cells.withColumn("code", F.explode(F.split("codes", ",")))
    return found.select(
        "file_id", "line_no", "record_type", F.when(F.col("pos") == 0, F.col("code")).otherwise(F.col("field")).alias("field"),
        "pos", F.when(F.col("pos") == 0, "WARNING").otherwise("ERROR").alias("severity"), "code", "value")


def capped_field_errors(found: DataFrame, cap: int = FIELD_ERROR_CAP) -> DataFrame:
    """Per (file, record type, field): a line is not checked any more once earlier lines gave ``cap`` errors; all
    errors of the crossing line stay. Each erring line adds at least one, so the first ``cap`` erring lines suffice:
    ``dense_rank <= cap`` is a group limit that runs before the shuffle."""
    group = Window.partitionBy("file_id", "record_type", "field").orderBy("line_no")
    few = (found.filter(F.col("severity") == "ERROR").withColumn("_rank", F.dense_rank().over(group))
           .filter(F.col("_rank") <= cap))
    before = group.rangeBetween(Window.unboundedPreceding, -1)
    return (few.withColumn("_before", F.count(F.lit(1)).over(before)).filter(F.col("_before") < cap)
            .drop("_rank", "_before"))


def capped_report(found: DataFrame, errors_cap: int = REPORT_ERRORS, warnings_cap: int = REPORT_WARNINGS) -> DataFrame:
    """First 200 errors and 100 warnings per file, in line and field order; values are cut to 80 characters, an unknown record type
    to its letter."""
    order = Window.partitionBy("file_id", "severity").orderBy("line_no", "pos", "code")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(errors_cap, warnings_cap))
    ranked = ranked.filter(F.col("rank") <= F.when(F.col("severity") == "ERROR", errors_cap).otherwise(warnings_cap))
    return ranked.withColumn("value", F.when(F.col("code") == "RECORD_TYPE", F.substring("value", 1, 1)).otherwise(F.substring("value", 1, VALUE_CHARS)))


def report(result: DataFrame) -> DataFrame:
    """Per file: lines, passed and failed checks, warnings, affected lines, validity and score percent."""
    def codes(fields: str) -> str:
        return f"sum(aggregate(filter(found, x -> {fields}), 0L, (a, x) -> a + size(split(x.codes, ','))))"
    return report_scores(result.groupBy("file_id").agg(
        F.expr("count(1) as total_records"),
        F.expr("sum(good) as passed"),
        F.expr(f"{codes('x.pos > 0')} as failed"),
        F.expr(f"{codes('x.pos = 0')} as warnings"),
        F.expr("count(distinct if(exists(found, x -> x.pos > 0), line_no, null)) as records_with_errors")))


def report_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "is_valid": F.col("failed") == 0,
        "score": F.expr("if(passed + failed = 0, 0D, round(100D * passed / (passed + failed), 2))")})


def findings_once(result: DataFrame) -> DataFrame:
    """What ``checked`` found, once, for both the report and the error table: a row per finding's field, and all other checks of a
    file added up in one row (combined map-side, so only findings and one row per file and task travel)."""
    cells = result.select("file_id", F.expr("""inline(concat(
        array(struct(if(false, struct(line_no, record_type, 0 as pos, '' as field, '' as value, '' as codes), null) as finding, good, 1L as lines)),
        transform(found, x -> struct(struct(line_no, record_type, x.pos, x.field, x.value, x.codes) as finding, 0L as good, 0L as lines))))"""))
    sums = cells.groupBy("file_id", "finding").agg(F.sum("good").alias("good"), F.sum("lines").alias("lines"))
    return sums.select("file_id", "finding.*", "good", "lines")


def reported(once: DataFrame) -> DataFrame:
    """``report`` from ``findings_once``."""
    found = "if(codes is null, 0L, cast(size(split(codes, ',')) as bigint))"
    return report_scores(once.groupBy("file_id").agg(
        F.expr("sum(lines) as total_records"), F.expr("sum(good) as passed"), F.expr(f"sum(if(pos > 0, {found}, 0)) as failed"),
        F.expr(f"sum(if(pos = 0, {found}, 0)) as warnings"), F.expr("count(distinct if(pos > 0, line_no, null)) as records_with_errors")))


def all_findings(result: DataFrame) -> DataFrame:
    """The whole outcome of a validation, whatever its size: every finding of every file in a row of its own, next to the file's report;
    files without a finding have one row without one. Lines are checked once."""
    once = written(findings_once(result), "findings")
    return reported(once).join(_coded(once.filter("codes is not null")), "file_id", "left")


def error_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("record_type", "field", "code").agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"))


# ------------------------------------------------------------------------------------------- long field table
def field_values(lines: DataFrame, spec: Spec) -> DataFrame:
    """One row per line x field: equi-join with the spec table, whose size is fixed by the layouts."""
    spark = lines.sparkSession
    fields = F.broadcast(spec_table(spark, spec).select("record_type", "field", "pos", "start", "end"))
    joined = classified(lines, spec).join(fields, "record_type")
    value = F.when(F.length("line") >= F.col("end"),
                   F.substr("line", F.col("start"), F.col("end") - F.col("start") + 1)).otherwise(F.lit(""))
    return joined.select("file_id", "line_no", "record_type", "pos", "field", F.trim(value).alias("value"))


def unknown_lines(lines: DataFrame, spec: Spec) -> DataFrame:
    """Lines whose first character is no known record type (padding excluded)."""
    types = F.broadcast(spec_table(lines.sparkSession, spec).select("record_type").distinct())
    first = lines.filter(F.col("line") != "9" * 94).withColumn("record_type", F.substring("line", 1, 1))
    return first.join(types, "record_type", "left_anti")


def prefix_matches(lines: DataFrame, prefixes: DataFrame, widths: list[int]) -> DataFrame:
    """Line x record definitions by prefix; a line may match several. ``prefixes`` (record_id, record_name) is a
    definition table; its few distinct widths turn the theta join into an equi-join on the cut prefix."""
    cut = F.explode(F.array(*[F.substring("line", 1, w) for w in widths]))
    return lines.withColumn("record_id", cut).join(prefixes, "record_id")


def generic_errors(matched: DataFrame, spec: Spec) -> DataFrame:
    """Prototype dialect: numeric and amount fields must be digits; fields past the line end are not checked."""
    rows = []
    for f in spec.fields:
        if f.data_type in ("numeric", "amount") and f.start:
            v = f"trim(substring(line, {f.start}, {f.end - f.start + 1}))"
            rows.append(f"if(record_id = {q(f.record_type)} and length(line) >= {f.end} and {v} <> '' and not {v} rlike "
                        f"'^[0-9]+$', struct({q(f.name)} as field, {v} as value), null)")
    exploded = matched.select("file_id", "line_no", "record_id", F.expr(f"inline(array_compact(array({', '.join(rows)})))"))
    return exploded


def wide_records(lines: DataFrame, spec: Spec, record_type: str) -> DataFrame:
    """One column per field (trimmed) for the lines of one record type."""
    cols = []
    for f in spec.of(record_type):
        v = fixed.split_field("line", spec.delimiter, f.pos) if spec.delimiter else fixed.slice_field("line", f.start, f.end)
        cols.append(F.expr(f"trim({v})").alias(f.name))
    rows = classified(lines, spec).filter(F.col("record_type") == record_type)
    return rows.select("file_id", "line_no", "record_type", *cols)


def conditional_requirements(wide: DataFrame, dependencies: dict[str, str]) -> DataFrame:
    """Fields that are required only under a condition, given as SQL text over the record's fields."""
    rows = [f"if(coalesce({condition}, false) and coalesce({name}, '') = '', {q(name)}, null)"
            for name, condition in dependencies.items()]
    return wide.select("file_id", "line_no", F.expr(f"explode(array_compact(array({', '.join(rows)}))) as field")) \
        .withColumn("code", F.lit("REQUIRED"))


# ------------------------------------------------------------------------------------------------ user rules
def apply_rules(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Record predicates over a wide record: one row per broken rule (null counts as broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return records.withColumn("rule", F.explode(broken))


def apply_transforms(records: DataFrame, transforms: dict[str, Column]) -> DataFrame:
    """Field transforms; a transform that yields null keeps the value."""
    return records.withColumns({name: F.coalesce(new, F.col(name)) for name, new in transforms.items()})


def field_rules(records: DataFrame, rules: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """User rules on single fields, each a function from Column to Column: one row per broken (rule, value)."""
    cells = [F.when(~F.coalesce(rule(F.col(name)), F.lit(False)), F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("value")))
             for name, rule in rules.items()]
    return records.withColumn("_b", F.explode(F.array_compact(F.array(*cells)))).select("*", "_b.field", "_b.value").drop("_b")


def text_rules(records: DataFrame, key: str, rules: list[str]) -> DataFrame:
    """Global rules as text ``left = right`` over the aggregates of a file (SQL vocabulary, never evaluated in Python)."""
    return file_rules(records, key, {rule: tuple(side.strip() for side in rule.split(" = ", 1)) for rule in rules})


def file_rules(records: DataFrame, key: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Aggregate rules as text (left, right): one row per file and rule whose sides differ."""
    sides = [F.struct(F.lit(name).alias("rule"), F.expr(left).cast("string").alias("expected"),
                      F.expr(right).cast("string").alias("actual")) for name, (left, right) in rules.items()]
    return (records.groupBy(key).agg(F.array(*sides).alias("_r")).select(key, F.explode("_r").alias("r"))
            .select(key, "r.*").filter(~F.col("expected").eqNullSafe(F.col("actual"))))
