"""Learning specs from spec documents: a table of text lines (spec, line_no, line) of many documents to field rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions import fixed
from tallyframe.functions.sqltext import q
from tallyframe.operators import ordered
from tallyframe.session import written

# ---------------------------------------------------------------------------------------------------------------
# Wordings, type codes and line shapes that spec documents use.
# ---------------------------------------------------------------------------------------------------------------
TYPE_WORDS = (
    ("numeric|num|n", "numeric"),
    ("alpha|alphanumeric|an|a", "alphanumeric"),
    ("date", "date"),
    ("amount|amt", "amount"),
    ("boolean|bool|flag", "boolean"),
    ("blank|filler|reserved", "filler"),
    ("routing|aba|rtn", "routing_number"),
    ("account", "account_number"),
)
TYPE_CODES = {"N": "numeric", "AN": "alphanumeric", "A": "alpha", "NUM": "numeric", "ALPHA": "alpha", "DT": "date",
              "AMT": "amount", "DATE": "date", "BOOL": "boolean"}
DEFAULT_LENGTHS = {"numeric": 10, "alphanumeric": 35, "date": 8, "amount": 12, "routing_number": 9,
                   "account_number": 17, "boolean": 1, "filler": 1}
REQUIRED_WORDS = r"\b(required|mandatory|must)\b"
OPTIONAL_WORDS = r"\b(optional|conditional|if applicable)\b"
RANGED_FIELD = r"(?i)(\w[\w\s\-/]+?)\s+(\d+)[-–to ]+(\d+)\s+(\d+)(?:\s+(\w+))?"
PLACED_FIELD = r"(?i)(\d+)\s+([A-Za-z][\w\s\-/]+?)\s+(\d+)(?:\s+(\w+))?"
NAMED_FIELD = r"^([A-Z][A-Z0-9_\s]{2,}?):\s+(.+)$"
FIELD_LINES = (
    r"(?i)[\w\s]+?\s+\d+[-–]\d+\s+\d+\s+\w+",
    r"(?i)\d+\s+[\w\s]+?\s+\d+\s+\w+",
    r"(?i)Field\s+\d+[\s:]+[^\n]+",
    r"(?i)[A-Z][A-Z\s_]+\s*[:=]\s*[^\n]+",
)
RANGE_WORDING = r"(?i)(?:range|values?)[\s:]+(\d+)\s*[-–to]+\s*(\d+)"
LIST_WORDING = r"(?i)(?:one of|values?)[\s:]+([A-Z0-9,\s/|]+)"
FORMAT_WORDING = r"(?i)format[\s:]+([YMD0-9X]+)"
# ---------------------------------------------------------------------------------------------------------------


def inferred_type(line: str) -> str:
    arms = " ".join(f"when lower({line}) rlike {q(rf'\b({words})\b')} then {q(kind)}" for words, kind in TYPE_WORDS)
    return f"case {arms} else 'alphanumeric' end"


def is_field_line(line: str) -> str:
    shapes = " or ".join(f"{line} rlike {q(p)}" for p in FIELD_LINES)
    return f"({shapes} or ({line} rlike '[0-9]+' and {line} rlike '[A-Za-z]{{3,}}' and length({line}) < 200))"


def resolve_type(code: str, fallback: str) -> str:
    arms = " ".join(f"when {q(k)} then {q(v)}" for k, v in TYPE_CODES.items())
    return f"case upper({code}) {arms} else {fallback} end"


def is_required(line: str) -> str:
    return f"case when lower({line}) rlike {q(REQUIRED_WORDS)} then true when lower({line}) rlike {q(OPTIONAL_WORDS)} then false else true end"


def guessed_length(text: str, kind: str) -> str:
    arms = " ".join(f"when {q(k)} then {v}" for k, v in DEFAULT_LENGTHS.items())
    return f"coalesce(try_cast(regexp_extract({text}, '[0-9]+', 0) as int), case {kind} {arms} else 20 end)"


def rules(line: str) -> str:
    """struct(min, max, allowed, format) from the wording of a line."""
    allowed = f"regexp_extract({line}, {q(LIST_WORDING)}, 1)"
    return f"""struct(try_cast(regexp_extract({line}, {q(RANGE_WORDING)}, 1) as bigint) as min_value,
        try_cast(regexp_extract({line}, {q(RANGE_WORDING)}, 2) as bigint) as max_value,
        if({line} rlike {q(LIST_WORDING)}, array_join(filter(split({allowed}, '[,|/ \\t]+'), x -> x <> ''), ','), null) as allowed,
        nullif(regexp_extract({line}, {q(FORMAT_WORDING)}, 1), '') as format)"""


def tokens(lines: DataFrame) -> DataFrame:
    """Non-blank, non-comment lines with words, numbers, inferred type and the field-line flag."""
    rows = lines.withColumn("raw", F.trim("line")).filter("raw <> '' and raw not like '#%'")
    return rows.select(
        "spec", "line_no", "raw", F.expr("transform(regexp_extract_all(raw, '[A-Za-z_]+', 0), w -> lower(w)) as words"),
        F.expr("transform(regexp_extract_all(raw, '[0-9]+', 0), n -> try_cast(n as bigint)) as numbers"),
        F.expr(f"{inferred_type('raw')} as data_type"), F.expr(f"{is_field_line('raw')} as is_field"))


def parsed_fields(tokenized: DataFrame) -> DataFrame:
    """Field lines to fields by three shapes: ``name a-b len type``, ``pos name len type``, ``NAME: text``."""
    def part(pattern: str, group: int) -> str:
        return f"regexp_extract(raw, {q(pattern)}, {group})"

    def number(pattern: str, group: int) -> str:
        return f"try_cast({part(pattern, group)} as int)"

    shaped = tokenized.filter("is_field").withColumn("shape", F.expr(
        f"case when raw rlike {q(RANGED_FIELD)} then 1 when raw rlike {q(PLACED_FIELD)} then 2 when raw rlike {q(NAMED_FIELD)} then 3 end")) \
        .filter("shape is not null")
    typed = [resolve_type(f"nullif({part(p, g)}, '')", "data_type") for p, g in ((RANGED_FIELD, 5), (PLACED_FIELD, 4))]
    return shaped.select(
        "spec", F.col("line_no").alias("source_line"),
        fixed.spec_name(F.expr(f"case shape when 1 then {part(RANGED_FIELD, 1)} when 2 then {part(PLACED_FIELD, 2)} else {part(NAMED_FIELD, 1)} end")).alias("name"),
        F.expr(f"case shape when 1 then {number(RANGED_FIELD, 2)} when 2 then {number(PLACED_FIELD, 1)} end as start"),
        F.expr(f"case shape when 1 then {number(RANGED_FIELD, 3)} when 2 then {number(PLACED_FIELD, 1)} + {number(PLACED_FIELD, 3)} - 1 end as end"),
        F.expr(f"case shape when 1 then {number(RANGED_FIELD, 4)} when 2 then {number(PLACED_FIELD, 3)} else {guessed_length(part(NAMED_FIELD, 2), 'data_type')} end as length"),
        F.expr(f"case shape when 1 then {typed[0]} when 2 then {typed[1]} else data_type end as data_type"),
        F.expr(f"if(shape = 3, true, {is_required('raw')}) as required"),
        F.expr(f"if(shape = 3, null, {rules('raw')}) as rules"))


def first_wins(fields: DataFrame) -> DataFrame:
    """One field per (spec, name): the earliest line, by a map-side combined minimum."""
    rest = [c for c in fields.columns if c not in ("spec", "name")]
    packed = fields.groupBy("spec", "name").agg(F.min_by(F.struct(*rest), "source_line").alias("f"))
    return packed.select("spec", "name", "f.*")


def positioned(fields: DataFrame) -> DataFrame:
    """Positions for specs in which no field has one: 1 + the lengths before it."""
    any_start = fields.groupBy("spec").agg(F.max(F.col("start").isNotNull()).alias("has_start"))
    summed = ordered.running_sums(fields, ["spec"], ["source_line"], {"upto": F.col("length")}, per_group=any_start)
    return summed.select(
        "spec", "name", "source_line",
        F.expr("if(has_start, start, cast(upto - length + 1 as int)) as start"),
        F.expr("if(has_start, end, cast(upto as int)) as end"), "length", "data_type", "required", "rules")


def learn(lines: DataFrame) -> DataFrame:
    """Spec documents to field tables. Positions need several passes over the fields, so the lines' patterns are matched in one before."""
    return positioned(written(first_wins(parsed_fields(tokens(lines))), "learned-fields"))
