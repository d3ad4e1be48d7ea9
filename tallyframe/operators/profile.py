"""Column profiling and type inference. All columns are unpivoted once; those that repeat their values are reduced to distinct
values with counts (map-side combined), so patterns and checksums run once per distinct value and a hot value costs one row.
Near-unique columns, found by a sketch, skip that shuffle: their rows go straight into the aggregations per field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions import checks
from tallyframe.functions.sqltext import q
from tallyframe.session import written

# ---------------------------------------------------------------------------------------------------------------
# Fixed values: (type, full-match pattern, weight) and (type, weight, name keywords) of the two voting schemes.
# ---------------------------------------------------------------------------------------------------------------
FIELD_PATTERNS = (
    ("DATE", r"\d{8}", 3.0),
    ("DATE", r"\d{4}[-/]\d{2}[-/]\d{2}", 3.5),
    ("DATE", r"\d{2}[-/]\d{2}[-/]\d{4}", 2.5),
    ("DATETIME", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*", 3.0),
    ("PAN", r"\d{13,19}", 1.2),
    ("EXPIRY", r"\d{2}/\d{2}", 2.5),
    ("EXPIRY", r"\d{4}", 0.4),
    ("ROUTING_NUMBER", r"\d{9}", 2.5),
    ("ACCOUNT_NUMBER", r"\d{6,17}", 0.5),
    ("AMOUNT", r"\$?-?\d{1,12}[.,]\d{2}", 3.5),
    ("AMOUNT", r"\d{4,10}", 0.4),
    ("NUMERIC", r"-?\d{1,5}", 0.8),
    ("BOOLEAN", r"(true|false|yes|no|0|1|y|n)", 3.0),
    ("ALPHANUMERIC", r"[A-Za-z0-9 ._-]+", 0.2),
)
FIELD_NAMES = (
    ("PAN", 2.0, "pan|card_number|card_num|primary_account"),
    ("EXPIRY", 2.0, "expiry|expiration|exp_date|exp_month|exp_year"),
    ("CVV", 3.0, "cvv|cvc|cvv2|security_code|card_code"),
    ("ROUTING_NUMBER", 2.0, "routing|aba|transit_num|routing_number"),
    ("ACCOUNT_NUMBER", 1.5, "account_number|acct_num|bank_account"),
    ("AMOUNT", 1.5, "amount|amt|total|balance|price|fee|charge"),
    ("DATE", 1.5, "date|dob|birth_date|settle_date|created"),
    ("DATETIME", 1.8, "timestamp|datetime|created_at|updated_at"),
    ("SEQUENCE", 1.5, "seq|sequence|record_num|line_number|id|trace"),
    ("BOOLEAN", 1.5, "is_|has_|flag|indicator|enabled|active"),
)
SAMPLE_PATTERNS = (
    ("DATE", r"\d{8}", 1.5),
    ("DATE", r"\d{4}-\d{2}-\d{2}", 2.0),
    ("DATETIME", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*", 2.0),
    ("PAN", r"\d{13,19}", 1.2),
    ("EXPIRY", r"\d{4}", 0.8),
    ("ROUTING_NUMBER", r"\d{9}", 1.3),
    ("ACCOUNT_NUMBER", r"\d{6,17}", 0.9),
    ("AMOUNT", r"\d+\.\d{2}", 2.0),
    ("AMOUNT", r"\d{5,12}", 0.7),
    ("NUMERIC", r"-?\d+", 1.0),
    ("ALPHANUMERIC", r"[A-Za-z0-9 ]+", 0.5),
    ("STRING", r".*", 0.1),
)
SAMPLE_NAMES = (
    ("PAN", 1.5, "pan|card_number|account_num"),
    ("EXPIRY", 1.2, "expiry|exp_date|expiration"),
    ("CVV", 1.5, "cvv|cvc|cvv2|security_code"),
    ("ROUTING_NUMBER", 1.3, "routing|aba|transit"),
    ("ACCOUNT_NUMBER", 1.0, "account|acct"),
    ("AMOUNT", 1.2, "amount|amt|total|price|fee"),
    ("DATE", 1.3, "date|dob|expiry|settle"),
    ("SEQUENCE", 1.2, "seq|sequence|counter|number|num"),
)
STRATEGY_WEIGHTS = {"regex": 1.0, "statistics": 0.8, "name": 0.6, "checksum": 1.5}
CONFIDENCE_THRESHOLD = 0.45
DATE_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}$", "YYYY-MM-DD"),
    (r"^\d{8}$", "YYYYMMDD"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/DD/YYYY"),
    (r"^\d{2}-\d{2}-\d{4}$", "MM-DD-YYYY"),
    (r"^\d{6}$", "YYMMDD"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}", "YYYY-MM-DDTHH:MM"),
)
DELIMITERS = ("|", "\t", ",", ";", "~")
RIGHT_JUSTIFIED = ("NUMERIC", "AMOUNT", "SEQUENCE")
SAMPLES = 10
MOST_VALUES = 4096
NEAR_UNIQUE = 0.1
# ---------------------------------------------------------------------------------------------------------------


def unpivot(rows: DataFrame, columns: dict[str, str], position: str) -> DataFrame:
    """(field, value, pos): every column of a row as text, trimmed, in one pass. ``columns`` maps names to SQL text."""
    cells = ", ".join(f"struct({q(n)} as field, trim(cast({text} as string)) as value)" for n, text in columns.items())
    return rows.select(F.expr(f"inline(array({cells}))"), F.expr(f"cast({position} as bigint) as pos"))


def value_counts(long: DataFrame) -> DataFrame:
    """Distinct non-empty values per field with count and first position."""
    return long.filter("value <> ''").groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def weighted(long: DataFrame, most: int = MOST_VALUES, share: float = NEAR_UNIQUE, in_place: bool | None = None) -> DataFrame:
    """Non-empty values with weights (field, value, n, first_pos, once): per field either its distinct values with counts (``once``
    true) or, for near-unique fields, its rows as they are with weight 1. Sums of ``n`` over a field agree in both forms.

    A first pass estimates the distinct values of every field. Fields with more than ``most`` of them that are also more than
    ``share`` of their rows gain little from counting and would shuffle most of the table, so their values stay where they are.
    ``most`` is far above the sizes that rules ask for (25 values at most), so an estimate cannot change a verdict. The
    estimates are broadcast: one row per column of the profiled table.

    ``in_place`` False counts all fields; by default that is so where the input has fewer files than the session has cores, as
    there the shuffle is what puts the cores to work (measured on one file of 150,000 rows and 8 cores: 18 s against 29 s)."""
    if in_place is None:
        in_place = not 0 < len(long.inputFiles()) < long.sparkSession.sparkContext.defaultParallelism
    if not in_place:
        return value_counts(long).withColumn("once", F.lit(True))
    if most < 100:
        raise ValueError("most must be at least 100, well above the value sets that types are told by")
    rows = long.filter("value <> ''")
    sizes = rows.groupBy("field").agg(F.approx_count_distinct("value").alias("_card"), F.count(F.lit(1)).alias("_rows"))
    unique = sizes.select("field", ((F.col("_card") > most) & (F.col("_card") > F.col("_rows") * share)).alias("_unique"))
    marked = rows.join(F.broadcast(unique), "field")
    counted = value_counts(marked.filter("not _unique")).withColumn("once", F.lit(True))
    return counted.unionByName(marked.filter("_unique").select(
        "field", "value", F.lit(1).cast("bigint").alias("n"), F.col("pos").alias("first_pos"), F.lit(False).alias("once")))


def profile(counts: DataFrame) -> DataFrame:
    """Length and numeric statistics of every field, from ``value_counts`` or ``weighted`` values. The exact number of distinct
    values of a near-unique field comes from the 16-byte hashes of its values, the only thing of it that is shuffled."""
    if "once" in counts.columns:
        hashes = counts.filter("not once").select("field", F.unhex(F.md5("value")).alias("_hash")).distinct()
        many = hashes.groupBy("field").agg(F.count(F.lit(1)).alias("_many"))
        found = profile(counts.drop("once"))
        return found.join(F.broadcast(many), "field", "left").withColumn(
            "distinct_values", F.coalesce("_many", "distinct_values")).drop("_many")
    num = checks.to_number("value")
    return counts.select("field", "n", "value", F.expr("length(value) as len"), F.expr(f"{num} as num")) \
        .groupBy("field").agg(
        F.sum("n").alias("non_empty"), F.count(F.lit(1)).alias("distinct_values"),
        F.expr("min(len) as min_len"), F.expr("max(len) as max_len"),
        F.expr("round(sum(len * n) / sum(n), 6) as mean_len"),
        F.expr("""round(if(sum(n) > 1, sqrt(greatest(0D, (sum(cast(len as double) * len * n)
            - sum(cast(len as double) * n) * sum(cast(len as double) * n) / sum(n)) / (sum(n) - 1))), 0D), 6) as stdev_len"""),
        F.expr("min(num) as min_value"), F.expr("max(num) as max_value"))


def pattern_rates(counts: DataFrame, patterns=FIELD_PATTERNS, ignore_case: bool = True) -> DataFrame:
    """(field, pattern_no, type, weight, rate): share of values that match each pattern, all patterns in one pass."""
    flag = "(?i)" if ignore_case else ""
    hits = [F.expr(f"sum(if(value rlike {q(f'{flag}^(?:{p})$')}, n, 0)) as h{i}") for i, (_, p, _) in enumerate(patterns)]
    wide = counts.groupBy("field").agg(F.sum("n").alias("total"), *hits)
    rows = ", ".join(f"struct({i} as pattern_no, {q(t)} as type, {w}D as weight, h{i} / total as rate)"
                     for i, (t, _, w) in enumerate(patterns))
    return wide.select("field", F.expr(f"inline(array({rows}))"))


def _facts(counts: DataFrame) -> DataFrame:
    """One row per field with the totals the statistical and checksum votes need."""
    plain = "translate(value, ',.-', '')"
    return counts.groupBy("field").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("card"),
        F.expr(f"sum(if({checks.to_number('value')} is not null, n, 0)) as numeric_n"),
        F.expr(f"bool_and({plain} rlike '^[0-9]+$') as digit_like"), F.expr("bool_and(value rlike '^[0-9]+$') as all_digits"),
        F.expr("min(length(value)) as lo"), F.expr("max(length(value)) as hi"),
        F.expr("length(min_by(value, first_pos)) as first_len"),
        F.expr(f"sum(if(value rlike '^[0-9]+$' and {checks.luhn_ok('value')}, n, 0)) as luhn_n"),
        F.expr(f"sum(if({checks.aba_ok('value')}, n, 0)) as aba_n"))


def _name_votes(fields: DataFrame, rules, strategy: str, base: int) -> DataFrame:
    rows = ", ".join(f"if(lower(field) rlike {q(k)}, struct({q(t)} as type, {w}D as score, {base + i} as ord), null)"
                     for i, (t, w, k) in enumerate(rules))
    return fields.select("field", F.lit(strategy).alias("strategy"), F.expr(f"inline(array_compact(array({rows})))"))


def field_votes(counts: DataFrame) -> DataFrame:
    """All weighted votes (field, strategy, type, score, ord); ``ord`` is the order in which ties are resolved."""
    rates = pattern_rates(counts).filter("rate > 0.5").groupBy("field", "type").agg(
        F.expr("sum(rate * weight) as score"), F.expr("min(pattern_no) as ord"))
    strong = rates.groupBy("field").agg(
        F.expr("coalesce(max(if(type = 'DATE', score, null)) >= 2.5, false) as date_wins"),
        F.expr("coalesce(max(if(type = 'ROUTING_NUMBER', score, null)) >= 2.0, false) as routing_wins"),
        F.expr("coalesce(max(if(type = 'PAN', score, null)) >= 1.0, false) as pan_wins"))
    regex = rates.join(strong, "field").filter(
        "not (date_wins and type in ('NUMERIC', 'AMOUNT')) and not (routing_wins and type in ('ACCOUNT_NUMBER', 'NUMERIC')) "
        "and not (pan_wins and type in ('ACCOUNT_NUMBER', 'NUMERIC'))").select(
        "field", F.lit("regex").alias("strategy"), "type", "score", "ord")
    facts = _facts(counts)
    statistics = facts.select("field", F.lit("statistics").alias("strategy"), F.expr("""inline(array_compact(array(
        if(numeric_n / total > 0.9 and digit_like, struct('NUMERIC' as type, numeric_n / total as score, 100 as ord), null),
        if(card between 2 and 25 and card / total < 0.25, struct('ENUM' as type, 1.2D as score, 101 as ord), null),
        if(lo = hi and lo = 9, struct('ROUTING_NUMBER' as type, 0.5D as score, 102 as ord), null),
        if(lo = hi and lo between 13 and 19, struct('PAN' as type, 0.5D as score, 103 as ord), null),
        if(lo = hi and lo = 4, struct('EXPIRY' as type, 0.3D as score, 104 as ord), null))))"""))
    names = _name_votes(facts.select("field"), FIELD_NAMES, "name", 200)
    checksum = facts.select("field", F.lit("checksum").alias("strategy"), F.expr("""inline(array_compact(array(
        if(all_digits and first_len between 13 and 19 and luhn_n / total > 0.8,
           struct('PAN' as type, luhn_n / total * 2.0D as score, 300 as ord), null),
        if(all_digits and first_len = 9 and aba_n / total > 0.8,
           struct('ROUTING_NUMBER' as type, aba_n / total * 2.0D as score, 301 as ord), null))))"""))
    votes = regex.unionByName(statistics).unionByName(names).unionByName(checksum)
    weight = " ".join(f"when {q(s)} then {w}D" for s, w in STRATEGY_WEIGHTS.items())
    return votes.withColumn("score", F.expr(f"score * case strategy {weight} end"))


def sample_votes(counts: DataFrame) -> DataFrame:
    """The simpler voting of the sample reader: every pattern counts, name bonuses, Luhn and enum bonus."""
    rates = pattern_rates(counts, SAMPLE_PATTERNS, ignore_case=False).filter("rate > 0").groupBy("field", "type").agg(
        F.expr("sum(rate * weight) as score"), F.expr("min(pattern_no) as ord")) \
        .select("field", F.lit("regex").alias("strategy"), "type", "score", "ord")
    facts = _facts(counts)
    names = _name_votes(facts.select("field"), SAMPLE_NAMES, "name", 200)
    candidates = rates.unionByName(names)
    pan = candidates.filter("type = 'PAN'").select("field").distinct()
    luhn = counts.join(F.broadcast(pan), "field").groupBy("field").agg(
        F.expr(f"sum(if({checks.luhn_ok('value')}, n, 0)) / sum(n) as rate")).filter("rate > 0.8").select(
        "field", F.lit("checksum").alias("strategy"), F.lit("PAN").alias("type"), F.lit(2.0).alias("score"),
        F.lit(300).alias("ord"))
    enum = facts.filter("card between 2 and 20 and card / total < 0.3").select(
        "field", F.lit("statistics").alias("strategy"), F.lit("ENUM").alias("type"), F.lit(1.5).alias("score"),
        F.lit(400).alias("ord"))
    return candidates.unionByName(luhn).unionByName(enum)


def winners(votes: DataFrame) -> DataFrame:
    """Best type per field, confidence = best / total; the earlier vote wins a tie."""
    per_type = votes.groupBy("field", "type").agg(F.expr("round(sum(score), 9) as score"), F.min("ord").alias("ord"))
    return per_type.groupBy("field").agg(
        F.expr("max_by(type, struct(score, -ord)) as type"),
        F.expr("round(least(max(score) / sum(score), 1D), 6) as confidence"))


def json_ladder(counts: DataFrame) -> DataFrame:
    """All-match type ladder: integer, decimal, ISO date, boolean, enum, string."""
    return counts.groupBy("field").agg(F.expr("""case
        when bool_and(value rlike '^-?[0-9]+$') then 'NUMERIC'
        when bool_and(value rlike '^-?[0-9]+([.][0-9]+)?$') then 'AMOUNT'
        when bool_and(value rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then 'DATE'
        when bool_and(lower(value) in ('true', 'false', '0', '1', 'yes', 'no')) then 'BOOLEAN'
        when count(1) <= 10 or (count(1) / sum(n) < 0.4 and count(1) <= 20) then 'ENUM'
        else 'STRING' end as type"""))


def strict_ladder(counts: DataFrame) -> DataFrame:
    """Strict ladder of the boundary learner with the derived field name; ``field_no`` is the field's 0-based order."""
    kinds = counts.groupBy("field").agg(F.expr("""case
        when count(1) = 1 then 'FIXED'
        when bool_and(value rlike '^[0-9]{8}$') then
          if(bool_and(try_cast(substring(value, 1, 4) as int) between 1900 and 2100), 'DATE_YYYYMMDD', 'NUMERIC')
        when bool_and(value rlike '^[0-9]{6}$') then 'DATE_YYMMDD'
        when bool_and(value rlike '^[0-9]{4,6}$') and bool_and(coalesce(try_cast(substring(value, 1, 2) as int) < 24, false))
          then 'TIME'
        when bool_and(value rlike '^[0-9]+$') then
          if(min(length(value)) = max(length(value)) and min(length(value)) > 4, 'AMOUNT', 'NUMERIC')
        else 'ALPHANUMERIC' end as type"""), F.expr("length(min_by(value, first_pos)) as first_len"))
    return kinds


def learned_name(number: str, kind: str, first_len: str) -> str:
    """Field name from the 0-based field number, its type and the length of its first value (SQL text)."""
    return f"""concat(case when {kind} = 'FIXED' then 'Type_Code_' when {kind} = 'AMOUNT' then 'Amount_'
        when {kind} like 'DATE%' then 'Date_' when {kind} = 'TIME' then 'Time_'
        when {kind} = 'NUMERIC' and {first_len} in (9, 10) then 'Routing_' when {kind} = 'NUMERIC' and {first_len} >= 13 then 'Account_'
        when {kind} = 'ALPHANUMERIC' and {first_len} between 15 and 30 then 'Name_' else 'Field_' end,
        lpad(cast({number} + 1 as string), 3, '0'))"""


def allowed_values(counts: DataFrame, most: int = 25) -> DataFrame:
    """Sorted value set of every field with few values; the cardinality is checked before anything is collected."""
    small = counts.groupBy("field").agg(F.count(F.lit(1)).alias("card")).filter(F.col("card") <= most)
    return counts.join(small, "field").groupBy("field").agg(
        F.array_join(F.sort_array(F.collect_set("value")), ",").alias("allowed"))


def most_common(counts: DataFrame) -> DataFrame:
    """Most frequent value; ties go to the value seen first."""
    return counts.groupBy("field").agg(F.expr("max_by(value, struct(n, -first_pos)) as value"), F.max("n").alias("n"))


def date_formats(counts: DataFrame) -> DataFrame:
    """First date shape that every value of a field starts with."""
    arms = " ".join(f"when bool_and(value rlike {q(p)}) then {q(name)}" for p, name in DATE_SHAPES)
    return counts.groupBy("field").agg(F.expr(f"case {arms} end as format_string")).filter("format_string is not null")


def first_samples(long: DataFrame, k: int = SAMPLES) -> DataFrame:
    """First k non-empty values per field, in order."""
    order = Window.partitionBy("field").orderBy("pos")
    few = long.filter("value <> ''").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return few.groupBy("field").agg(F.expr("array_join(transform(sort_array(collect_list(struct(rank, value))), x -> x.value), '|')")
                                    .alias("samples"))


def justification(kind: str) -> tuple[str, str]:
    """(justify, pad) SQL text by type."""
    right = f"{kind} in ('NUMERIC', 'AMOUNT', 'SEQUENCE')"
    return f"if({right}, 'right', 'left')", f"if({right}, '0', ' ')"


def learn(long: DataFrame, threshold: float = CONFIDENCE_THRESHOLD, most: int = MOST_VALUES, in_place: bool | None = None) -> DataFrame:
    """Learned spec: one row per field with type, confidence, lengths, range, allowed values, format, default, samples.

    Six aggregations read the weighted values, which are written once; each ends in one row per field and task."""
    counts = written(weighted(long, most, in_place=in_place), "weighted-values")
    typed = winners(field_votes(counts)).withColumn(
        "type", F.expr(f"if(type <> 'STRING' and confidence < {threshold}, 'STRING', type)"))
    justify, pad = justification("type")
    # defaults belong to enumerations, which have few values
    few = counts.filter("once")
    parts = [profile(counts), allowed_values(few), most_common(few).selectExpr("field", "value as common"),
             date_formats(counts), first_samples(long)]
    out = typed
    for p in parts:
        out = out.join(p, "field", "left")
    return out.select(
        "field", "type", "confidence", "min_len", "max_len", "non_empty", "distinct_values",
        F.expr("if(type in ('NUMERIC', 'AMOUNT'), min_value, null) as min_value"),
        F.expr("if(type in ('NUMERIC', 'AMOUNT'), max_value, null) as max_value"),
        F.expr("if(type = 'ENUM', allowed, null) as allowed"), F.expr("if(type = 'ENUM', common, null) as default_value"),
        F.expr("case type when 'PAN' then 'luhn' when 'ROUTING_NUMBER' then 'aba' end as checksum"),
        F.expr("if(type in ('DATE', 'DATETIME'), format_string, null) as format_string"),
        F.expr(f"{justify} as justify"), F.expr(f"{pad} as pad"), "samples")


def enrich_spec(base: DataFrame, learned: DataFrame) -> DataFrame:
    """Fill gaps of spec fields by name from sample statistics; what the base declares wins."""
    sample = learned.select("field", F.col("format_string").alias("s_format"), F.col("default_value").alias("s_default"),
                            F.col("min_value").alias("s_min"), F.col("max_value").alias("s_max"), "samples")
    return base.join(sample, "field", "left").withColumns({
        "format_string": F.coalesce("format_string", "s_format"), "default_value": F.coalesce("default_value", "s_default"),
        "min_value": F.coalesce("constraints.min_value", "s_min"), "max_value": F.coalesce("constraints.max_value", "s_max")}) \
        .drop("s_format", "s_default", "s_min", "s_max")


def merge_specs(base: DataFrame, other: DataFrame) -> DataFrame:
    """Base record types win; the other spec adds the rest."""
    return base.unionByName(other.join(base.select("record_type").distinct(), "record_type", "left_anti"))


# ------------------------------------------------------------------------------------------ files as a whole
def detect_delimiter(lines: DataFrame, sample_lines: int | None = None) -> DataFrame:
    """Per file: the first candidate with the same non-zero count on every line; else comma when its count hardly
    varies; else fixed width when lengths agree within two; else comma."""
    rows = lines if sample_lines is None else lines.filter(F.col("line_no") <= sample_lines)
    counts = [F.expr(f"length(line) - length(replace(line, {q(d)}, '')) as c{i}") for i, d in enumerate(DELIMITERS)]
    comma = DELIMITERS.index(",")
    sums = [F.expr(f"min(c{i}) as lo{i}") for i in range(len(DELIMITERS))] + \
        [F.expr(f"max(c{i}) as hi{i}") for i in range(len(DELIMITERS))]
    agg = rows.select("file_id", "line_no", F.length("line").alias("len"), *counts).groupBy("file_id").agg(
        *sums, F.expr(f"min_by(c{comma}, line_no) as first_comma"), F.expr("min(len) as lo_len"), F.expr("max(len) as hi_len"),
        F.expr(f"""if(count(1) > 1, sqrt(greatest(0D, (sum(cast(c{comma} as double) * c{comma}) - sum(cast(c{comma} as double))
            * sum(cast(c{comma} as double)) / count(1)) / (count(1) - 1))), null) as comma_stdev"""))
    arms = " ".join(f"when lo{i} = hi{i} and lo{i} > 0 then {q(d)}" for i, d in enumerate(DELIMITERS))
    return agg.select("file_id", F.expr(
        f"case {arms} when comma_stdev < 2 and first_comma > 0 then ',' when hi_len - lo_len <= 2 then '' else ',' end as delimiter"),
        F.expr(f"""case {' '.join(f"when lo{i} = hi{i} and lo{i} > 0 then false" for i in range(len(DELIMITERS)))}
            when comma_stdev < 2 and first_comma > 0 then false else hi_len - lo_len <= 2 end as fixed_width"""))


def header_trailer(lines: DataFrame) -> DataFrame:
    """Per file: median line length, and whether the first / last line deviates by more than 25 % / 30 %. Lines are counted by
    length first, so that the median's lists hold a file's distinct lengths and its sort no lines."""
    lengths = lines.select("file_id", "line_no", F.expr("length(line) as len")).groupBy("file_id", "len").agg(
        F.min("line_no").alias("first_no"), F.max("line_no").alias("last_no"), F.count(F.lit(1)).alias("n"))
    return lengths.groupBy("file_id").agg(
        F.expr("percentile(len, 0.5, n) as median_len"), F.expr("min_by(len, first_no) as first_len"),
        F.expr("max_by(len, last_no) as last_len"), F.sum("n").alias("lines")).select(
        "file_id", "median_len", "first_len", "last_len",
        F.expr("abs(first_len - median_len) / (median_len + 1) > 0.25 as has_header"),
        F.expr("lines > 2 and abs(last_len - median_len) / (median_len + 1) > 0.3 as has_trailer"))


def format_guess(lines: DataFrame) -> DataFrame:
    """ACH when the first line is 94 wide and starts with 1, else fixed width."""
    return lines.groupBy("file_id").agg(F.expr("min_by(line, line_no) as first")).select(
        "file_id", F.expr("if(length(first) = 94 and first like '1%', 'ACH', 'FIXED_WIDTH') as format"))


def space_frequency(lines: DataFrame) -> DataFrame:
    """Share of blanks per 0-based character position; short lines count as padded with blanks. Only the positions
    that are not blank are exploded."""
    chars = lines.select("file_id", F.expr("posexplode(split(line, '')) as (pos, ch)")).filter("ch <> ' '")
    filled = chars.groupBy("file_id", "pos").agg(F.count(F.lit(1)).alias("filled"))
    totals = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"), F.expr("max(length(line)) as width"))
    grid = totals.select("file_id", "lines", "width", F.expr("explode(sequence(0, width - 1)) as pos"))
    return grid.join(filled, ["file_id", "pos"], "left").select(
        "file_id", "pos", "width", F.expr("round((lines - coalesce(filled, 0)) / lines, 6) as space_freq"))


def column_ranges(freq: DataFrame, threshold: float = 0.8, compat: bool = False) -> DataFrame:
    """Column ranges [start, end) from blank positions. Default: the stretches between runs of blank positions.
    ``compat``: a run yields a boundary at every second position, ranges of width one are dropped.
    The input has one row per file and position, so its windows are bounded by the line width."""
    order = Window.partitionBy("file_id").orderBy("pos")
    flagged = freq.withColumn("blank", F.col("space_freq") > threshold)
    run = F.col("pos") - F.row_number().over(Window.partitionBy("file_id", "blank").orderBy("pos"))
    runs = flagged.withColumn("run", run)
    if not compat:
        return runs.filter(~F.col("blank")).groupBy("file_id", "run").agg(
            F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("run")
    inside = F.row_number().over(Window.partitionBy("file_id", "blank", "run").orderBy("pos"))
    cuts = runs.withColumn("nth", inside).filter(F.col("blank") & (F.col("nth") % 2 == 1)).select("file_id", "pos")
    ends = freq.groupBy("file_id").agg(F.max("width").alias("width")).select(
        "file_id", F.expr("explode(array(0, width)) as pos"))
    bounds = cuts.unionByName(ends).withColumn("end", F.lead("pos").over(order))
    return bounds.filter(F.col("end") - F.col("pos") > 1).select("file_id", F.col("pos").alias("start"), "end")


def transitions(lines: DataFrame, keys: list[str], width: str) -> DataFrame:
    """Character-class change score per position and group; ``width`` is SQL text for the group's line length."""
    shaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"\p{L}", "a"), "[0-9]", "d"), "[^ad ]", "s")
    rows = lines.filter(F.expr(f"length(line) >= {width}")).select(*keys, F.expr(f"{width} as width"), shaped.alias("c"))
    pairs = rows.select(*keys, F.expr("""posexplode(zip_with(slice(split(c, ''), 1, width - 1), slice(split(c, ''), 2, width - 1),
        (p, x) -> if(if(p = ' ', 's', p) <> if(x = ' ', 's', x), 2, 0) + if(x = ' ' and p <> ' ', 1, 0))) as (p0, twice)"""))
    return pairs.filter("twice > 0").groupBy(*keys, F.expr("p0 + 1 as pos")).agg(F.expr("sum(twice) / 2.0D as score"))


def learned_boundaries(lines: DataFrame, keys: list[str], width: str, share: float = 0.3) -> DataFrame:
    """Field boundaries of each group: 0, positions scoring at least 30 % of the group's lines, the line length."""
    scores = transitions(lines, keys, width)
    totals = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.expr(f"max({width}) as width"))
    inner = scores.join(totals, keys).filter(F.col("score") >= F.col("lines") * share).select(*keys, "pos")
    outer = totals.select(*keys, F.expr("explode(array(0, width)) as pos"))
    bounds = inner.unionByName(outer).distinct()
    order = Window.partitionBy(*keys).orderBy("pos")
    ranged = bounds.withColumns({"end": F.lead("pos").over(order), "field_no": F.row_number().over(order) - 1})
    return ranged.filter("end is not null").select(*keys, "field_no", F.col("pos").alias("start"), "end")
