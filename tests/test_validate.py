from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import checks
from tallyframe.operators import generate, synth, validate
from tallyframe.sources.layouts import ACH, CARD, GL, MT103, TCR0, Field, Record, Spec

MINI = Spec("MINI", "delimited", "", (Record("R", "row", "detail", 0, None, ","),), (
    Field("R", "num", "numeric", length=5, pos=1), Field("R", "code", "numeric", length=2, allowed=("22", "27"), pos=2),
    Field("R", "day", "date", length=6, fmt="YYMMDD", pos=3), Field("R", "aba", "routing_number", length=9, pos=4),
    Field("R", "amt", "amount", length=12, pos=5), Field("R", "note", "alpha", length=10, required=False, pos=6),
    Field("R", "pct", "numeric", length=3, required=False, min_value=0, max_value=100, pos=7)), ",")


def findings(spark, spec, lines, dialect="lenient"):
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines, 1)], "file_id string, line_no bigint, line string")
    return validate.checked(df, spec, dialect)


def codes(spark, spec, lines, dialect="lenient"):
    return {(r["line_no"], r["field"], r["code"]) for r in validate.errors(findings(spark, spec, lines, dialect)).collect()}


def test_lenient_literals(spark):
    assert codes(spark, MINI, ["12345,22,260419,021000021,1234.56,,"]) == set()
    assert codes(spark, MINI, ["12ABC,99,999999,123456789,NOTANUMBER,A1,101"]) == {
        (1, "num", "TYPE"), (1, "code", "ALLOWED"), (1, "day", "DATE"), (1, "aba", "ROUTING"), (1, "amt", "TYPE"), (1, "note", "TYPE"), (1, "pct", "RANGE")}
    assert codes(spark, MINI, ["123456789,22,260419,021000021,1"]) == {(1, "num", "LENGTH")}
    assert (1, "num", "REQUIRED") in codes(spark, MINI, [",22,260419,021000021,1"])


def test_report_counts(spark):
    row = validate.report(findings(spark, MINI, ["12345,22,260419,021000021,1234.56,,", "x,22,260419,021000021,1,,"])).first()
    # length and type of five required fields, one pass per empty optional field; one failed type check
    assert (row["total_records"], row["passed"], row["failed"], row["records_with_errors"], row["is_valid"]) == (2, 23, 1, 1, False)
    assert row["score"] == round(100 * 23 / 24, 2)


def clean_ach(spark, n=40):
    entries = spark.range(n).selectExpr(
        "concat('f', id % 2) as file_id", "cast(2020 + id % 2 as int) as file_no", "cast(id div 2 % 3 + 1 as int) as batch_no", "id as src_key",
        "if(id % 3 = 0, '22', '27') as transaction_code", "lpad(cast(id * 1234567 % 100000000 as string), 8, '0') as rdfi8",
        "lpad(cast(id as string), 12, '0') as account", "id * 100 + 5 as amount_cents", "cast(id as string) as individual_id",
        "concat('NAME ', id) as name", "if(id % 5 = 0, 1, 0) as has_addenda")
    from tallyframe.functions import checks
    return entries.withColumn("check_digit", F.expr(f"cast({checks.aba_check_digit('rdfi8')} as string)"))


def test_generated_ach_is_valid_and_mutations_are_found(spark):
    lines = synth.ach_files(clean_ach(spark)).select("file_id", "line_no", "record_type", "line").cache()
    rows = lines.collect()
    assert all(len(r["line"]) == 94 for r in rows)
    for f in ("f0", "f1"):
        own = sorted((r["line_no"], r["record_type"]) for r in rows if r["file_id"] == f)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and len(own) % 10 == 0
        assert own[0][1] == "1" and [t for _, t in own if t != "padding"][-1] == "9"
    assert validate.errors(validate.checked(lines.drop("record_type"), ACH)).count() == 0
    target = next(r for r in rows if r["record_type"] == "6")
    here = (F.col("file_id") == target["file_id"]) & (F.col("line_no") == target["line_no"])

    def mutated(new):
        return {(r["field"], r["code"]) for r in validate.errors(validate.checked(
            lines.drop("record_type").withColumn("line", F.when(here, F.lit(new)).otherwise(F.col("line"))), ACH)).collect()}

    line = target["line"]
    flipped = line[:11] + str((int(line[11]) + 1) % 10) + line[12:]
    assert mutated(flipped) == {("rdfi_routing_transit", "ROUTING")}
    assert mutated(line[:29] + "X" + line[30:]) == {("amount", "TYPE")}
    assert mutated("Z" + line[1:]) == {("RECORD_TYPE", "RECORD_TYPE")}
    assert mutated(line[:1] + "99" + line[3:]) == {("transaction_code", "ALLOWED")}
    assert mutated(line[:93]) == {("RECORD_LENGTH", "RECORD_LENGTH"), ("trace_number", "REQUIRED")}


def test_error_cap_keeps_crossing_line(spark):
    spec = replace(MINI, fields=(Field("R", "num", "numeric", length=2, pos=1),))
    found = validate.errors(findings(spark, spec, ["abc"] * 9 + ["1"]))  # two errors per line
    kept = validate.capped_field_errors(found)
    assert sorted(r["line_no"] for r in kept.collect()) == [1, 1, 2, 2, 3, 3]


def test_report_caps(spark):
    found = validate.errors(findings(spark, MINI, ["x,22,260419,021000021,1,,"] * 250))
    assert validate.capped_report(found).count() == 200


def test_strict_dialect(spark):
    spec = Spec("S", "delimited", "", (Record("R", "r", "detail", 0, None, "|"),), (
        Field("R", "pan", "pan", length=16, min_len=16, max_len=16, pattern=r"[0-9]{13,19}\s*", checksum="luhn", pos=1),
        Field("R", "amount", "amount", length=6, min_value=1, max_value=500, pos=2),
        Field("R", "odd", "string", pattern="[broken", required=False, pos=3)), "|")
    assert codes(spark, spec, ["4111111111111111|000100|x"], "strict") == set()
    assert codes(spark, spec, ["4000000000000003|000900|"], "strict") == {(1, "pan", "LUHN"), (1, "amount", "MAX_VALUE")}
    assert codes(spark, spec, ["4111|abc|"], "strict") == {(1, "pan", "MIN_LENGTH"), (1, "pan", "PATTERN"), (1, "pan", "LUHN"), (1, "amount", "NOT_NUMERIC")}


def test_journal_picks_its_record_definition(spark):
    header = "|".join(f.name.upper() for f in GL.of("HEADER"))
    journal = "N|1001|01-JAN-2026|USD|||A|Payables|Accrual|||Y|"
    line = "N|01-JAN-2026|7|1|2|3||||100.25||||text||||"
    line = "|".join(line.split("|")[:17])
    assert codes(spark, GL, [header, journal, line]) == set()


def test_conditional_requirement(spark):
    wide = spark.createDataFrame([("f", 1, "12", ""), ("f", 2, "", ""), ("f", 3, "12", "021000021")], "file_id string, line_no bigint, account string, routing string")
    got = validate.conditional_requirements(wide, {"routing": "account <> ''"}).collect()
    assert [(r["line_no"], r["field"]) for r in got] == [(1, "routing")]


def test_single_record_type_matches_every_line(spark):
    drive = spark.range(30)
    lines = generate.lines(generate.rows(drive, TCR0, "TCR0", 5, "id", "2026-04-15", keep=("id",)), TCR0, "TCR0", keep=("id",))
    df = lines.selectExpr("'f' as file_id", "id as line_no", "line")
    row = validate.report(validate.checked(df, TCR0)).first()
    assert row["total_records"] == 30 and row["failed"] == 0 and row["score"] == 100.0
    first = df.orderBy("line_no").first()["line"]
    assert {c for _, _, c in codes(spark, TCR0, ["9" + first[1:]])} == {"ALLOWED"}


def test_messages(spark):
    message = ("{1:F01BANKGB2LAXXX0000000000}\n{4:\n:20:TXN20260415001\n:23B:CRED\n:32A:260415USD25000,00\n:50K:/GB29NWBK\nJOHN DOE\n"
               ":57A:BOFAUS3NXXX\n:59:/US64BOFA\nJANE SMITH\n:70:/INV/2026-0415-001\nPAYMENT FOR SERVICES\n:71A:SHA\n-}")
    files = spark.createDataFrame([("f", f"{message}\n---\n{message.replace('SHA', 'XXX').replace('TXN', '/TXN')}\n")], "file string, text string")
    split = generate.split_messages(files, "file", "text").withColumn("id", F.col("message_no"))
    parsed = generate.parse_mt103(split, "id")
    first = parsed.orderBy("id").first()
    assert (first["tag_32a_value_date"], first["tag_32a_currency"], first["tag_32a_amount"]) == ("260415", "USD", "25000,00")
    assert first["tag_59_beneficiary_customer"] == "/US64BOFA\nJANE SMITH"
    spec = replace(MT103, delimiter="\x1f")
    found = validate.errors(validate.checked(generate.mt103_lines(parsed, "id", spec), spec)).collect()
    assert {(r["line_no"], r["field"], r["code"]) for r in found} == {
        (1, "tag_71a_details_of_charges", "ALLOWED"), (1, "tag_20_sender_reference", "SLASH")}


def test_generated_card_file_totals(spark):
    from tallyframe.operators import reconcile
    details = spark.range(25).selectExpr("'c1' as file_id", "id", "id * 10 as amount_cents")
    values = {f.name: generate.raw_value(f, 3, "id", "2026-04-15") for f in CARD.of("DETAIL") if f.data_type != "constant"}
    values["transaction_amount"] = "amount_cents"
    lines = synth.card_files(details, ["id"], values)
    assert lines.filter("length(line) <> 220").count() == 0
    assert reconcile.card_mismatches(lines).count() == 0
    broken = lines.withColumn("line", F.expr("if(record_type = 'DETAIL' and line_no = 3, overlay(line placing '9999999999' from 27 for 10), line)"))
    assert [r["field"] for r in reconcile.card_mismatches(broken).collect()] == ["total_amount"]


def test_rules_with_errors_count_as_broken(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x")], "id int, v string")
    got = validate.field_rules(df, {"v": lambda c: c.try_cast("int") > 1}).collect()
    assert [r["id"] for r in got] == [2]
    kept = validate.apply_transforms(df, {"v": (F.col("v").try_cast("int") * 2).cast("string")})
    assert [r["v"] for r in kept.orderBy("id").collect()] == ["10", "x"]


@pytest.mark.parametrize("spec,record,n,width", [(ACH, "6", 11, 94), (ACH, "1", 13, 94), (ACH, "8", 11, 94), (CARD, "DETAIL", 28, 220), (TCR0, "TCR0", 22, 143)])
def test_layouts_are_gapless(spec, record, n, width):
    fields = spec.of(record)
    assert len(fields) == n and fields[0].start == 1 and fields[-1].end == width
    assert all(a.end + 1 == b.start for a, b in zip(fields, fields[1:]))
    assert all(f.end - f.start + 1 == f.length for f in fields)


def test_checks_keep_one_row_a_line_without_a_join(spark):
    """The work between reading and findings grows with the lines, not with lines times the fields of the spec."""
    lines = ["12345,22,260419,021000021,1234.56,,", "12ABC,99,999999,123456789,NOTANUMBER,A1,101", ""]
    for dialect in ("lenient", "strict"):
        result = findings(spark, MINI, lines, dialect)
        assert "Join" not in result._jdf.queryExecution().optimizedPlan().toString()
        assert result.count() == len(lines)


def test_strict_report_counts_every_failing_check(spark):
    """Of ten checks of a value each failing one is missing from the passed ones, allowed values and patterns too."""
    spec = Spec("S", "fixed", "", (Record("R", "row", "detail", 0, 6, None),), (
        Field("R", "a", "enum", 1, 2, 2, allowed=("05", "06"), min_len=2, max_len=2, pos=1),
        Field("R", "b", "numeric", 3, 6, 4, min_len=4, max_len=4, pattern="[0-9]+", min_value=10, max_value=99, pos=2)), None)
    got = {n: validate.report(findings(spark, spec, [line], "strict")).first() for n, line in
           {"good": "050042", "allowed": "990042", "letters": "05AAAA", "high": "050500", "blank": "05    "}.items()}
    assert {n: (r["passed"], r["failed"], r["records_with_errors"]) for n, r in got.items()} == {
        "good": (9, 0, 0), "allowed": (8, 1, 1), "letters": (7, 2, 1), "high": (8, 1, 1), "blank": (3, 1, 1)}
    (row,) = validate.all_findings(findings(spark, spec, ["05AAA"], "strict")).filter("code = 'REQUIRED'").collect()
    assert (row["field"], row["value"], row["passed"]) == ("b", "", 3)


@pytest.mark.parametrize("spec, dialect", [(ACH, "lenient"), (GL, "lenient"), (CARD, "strict")])
def test_values_and_codes_are_generated_code(spark, spec, dialect):
    """Inside the generator that keeps the outcome from being repeated every check would be interpreted, and in the one method of a
    whole stage's code they would not be compiled either."""
    steps = findings(spark, spec, ["x"], dialect)._jdf.queryExecution().executedPlan().toString().splitlines()
    (outcome,) = [s for s in steps if "Generate inline" in s]
    assert "RLIKE" not in outcome and "substring" not in outcome
    cells, codes = ([s for s in steps if s.split("Project", 1)[0].strip("+-: ") == "" and f"AS {name}#" in s] for name in ("cells", "codes"))
    assert len(cells) == len(codes) == 1  # no star and number before them: no part of a whole stage


def test_values_are_cut_by_characters(spark):
    spec = Spec("S", "fixed", "", (Record("R", "row", "detail", 0, 8, None),), (
        Field("R", "a", "string", 1, 4, 4, allowed=("né  ",), min_len=4, max_len=4, pos=1), Field("R", "b", "numeric", 5, 8, 4, required=False, min_value=0, pos=2)), None)
    found = findings(spark, spec, ["né  0042", "ne  0042", "né  ééé4", "né      ", "né  -004", "né  004"], "strict")
    assert {(r["line_no"], r["field"], r["code"], r["value"]) for r in validate.errors(found).collect()} == {
        (2, "a", "ALLOWED", "ne  "), (3, "b", "NOT_NUMERIC", "ééé4"), (5, "b", "MIN_VALUE", "-004"), (6, "RECORD_LENGTH", "RECORD_LENGTH", "né  004")}
    assert {r["line_no"]: r["good"] for r in found.collect()} == {1: 5, 2: 4, 3: 4, 4: 4, 5: 4, 6: 4}


def test_card_numbers_of_any_form_pass_the_luhn_test(spark):
    def plain(value):
        digits = [int(c) for c in value or "" if c in "0123456789"][::-1]
        return len(digits) >= 13 and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0

    values = ["4111111111111111", "4111111111111112", "4111-1111-1111-1111", "0000000000000", "411111111111111", "4111 1111 1111 1111 110",
              "6304000000000000000", "", "x", None, *[str(7 ** k) for k in range(12, 40)], *[f"{7 ** k} " for k in range(12, 40)]]
    rows = spark.createDataFrame([(v,) for v in values], "v string").selectExpr("v", f"{checks.luhn_ok('v')} as ok")
    got = {r["v"]: r["ok"] for r in rows.collect()}
    assert got == {v: plain(v) for v in values} and set(got.values()) == {True, False}
