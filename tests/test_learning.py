import pytest
from pyspark.sql import functions as F

from tallyframe.operators import generate, identify, profile, specdoc, structure
from tallyframe.sources.layouts import ACH


def long(spark, columns):
    rows = [(f, v, i) for f, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "field string, value string, pos bigint")


def learned(spark, columns):
    return {r["field"]: r for r in profile.learn(long(spark, columns)).collect()}


def test_inference_literals(spark):
    got = learned(spark, {
        "card_number": ["4111111111111111", "4242424242424242", "4000000000000002", "4111111111111111", "4242424242424242"],
        "posted": ["20240115", "20240116", "20240117", "20240118"],
        "order_date": ["2024-01-15", "2024-01-16", "2024-02-17"],
        "state": ["ACTIVE", "CLOSED"] * 10,
        "routing_number": ["021000021", "021000089", "021200339", "021202337"],
        "amount": ["10.00", "200.50", "3.99"]})
    assert got["card_number"]["type"] == "PAN" and got["card_number"]["checksum"] == "luhn"
    assert got["posted"]["type"] == "DATE" and got["posted"]["format_string"] == "YYYYMMDD"
    assert got["order_date"]["type"] == "DATE" and got["order_date"]["format_string"] == "YYYY-MM-DD"
    assert got["state"]["type"] == "ENUM" and got["state"]["allowed"] == "ACTIVE,CLOSED" and got["state"]["default_value"] == "ACTIVE"
    assert got["routing_number"]["type"] == "ROUTING_NUMBER" and got["routing_number"]["checksum"] == "aba"
    assert got["amount"]["type"] == "AMOUNT" and (got["amount"]["min_value"], got["amount"]["max_value"]) == (3.99, 200.5)
    assert got["amount"]["samples"] == "10.00|200.50|3.99" and got["amount"]["justify"] == "right"


def test_near_unique_fields_skip_counting(spark):
    columns = {"trace": [f"{i * 7919 % 3000:015d}" for i in range(2900)] + ["000000000000001"] * 5, "amount": [f"{i}.50" for i in range(900)] * 2,
               "state": ["ACTIVE", "CLOSED", "HELD"] * 500, "note": [f"né {i}, {'x' * (i % 9)}" for i in range(400)] + ["", " "], "one": ["0001"], "none": ["", None]}
    rows = long(spark, columns).repartition(5)
    weighted = profile.weighted(rows, most=200)
    kinds = {r["field"]: r["once"] for r in weighted.select("field", "once").distinct().collect()}
    assert kinds == {"trace": False, "amount": False, "note": False, "state": True, "one": True}
    counts = profile.value_counts(rows)
    for view in (profile.profile, profile.json_ladder, profile.strict_ladder, profile.date_formats, profile.pattern_rates, profile.allowed_values,
                 lambda c: profile.winners(profile.field_votes(c)), lambda c: profile.winners(profile.sample_votes(c))):
        assert sorted(map(str, view(weighted).collect())) == sorted(map(str, view(counts).collect()))
    assert sorted(map(str, profile.learn(rows, most=200).collect())) == sorted(map(str, profile.learn(rows, in_place=False).collect()))
    distinct = {r["field"]: r["distinct_values"] for r in profile.profile(weighted).collect()}
    assert distinct == {f: len({v for v in vs if v}) for f, vs in columns.items() if any(vs)}
    with pytest.raises(ValueError):
        profile.weighted(rows, most=10)


def test_json_ladder(spark):
    counts = profile.value_counts(long(spark, {
        "id": ["1", "2", "3"], "amount": ["1.5", "2", "3.25"], "day": ["2024-01-01", "2024-01-02"], "flag": ["true", "no"],
        "status": ["OK", "BAD", "OK"], "text": [f"value {i}" for i in range(30)]}))
    assert {r["field"]: r["type"] for r in profile.json_ladder(counts).collect()} == {
        "id": "NUMERIC", "amount": "AMOUNT", "day": "DATE", "flag": "BOOLEAN", "status": "ENUM", "text": "STRING"}


def test_delimiters(spark):
    files = {"pipe": ["TXN_ID|AMOUNT|STATUS|DATE", "1|2|3|4", "5|6|7|8"], "csv": ["id,card,amount", "1,2,3", "4,5,6"],
             "loose": ["a,b", "c,d,e", "f,g"], "fixed": ["abc  12", "abd  13", "abe  14"], "none": ["x", "yyyyyyyy", "z"]}
    df = spark.createDataFrame([(f, i, line) for f, ls in files.items() for i, line in enumerate(ls, 1)], "file_id string, line_no bigint, line string")
    got = {r["file_id"]: (r["delimiter"], r["fixed_width"]) for r in profile.detect_delimiter(df).collect()}
    assert got == {"pipe": ("|", False), "csv": (",", False), "loose": (",", False), "fixed": ("", True), "none": (",", False)}
    ranges = profile.column_ranges(profile.space_frequency(df.filter("file_id = 'fixed'"))).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in ranges] == [(0, 3), (5, 7)]


def seq(spark, types):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(types, 1)], "file_id string, line_no bigint, record_type string")


def test_structure_sequences(spark):
    s = seq(spark, list("1566689"))
    order = [r["record_type"] for r in structure.inferred_ordering(s).orderBy("position").collect()]
    assert order.index("1") < order.index("9") and set(order) == set("15689")
    assert [r["record_type"] for r in structure.frequencies(s).filter("repeating").collect()] == ["6"]
    s = seq(spark, list("156685689"))
    assert structure.batch_pattern(s, "5", "8").first()["pattern"] == "5,6,8"
    assert structure.out_of_order(s, list("15689"), "5").count() == 0
    assert [r["line_no"] for r in structure.out_of_order(s, list("15689")).collect()] == [6]
    assert structure.repeated_headers(s, ["1"]).count() == 0
    assert structure.start_types(s).first()["start_type"] == "1"


def test_identification_prefers_the_right_layout(spark):
    texts = spark.createDataFrame([(1, "total_debit_amount batch_number entry_hash addenda ach clearing"), (2, "nothing known here")], "id int, t string")
    got = identify.identify(texts, "id", "t").orderBy("id", "rank").collect()
    assert got[0]["spec"] == "ACH" and got[0]["score"] > 0
    assert [r["score"] for r in got if r["id"] == 2] == [0.0, 0.0, 0.0]


CODES = {"numeric": "N", "alphanumeric": "AN", "alpha": "A", "date": "DT", "amount": "N", "routing_number": "N", "account_number": "AN", "filler": "AN"}


def test_spec_document_gives_the_layout_positions(spark):
    rows, no = [], 0
    for rt in ACH.record_types:
        for f in ACH.of(rt):
            no += 1
            name = f.name.replace("_", " ").title()
            rows.append((f"ach-{rt}", no, f"{name:<34}{f.start}-{f.end}   {f.length}   {CODES[f.data_type]}   {'Required' if f.required else 'Optional'}"))
    lines = spark.createDataFrame(rows + [("ach-1", 900, "# comment"), ("ach-1", 901, "-----")], "spec string, line_no bigint, line string")
    got = {(r["spec"], r["name"]): r for r in specdoc.learn(lines).collect()}
    assert len(got) == len(ACH.fields)
    for f in ACH.fields:
        r = got[f"ach-{f.record_type}", f.name.upper()]
        assert (r["start"], r["end"], r["length"], r["required"]) == (f.start, f.end, f.length, f.required)


def test_spec_document_shapes(spark):
    lines = spark.createDataFrame([("s", 1, "ACCOUNT NAME: account of the payer, 17 characters"), ("s", 2, "TOTAL AMOUNT: amount"), ("s", 3, "TOTAL AMOUNT: again"),
                                   ("t", 1, "5 Customer Name 20 AN mandatory values: A,B|C"), ("t", 2, "30 Code 3 N optional range: 1 - 99 format: 999")],
                                  "spec string, line_no bigint, line string")
    got = {(r["spec"], r["name"]): r for r in specdoc.learn(lines).collect()}
    assert (got["s", "ACCOUNT_NAME"]["start"], got["s", "ACCOUNT_NAME"]["end"]) == (1, 17)
    assert (got["s", "TOTAL_AMOUNT"]["start"], got["s", "TOTAL_AMOUNT"]["end"], got["s", "TOTAL_AMOUNT"]["data_type"]) == (18, 29, "amount")
    name, code = got["t", "CUSTOMER_NAME"], got["t", "CODE"]
    assert (name["start"], name["end"], name["data_type"], name["required"], name["rules"]["allowed"]) == (5, 24, "alphanumeric", True, "A,B,C")
    assert (code["required"], code["rules"]["min_value"], code["rules"]["max_value"], code["rules"]["format"]) == (False, 1, 99, "999")


def test_learned_generation_keeps_the_layout(spark):
    lines = spark.createDataFrame([(i, f"7{i:03d}AB{20240100 + i % 28 + 1}XY", "7") for i in range(1, 40)], "line_no bigint, line string, rid string")
    width = 16
    got = generate.from_learned(spark.range(12), "id", lines, "7", width, 1, "2026-04-15").collect()
    assert len(got) == 12 and all(len(r["line"]) == width for r in got)
    assert all(r["line"][4:6] == "AB" and r["line"].endswith("XY") for r in got)


def test_table_driven_rendering_prefers_source_values(spark):
    from tallyframe.sources.layouts import TCR0
    drive = generate.rows(spark.range(4), TCR0, "TCR0", 1, "id", "2026-04-15", keep=("id",)).withColumn("i", F.col("id") + 1).drop("id")
    source = spark.createDataFrame([(10, "FIRST SHOP", ""), (20, "SECOND SHOP", "PARIS")], "k bigint, MERCHANT_NAME string, merchant_city string")
    got = generate.from_table(drive, "i", source, ["k"], TCR0, "TCR0").orderBy("i").collect()
    assert [r["merchant_name"] for r in got[:2]] == ["FIRST SHOP", "SECOND SHOP"] and got[1]["merchant_city"] == "PARIS"
    assert got[0]["merchant_city"].strip() and got[3]["merchant_name"].strip()


def test_header_and_trailer_by_lengths(spark):
    """Median over all lines, nulls left out; the first and last line by number, a null one without a length."""
    rows = [("a", n, "x" * 10) for n in range(2, 9)] + [("a", 1, "x" * 20), ("a", 9, "x"), ("a", 5, "yy"), ("b", 1, None), ("b", 2, "abc"), ("b", 3, "abcd"), ("c", 7, None)]
    got = {r["file_id"]: tuple(r)[1:] for r in profile.header_trailer(spark.createDataFrame(rows, "file_id string, line_no bigint, line string")).collect()}
    assert got == {"a": (10.0, 20, 1, True, True), "b": (3.5, None, 4, None, False), "c": (None, None, None, None, False)}
