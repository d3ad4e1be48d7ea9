from pyspark.sql import functions as F

from tallyframe.functions import checks, fixed, seeded, text as tx


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(F.expr(expr)).first()[0]


def test_luhn(spark):
    for good in ("4111111111111111", "4242424242424242", "4000000000000002", "4111-1111-1111-1111"):
        assert one(spark, checks.luhn_ok("v"), good) is True
    for bad in ("4000000000000003", "123", "", None):
        assert one(spark, checks.luhn_ok("v"), bad) is False


def test_luhn_beyond_twenty_digits(spark):
    def plain(s):
        total = 0
        for i, ch in enumerate(reversed(s)):
            d = int(ch)
            if i % 2:
                d = d * 2 - (9 if d > 4 else 0)
            total += d
        return total % 10 == 0
    for s in ("79927398713" * 3, "1234567890" * 4, "9" * 23, "8" * 22, "1" * 21):
        assert one(spark, checks.luhn_ok("v"), s) is plain(s)


def test_luhn_digit_completes(spark):
    rows = spark.range(200).selectExpr("lpad(cast(id * 7919 as string), 15, '4') as p")
    full = rows.selectExpr(f"concat(p, cast({checks.luhn_check_digit('p')} as string)) as v")
    assert full.filter(f"not {checks.luhn_ok('v')}").count() == 0


def test_aba(spark):
    for good in ("021000021", "021000089", "021200339", "021202337"):
        assert one(spark, checks.aba_ok("v"), good) is True
        assert one(spark, f"cast({checks.aba_check_digit('substring(v, 1, 8)')} as string)", good) == good[8]
    for bad in ("123456789", "02100002", "02100002X", None):
        assert one(spark, checks.aba_ok("v"), bad) is False


def test_dates(spark):
    cases = [("260419", "YYMMDD", True), ("999999", "YYMMDD", False), ("0229", "MMDD", False), ("01-JAN-2026", "DD-MON-YYYY", True),
             ("31-FEB-2026", "DD-MON-YYYY", False), ("20240115", "YYYYMMDD", True), ("20241315", "YYYYMMDD", False), ("26041", "YYMMDD", False)]
    for value, fmt, ok in cases:
        assert one(spark, checks.date_ok("v", fmt), value) is ok, (value, fmt)


def test_numbers(spark):
    assert one(spark, checks.to_number("v"), "$1,234.50") == 1234.5
    assert one(spark, checks.to_number("v"), "NOTANUMBER") is None
    assert one(spark, checks.swift_amount_to_cents("v"), "25000,00") == 2500000
    assert one(spark, checks.swift_amount_to_cents("v"), "25000.00") is None
    assert one(spark, checks.cents_to_swift_amount("cast(v as bigint)"), "2500005") == "25000,05"


def test_fixed_slices(spark):
    assert one(spark, fixed.slice_field("v", 2, 3), "abcd") == "bc"
    assert one(spark, fixed.slice_field("v", 3, 5), "abcd") == ""
    assert one(spark, fixed.fit("v", 3), "abcd") == "abc"
    assert one(spark, fixed.fit("v", 6, "right", "0"), "42") == "000042"
    assert one(spark, fixed.split_field("v", "|", 3), "a|b") == ""


def test_names(spark):
    df = spark.createDataFrame([("  Card-Number / ID ",), ("!!!",)], "v string")
    assert [r[0] for r in df.select(fixed.snake_name(F.col("v"))).collect()] == ["card_number_id", "unknown_field"]
    df = spark.createDataFrame([("jdbc:x://scott:tiger@db/x",)], "v string")
    assert df.select(fixed.mask_password(F.col("v"))).first()[0] == "jdbc:x://scott:****@db/x"


def test_seeded_values_are_pure(spark):
    rows = spark.range(50).selectExpr("id", f"{seeded.u32(1, 'id', 'f')} as a", f"{seeded.alnum(1, 'id', 'f', 40)} as b")
    again = rows.repartition(7)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    assert all(len(r["b"]) == 40 for r in rows.collect())


def test_text_cleaning(spark):
    raw = "caf\u0065\u0301 \u201cquoted\u201d \u2013 \u2014\ttab\x07\u200b  end \n\n next "
    df = spark.createDataFrame([(raw,)], "t string")
    got = df.select(tx.clean(F.col("t")).alias("t")).first()["t"]
    assert got == 'caf\u00e9 "quoted" - -- tab end \n\n next'
    assert df.select(tx.squeeze_blank(F.lit("a \n\n\n b"), preserve_newlines=False)).first()[0] == "a \n b"


def test_ngrams(spark):
    df = spark.createDataFrame([("abcd", ["a", "b", "c"]), ("a", ["a"]), ("", [])], "t string, w array<string>")
    got = df.select(tx.char_ngrams(F.col("t"), 3), tx.word_ngrams(F.col("w"), 2)).collect()
    assert [tuple(r) for r in got] == [(["abc", "bcd"], ["a b", "b c"]), ([], []), ([], [])]


def test_characters_split_without_a_lambda(spark):
    df = spark.createDataFrame([("a😀é\n ",), ("",), (None,)], "t string").select(tx.characters(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == [["a", "😀", "é", "\n", " "], [], None]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_character_windows_take_one_pass(spark):
    """No lambda per character; characters beyond the basic plane, line ends and combining marks count as what they are."""
    texts = ["", "a", "ab", "abc", "a😀b😀😀c", "\n\r\n x\t y\u0085", "éx", "𐀀z￿", "👨‍👩zz", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 4):
        got = rows.select("t", tx.char_ngrams(F.col("t"), n).alias("g"))
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert {r["t"]: r["g"] for r in got.collect()} == {t: None if t is None else [t[i:i + n] for i in range(len(t) - n + 1)] for t in texts}
