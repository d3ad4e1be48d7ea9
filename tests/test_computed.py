"""Computed fields: order, cycles, totals, check digits, and the dependency table of spec documents."""

import pytest
from pyspark.errors import PySparkException

from tallyframe.operators import computed
from tallyframe.operators.computed import Formula
from tallyframe.sources.layouts import Field, Record, Spec


def spec(**widths):
    fields = [Field(k.split("__")[0], k.split("__")[1], "computed", length=w, justify="right", pad="0", pos=i) for i, (k, w) in enumerate(widths.items(), 1)]
    return Spec("s", "delimited", "", (Record("D", "D", "detail", 1), Record("T", "T", "trailer", 2)), tuple(fields), "|")


SPEC = spec(D__a=6, D__b=6, D__c=8, T__n=4, T__total=9, T__mean=9)
FORMULAS = [Formula("T", "mean", ("total", "n"), "row", "if(cast(n as bigint) = 0, 0, cast(total as bigint) div greatest(1, cast(n as bigint)))"), Formula("T", "total", ("D.c",), "total", "sum(cast(c as bigint))"),
            Formula("D", "c", ("a", "b"), "row", "cast(a as bigint) * cast(b as bigint)"), Formula("D", "b", ("a",), "row", "cast(a as bigint) + 1"), Formula("T", "n", ("D.a",), "total", "count(a)")]


def batch(spark):
    details = spark.createDataFrame([("x", "3", "", ""), ("x", "5", "", ""), ("y", "7", "", "")], "f string, a string, b string, c string")
    trailers = spark.createDataFrame([("x", "", "", ""), ("y", "", "", ""), ("empty", "", "", "")], "f string, n string, total string, mean string")
    return {"D": details, "T": trailers}


def test_values_follow_their_dependencies(spark):
    out = computed.filled(batch(spark), SPEC, FORMULAS, ["f"])
    assert {tuple(r) for r in out["D"].collect()} == {("x", "3", "000004", "00000012"), ("x", "5", "000006", "00000030"), ("y", "7", "000008", "00000056")}
    got = {r["f"]: (r["n"], r["total"], r["mean"]) for r in out["T"].collect()}
    assert got == {"x": ("0002", "000000042", "000000021"), "y": ("0001", "000000056", "000000056"), "empty": ("0000", "000000000", "000000000")}


def test_levels_respect_every_edge():
    order = [[(f.record_type, f.field) for f in level] for level in computed.levels(FORMULAS, {"D": "abc", "T": ["n", "total", "mean"]})]
    place = {node: i for i, level in enumerate(order) for node in level}
    assert all(place[n] < place[f.record_type, f.field] for f in FORMULAS for n in f.inputs() if n in place)


@pytest.mark.parametrize("formulas, words", [
    ([Formula("D", "a", ("b",), "row", "b"), Formula("D", "b", ("a",), "row", "a")], "depend on each other"),
    ([Formula("D", "a", ("a",), "row", "a")], "depend on each other"),
    ([Formula("D", "c", ("T.total",), "copy", "total"), Formula("T", "total", ("D.c",), "total", "sum(c)")], "depend on each other"),
    ([Formula("D", "z", ("a",), "row", "a")], "does not have"),
    ([Formula("D", "a", ("T.z",), "copy", "z")], "does not have"),
    ([Formula("D", "c", ("a",), "row", "a + b")], "without listing"),
    ([Formula("D", "c", ("a",), "guess", "a")], "unknown kind"),
    ([Formula("D", "c", ("a",), "row", "a"), Formula("D", "c", ("b",), "row", "b")], "two formulas"),
    ([Formula("T", "mean", ("n", "D.a"), "row", "n + a")], "several types"),
])
def test_faulty_tables_are_refused(formulas, words):
    with pytest.raises(ValueError, match=words):
        computed.levels(formulas, {"D": "abc", "T": ["n", "total", "mean"]})


def test_totals_that_do_not_fit_are_an_error(spark):
    narrow = spec(D__a=6, D__b=6, D__c=8, T__n=4, T__total=1, T__mean=9)
    with pytest.raises(PySparkException, match="does not fit"):
        computed.filled(batch(spark), narrow, FORMULAS[1:4], ["f"])["T"].collect()


def test_check_digits(spark):
    s = spec(D__a=15, D__b=1, D__c=2)
    rows = spark.createDataFrame([("x", "411111111111111", "", "")], "f string, a string, b string, c string")
    got = computed.filled({"D": rows}, s, [Formula("D", "b", ("a",), "luhn", ""), Formula("D", "c", ("a",), "mod97", "")], ["f"])["D"].first()
    assert got["b"] == "1" and int(got["a"] + got["c"]) % 97 == 1


def test_formulas_from_a_dependency_table(spark):
    rows = [("s", "D", "c", "a", "computed", None, "cast(a as bigint) * cast(b as bigint)"), ("s", "D", "c", "b", "computed", None, "cast(a as bigint) * cast(b as bigint)"), ("s", "T", "total", "D.c", "conditional", None, "coalesce(sum(cast(c as bigint)), 0)"),
            ("s", "D", "a", "b", "conditional", "b = ''", None), ("s", "T", "mean", "D.a", "conditional", None, "upper(a)"), ("s", "D", "b", "a", "luhn", None, "")]
    got = computed.formulas_of(spark.createDataFrame(rows, "spec_name string, record_type string, field string, depends_on string, kind string, condition string, formula string"))
    assert [(f.record_type, f.field, f.depends_on, f.kind) for f in got] == [("D", "b", ("a",), "luhn"), ("D", "c", ("a", "b"), "row"), ("T", "mean", ("D.a",), "copy"), ("T", "total", ("D.c",), "total")]
