"""Things that used to be cut or capped, and values that used to be uneven."""

import collections
import re

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.functions import seeded
from tallyframe.operators import generate, identify, profile, sinks, validate
from tallyframe.plans import catalog
from tallyframe.session import TASKS_PER_CORE
from tallyframe.sources import files
from tallyframe.sources.layouts import ACH, Field, Record, Spec


def test_symbols_are_even(spark):
    """Chi square over 40,000 symbols; the bound is six deviations above its mean."""
    for draw, alphabet in ((seeded.digits, "0123456789"), (seeded.alnum, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), (seeded.letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        rows = spark.range(800).select(F.expr(draw(5, "id", "x", 50)).alias("v")).collect()
        assert all(len(r["v"]) == 50 for r in rows)
        seen = collections.Counter("".join(r["v"] for r in rows))
        assert set(seen) == set(alphabet)
        mean, free = 40_000 / len(alphabet), len(alphabet) - 1
        assert sum((n - mean) ** 2 / mean for n in seen.values()) < free + 6 * (2 * free) ** 0.5


def test_amounts_of_any_width(spark):
    rows = spark.range(300).select(F.expr(generate.amount(1, "id", "a", 12, 10**11, 10**12 - 1)).alias("a"), F.expr(generate.numeric(1, "id", "n", 15, 1, 10**15 - 1)).alias("n")).collect()
    assert min(int(r["a"]) for r in rows) >= 10**11 and max(int(r["n"]) for r in rows) > 10**14
    assert len({r["a"] for r in rows}) == 300 and all(len(r["a"]) == 12 and len(r["n"]) == 15 for r in rows)


def test_values_in_findings_are_whole(spark):
    spec = Spec("s", "delimited", "", (Record("D", "D", "detail", 1),), (Field("D", "a", "numeric", length=5, pos=1), Field("D", "b", length=200, pos=2)), "|")
    lines = spark.createDataFrame([("f", i, "x" * 120 + "|ok") for i in range(1, 400)] + [("g", 1, "1|ok")], "file_id string, line_no long, line string")
    got = validate.all_findings(validate.checked(lines, spec)).collect()
    assert {len(r["value"]) for r in got if r["file_id"] == "f"} == {120}
    assert collections.Counter(r["code"] for r in got) == {"LENGTH": 399, "TYPE": 399, None: 1}
    assert {(r["file_id"], r["total_records"], r["failed"], r["records_with_errors"], r["is_valid"]) for r in got} == {("f", 399, 798, 399, False), ("g", 1, 0, 0, True)}


def test_report_from_findings_equals_the_report(spark):
    lines = spark.createDataFrame([("f", 1, "101"), ("f", 2, "z" * 94), ("f", 3, "6" + "2" * 93), ("h", 1, "9" * 94), ("f", 4, "")], "file_id string, line_no long, line string")
    result = validate.checked(lines, ACH)
    assert sorted(map(str, validate.report(result).collect())) == sorted(map(str, validate.reported(validate.findings_once(result)).collect()))


def test_long_tag_names(spark):
    tag = "A_VERY_LONG_TAG_NAME_OF_MORE_THAN_THIRTY_LETTERS"
    got = files.tagged_pairs(spark.createDataFrame([(1, f"{tag}=v|B=x")], "id int, line string"), "id").collect()
    assert [(r["tag"], r["value"]) for r in got] == [(tag, "v")]


def test_trace_numbers_do_not_wrap(spark):
    trace = lambda n: spark.range(n, n + 1).select(F.expr(generate.trace_number("'02100002'", "id")).alias("t")).first()["t"]
    assert trace(9_999_999) == "021000029999999"
    with pytest.raises(PySparkException):
        trace(10_000_000)


def test_payer_is_not_the_payee(spark):
    got = spark.range(2_000).selectExpr(f"{generate.person(3, 'id', 'p')} as a", f"{generate.other_person(3, 'id', 'q', 'p')} as b").collect()
    assert all(r["a"].split(" ")[0] != r["b"].split(" ")[0] for r in got)


def test_every_file_is_ranked(spark):
    texts = spark.createDataFrame([("known", "entry addenda count"), ("known", "batch_count amount"), ("strange", "zzz qqq")], "k string, t string")
    got = identify.identify(texts, "k", "t").collect()
    assert {(r["k"], r["rank"]) for r in got} == {(k, n) for k in ("known", "strange") for n in (1, 2, 3)}
    assert {r["score"] for r in got if r["k"] == "strange"} == {0.0}


def test_heads_read_a_bounded_part(spark, tmp_path):
    line = "a|b|c é"
    for name, n in (("long", 5_000), ("short", 3), ("one", 0)):
        (tmp_path / f"{name}.txt").write_text("\n".join([line] * n) if n else "x" * 500)
    (tmp_path / "empty.txt").write_text("")  # has no beginning and no row
    heads = files.read_heads(spark, str(tmp_path), 100)
    got = {r["path"].rpartition("/")[2]: (r["length"], bytes(r["head"])) for r in heads.collect()}
    assert got == {p.name: (p.stat().st_size, p.read_bytes()[:100]) for p in tmp_path.glob("*.txt") if p.stat().st_size}
    lines = collections.Counter((r["file_id"].rpartition("/")[2], r["line"]) for r in files.head_lines(heads).collect())
    assert lines == {("long.txt", line): 100 // len((line + "\n").encode()), ("short.txt", line): 3, ("one.txt", "x" * 100): 1}
    assert profile.detect_delimiter(files.head_lines(heads, 5)).filter("file_id like '%long.txt'").first()["delimiter"] == "|"


def test_texts_go_to_python_in_small_batches(spark):
    """Whatever the rows' width, a task holds little more than BATCH_BYTES of them at once; a caller's own bound stays."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    wide = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 500_000).alias("one"), F.repeat(F.lit("y"), 500_000).alias("two"))
    found = session.written(wide.mapInArrow(sizes, "bytes long"), "batches", small=True).agg(F.max("bytes"), F.sum("bytes")).first()
    assert found[0] < 2 * session.BATCH_BYTES and found[1] >= 60_000_000
    assert session.BATCH_SETTING not in spark.conf.getAll
    spark.conf.set(session.BATCH_SETTING, "32m")
    try:
        assert session.written(wide.mapInArrow(sizes, "bytes long"), "batches", small=True).agg(F.max("bytes")).first()[0] > 30_000_000
        assert spark.conf.get(session.BATCH_SETTING) == "32m"
    finally:
        spark.conf.unset(session.BATCH_SETTING)


def test_texts_are_written_as_files_without_a_folder_each(spark, tmp_path):
    rows = [(i, f"text {i}\nof two lines" if i % 7 else None) for i in range(300)] + [(5, "again"), (301, ""), (302, "ö😀\r\n")]
    texts = spark.createDataFrame(rows, "id long, body string")
    assert sinks.write_texts(texts, "id", "body", str(tmp_path / "out")) == 302
    want = collections.defaultdict(list)
    for key, body in rows:
        want[key].append(body or "")
    back = {int(re.search(r"id=(\d+)", r["path"]).group(1)): r["text"] for r in files.read_texts(spark, str(tmp_path / "out")).collect()}
    assert back.keys() == want.keys()
    assert all(sorted(back[k]) == sorted("".join(v + "\n" for v in want[k])) and back[k].endswith("\n") for k in want)
    folders = [p for p in (tmp_path / "out").rglob("*") if p.is_dir()]
    assert 0 < len(folders) <= TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    # beginnings are read by a few tasks, not by one for every 32 files
    heads = files.read_heads(spark, str(tmp_path / "out"), 4)
    assert heads.rdd.getNumPartitions() <= TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert {r["length"] for r in heads.filter("path like '%id=302.txt'").collect()} == {len("ö😀\r\n".encode()) + 1} and heads.count() == 302
    # a store that pyarrow does not know is left to Spark, here as far as that there is no such store
    with pytest.raises(Exception, match="nowhere"):
        sinks.write_texts(texts, "id", "body", "nowhere://store/out")


def test_pages_are_written_as_files_without_a_folder_each(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(200)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path / "shared"))
    for name in ("s9_text_files", "t9_file_heads"):
        assert catalog.queries()[name](spark, str(tmp_path)).count() == 200
    for made in (tmp_path / "shared").glob("texts-*"):
        assert len(list(made.rglob("*.txt"))) == 200 and len([p for p in made.rglob("*") if p.is_dir()]) <= TASKS_PER_CORE * spark.sparkContext.defaultParallelism
