import json
import os

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import audit, reconcile, sinks, validate
from tallyframe.plans import shared
from tallyframe.sources import files
from tallyframe.sources.layouts import TCR0
from tallyframe.streaming import jobs


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [("" if i % 7 == 0 else f"line {i} é") for i in range(1, 3000)]
    (tmp_path / "a.txt").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "b.txt").write_bytes(b"one\n\n  \nbad \xff byte\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = files.read_lines(spark, str(tmp_path))
        rows = [(os.path.basename(r["file_id"]), r["line_no"], r["line"]) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [line for line in lines if line.strip()]
    assert sorted(r[1:] for r in rows if r[0] == "a.txt") == list(enumerate(want, 1))
    assert sorted(r[1:] for r in rows if r[0] == "b.txt") == [(1, "one"), (2, "bad � byte")]


def test_written_lines_come_back_in_order(spark, tmp_path):
    df = spark.range(2000).selectExpr("concat('f', id % 2) as file_id", "id div 2 + 1 as line_no", "concat('row ', id) as line").repartition(5, F.rand(1))
    path = str(tmp_path / "out")
    sinks.write_lines(df, path)
    back = files.read_lines(spark, path, files.partition_file_id())
    assert back.exceptAll(df.select("file_id", "line_no", "line")).count() == 0 and back.count() == 2000


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c'), ("2", "x"), (None, None)], "id string, t string")
    path = str(tmp_path / "csv")
    sinks.write_delimited(df, path, ";")
    assert sorted(tuple(r) for r in files.read_delimited(spark, path, ";").collect()) == [("1", 'a "b", c'), ("2", "x")]


def test_json_arrays_and_objects(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps([{"id": 1, "amount": 2.5, "status": "OK"}, {"id": 2, "amount": 3.0, "status": "BAD"}]))
    (tmp_path / "one.json").write_text(json.dumps({"id": 3, "amount": 1.0, "status": "OK"}))
    assert sorted(r["id"] for r in files.read_json_rows(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_spec_documents(spark, tmp_path):
    doc = {"spec_name": "Pay", "records": [{"record_type_id": "TXN", "ordering": 10, "fields": [
        {"name": "Card Number", "type": "PAN", "length": 16}, {"type": "enum", "enum": ["A", "B"], "required": False, "max_length": 4,
         "dependencies": [{"depends_on": "card_number", "condition": "card_number is not null"}]}]}, {"fields": [{"name": "x"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    fields = files.read_spec_documents(spark, str(tmp_path))
    got = {(r["record_type"], r["field"]): r for r in fields.collect()}
    assert got["TXN", "card_number"]["max_len"] == 16 and got["TXN", "card_number"]["required"]
    assert got["TXN", "field_1"]["allowed"] == ["A", "B"] and not got["TXN", "field_1"]["required"]
    assert got["REC1", "x"]["ordering"] == 10 and got["REC1", "x"]["field_type"] == "string"
    assert [r["depends_on"] for r in files.spec_dependencies(fields).collect()] == ["card_number"]


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "audit")
    events = spark.createDataFrame([("2026-01-01 10:00:00", "VALIDATE", "ACH", 90.0), ("2026-01-02 11:00:00", "TRAIN", "GL", None), ("2026-01-02 12:00:00", "VALIDATE", "GL", 80.0)],
                                   "ts string, action string, spec string, score double").withColumn("ts", F.to_timestamp("ts"))
    for _ in range(2):
        sinks.append_audit(events, path, "r1")
    sinks.append_audit(events.limit(1), path, "r2")
    log = files.read_audit(spark, path)
    assert log.count() == 4 and files.read_audit(spark, path, "TRAIN").count() == 1
    assert [r["action"] for r in audit.page(log, 2, tie="spec").collect()] == ["VALIDATE", "TRAIN"]
    assert audit.summary(log).first()["avg_valid_score"] == round((90 + 80 + 90) / 3, 2)
    assert sinks.clear_audit(spark, path) == 4 and files.read_audit(spark, path).count() == 0


def test_audit_skips_broken_lines(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"ts":"2026-01-01T00:00:00Z","action":"TRAIN"}\nnot json\n\n{"action":"DELETE","spec":"x"}\n')
    assert sorted(r["action"] for r in files.read_audit(spark, str(tmp_path)).collect()) == ["DELETE", "TRAIN"]


def test_training_log(spark, tmp_path):
    (tmp_path / "log.csv").write_text("iter,train_loss,val_loss,lr,elapsed_s\n0,3.0,3.1,0.001,1\n10,2.0,2.5,0.0009,2\n20,1.5,2.6,0.0008,3\n")
    row = audit.training_summary(files.read_training_log(spark, str(tmp_path)), []).first()
    assert (row["rows"], row["last_train"], row["last_val"], row["best_val"], row["last_lr"]) == (3, 1.5, 2.6, 2.5, 0.0008)


def test_audit_stream_equals_batch(spark, tmp_path):
    events = spark.range(500).selectExpr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7, 0) as ts", "if(id % 3 = 0, 'A', 'B') as action", "id as cents")
    src = str(tmp_path / "in")
    events.repartition(3, "cents").write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = jobs.audit_statistics(stream, delay="30 days")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, audit.hourly(events).collect()))


def test_stream_resumes_without_duplicates(spark, tmp_path):
    src, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    good = "05" + "1" * 141 + "  "
    for name, text in (("file_id=a", good), ("file_id=b", "zz" + good[2:])):
        os.makedirs(f"{src}/{name}")
        (tmp_path / "in" / name / "part-00000.txt").write_text(text + "\n")
    places = {"table": table, "checkpoint": state}
    first = jobs.validate_stream(spark, src, TCR0, **places)
    n = first.count()
    assert n > 0 and jobs.validate_stream(spark, src, TCR0, **places).count() == n
    batch = validate.errors(validate.checked(files.read_lines(spark, src, files.partition_file_id()), TCR0))
    assert sorted(map(str, first.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def arrivals(folder, parts, first=0):
    """Parts of files as ``file_id=f/part-n.txt``, with rising modification times."""
    for n, (name, text) in enumerate(parts, first):
        path = os.path.join(folder, f"file_id={name}")
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, f"part-{n:05d}.txt"), "w") as out:
            out.write("".join(line + "\n" for line in text))
        os.utime(os.path.join(path, f"part-{n:05d}.txt"), (1_700_000_000 + 10 * n,) * 2)


@pytest.fixture(scope="module")
def ach(spark):
    """Lines of the ACH files of the smallest tables, with their defects."""
    rows = shared.raw(spark, "/root/testdata/sf0.001").orderBy("file_id", "line_no").collect()
    out = {}
    for r in rows:
        out.setdefault(r["file_id"], []).append(r["line"])
    return out


def in_batch(spark, ach):
    lines = spark.createDataFrame([(f, i + 1, x) for f, held in ach.items() for i, x in enumerate(held)], "file_id string, line_no long, line string")
    records = reconcile.with_batch(lines)
    whole = reconcile.file_mismatches(records).withColumn("batch_id", F.lit(0).cast("bigint"))
    return sorted(map(str, reconcile.batch_mismatches(records).unionByName(whole).withColumnRenamed("batch_id", "batch_no").select("file_id", "batch_no", "field", "expected", "actual").collect()))


def rows_of(df):
    return sorted(map(str, df.select("file_id", "batch_no", "field", "expected", "actual").collect()))


def test_files_in_parts_reconcile_as_whole_files(spark, ach, tmp_path):
    """Every file in three parts over many micro-batches: cut inside a batch, and before the padding behind the control record."""
    names = sorted(ach)[:3]
    some = {n: ach[n] for n in names}
    parts = []
    for k in range(3):
        for n in names:
            cuts = [0, len(ach[n]) // 3, len(ach[n]) - 2, len(ach[n])]
            parts.append((n, ach[n][cuts[k]:cuts[k + 1]]))
    arrivals(str(tmp_path / "in"), parts)
    want = in_batch(spark, some)
    assert want and rows_of(jobs.reconcile_stream(spark, str(tmp_path / "in"), files_per_batch=2)) == want


def test_state_outlives_a_run_and_ends_with_patience(spark, ach, tmp_path):
    name, other = sorted(ach)[:2]
    half = len(ach[name]) // 2
    places = {"table": str(tmp_path / "table"), "checkpoint": str(tmp_path / "state")}
    run = lambda **how: jobs.reconcile_stream(spark, str(tmp_path / "in"), files_per_batch=1, flush=False, **how, **places)
    arrivals(str(tmp_path / "in"), [(name, ach[name][:half])])
    assert run().count() == 0
    assert run().count() == 0  # nothing new
    arrivals(str(tmp_path / "in"), [(name, ach[name][half:])], first=1)
    assert rows_of(run()) == in_batch(spark, {name: ach[name]})
    arrivals(str(tmp_path / "in"), [(other, ach[other][:5]), ("tick", ["x"])], first=2)
    rest = rows_of(run(patience=1))
    assert [r for r in rest if f"file_id='{name}'" in r] == in_batch(spark, {name: ach[name]})
    assert [r for r in rest if f"file_id='{other}'" in r] == in_batch(spark, {other: ach[other][:5]})
    assert not any("file_id='tick'" in r for r in rest)


def test_line_numbers_run_on_over_parts(spark, tmp_path):
    good = "05" + "1" * 141 + "  "
    held = [good, "zz" + good[2:], good, "yy" + good[2:], good, "xx" + good[2:]]
    arrivals(str(tmp_path / "in"), [("a", held[:2]), ("b", held), ("a", held[2:5]), ("a", held[5:])])
    got = jobs.validate_stream(spark, str(tmp_path / "in"), TCR0, files_per_batch=1)
    batch = validate.errors(validate.checked(files.read_lines(spark, str(tmp_path / "in"), files.partition_file_id()), TCR0))
    assert sorted(map(str, got.select(batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert {r["line_no"] for r in got.collect()} == set(range(1, 7))


def test_iso_text(spark):
    row = files.iso_text(spark.sql("select date '2026-01-02' as d, timestamp '2026-01-02 03:04:05' as t, 1.50BD as n, 2 as i, array(1) as a")).first()
    assert (row["d"], row["t"], row["n"], row["i"], row["a"]) == ("2026-01-02", "2026-01-02T03:04:05", "1.50", 2, "[1]")
