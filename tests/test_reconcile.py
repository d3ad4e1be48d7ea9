from collections import Counter

from pyspark.sql import functions as F

from tallyframe.operators import reconcile, synth, validate
from tallyframe.sources.layouts import ACH

from test_validate import clean_ach

ENTRY = "632111122223123456789        0000100000AB156325       JACK SMITH              0026015070000%03d"


def three_batches():
    head = "5220ALPHA COMPANY                       1234567890%sPAYROLL   JUN 20200701   1026015070000%03d"
    ctl = "8220%06d%010d%012d%012d1234567890                         026015070000%03d"
    lines = ["101 02601507911223344552006011330A094101GS BANK USA            YOUR COMPANY NAME      REF123AB"]
    for no, (sec, ids) in enumerate([("CCD", (1, 2, 3)), ("PPD", (11, 12)), ("PPD", (101, 102))], 1):
        lines += [head % (sec, no)] + [ENTRY % i for i in ids] + [ctl % (len(ids), 11112222 * len(ids), 0, 100000 * len(ids), no)]
    return lines + ["9000003000002000000070077785554000000000000000000700000     "]


def records(spark, lines):
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines, 1)], "file_id string, line_no bigint, line string")
    return df, reconcile.with_batch(df)


def test_balanced_file(spark):
    df, rec = records(spark, three_batches())
    totals = {r["batch_id"]: r for r in reconcile.computed_batches(rec).collect()}
    assert [totals[i]["entries"] for i in (1, 2, 3)] == [3, 2, 2]
    assert [totals[i]["entry_hash"] for i in (1, 2, 3)] == [33336666, 22224444, 22224444]
    assert [totals[i]["total_credit_amount"] for i in (1, 2, 3)] == [300000, 200000, 200000]
    assert reconcile.batch_mismatches(rec).count() == 0
    assert reconcile.file_mismatches(rec).count() == 0
    assert reconcile.header_control_mismatches(rec).count() == 0
    found = validate.errors(validate.checked(df, ACH)).collect()
    assert sum(r["code"] == "ROUTING" and r["field"] == "rdfi_routing_transit" for r in found) == 7
    assert [r["line_no"] for r in found if r["code"] == "RECORD_LENGTH"] == [15]


def test_bad_file(spark):
    rows = ["101 021000021 0210000212601150000A094101FIRST NATIONAL BANK   ACME PAYROLL CO        ",
            "5220ACME PAYROLL CO      9876543210PPD PAYROLL   260115260117 1021000020000001"]
    rows += ["6220021000021%s012345  0000%06d00JONES SARAH          ACME001         1021000020000001" % ("123456789", i) for i in range(1, 6)]
    rows += ["820000000600126000126000000000000000000873250ACME PAYROLL CO                        021000020000001",
             "9000001000001000000060012600012600000000000000000008732509999999999999999999999999999999999999", "9" * 94]
    df, rec = records(spark, rows)
    wrong = {(r["field"], r["expected"], r["actual"]) for r in reconcile.batch_mismatches(rec).collect()}
    assert ("entry_addenda_count", 5, 6) in wrong
    assert df.filter(F.length("line") != 94).count() == sum(len(r) != 94 for r in rows)
    assert rec.filter("record_type = 'padding'").count() == 1


def test_mutations(spark):
    lines = synth.ach_files(clean_ach(spark)).select("file_id", "line_no", "line").cache()
    base = reconcile.with_batch(lines)
    for check in (reconcile.batch_mismatches, reconcile.file_mismatches, reconcile.header_control_mismatches,
                  reconcile.orphan_addenda, reconcile.entries_without_addenda, reconcile.sequence_errors):
        assert check(base).count() == 0, check.__name__

    def changed(kind, at, new):
        pick = base.filter(F.col("record_type") == kind).orderBy("file_id", "line_no").first()
        here = (F.col("file_id") == pick["file_id"]) & (F.col("line_no") == pick["line_no"])
        return reconcile.with_batch(lines.withColumn("line", F.when(here, F.expr(f"overlay(line placing '{new}' from {at} for {len(new)})")).otherwise(F.col("line"))))

    amount = changed("6", 30, "0000000777")
    assert {r["field"] for r in reconcile.batch_mismatches(amount).collect()} <= {"total_debit_amount", "total_credit_amount"}
    assert reconcile.batch_mismatches(amount).count() == 1 and reconcile.file_mismatches(amount).count() == 1
    assert [r["field"] for r in reconcile.batch_mismatches(changed("8", 5, "000999")).collect()] == ["entry_addenda_count"]
    assert [r["field"] for r in reconcile.file_mismatches(changed("9", 2, "000009")).collect()] == ["batch_count"]
    assert [r["field"] for r in reconcile.header_control_mismatches(changed("8", 80, "99999999")).collect()] == ["odfi_identification"]
    assert {r["rule"] for r in reconcile.sequence_errors(changed("5", 88, "0000007")).collect()} == {"BATCH_NUMBER"}
    assert reconcile.orphan_addenda(changed("7", 88, "9999999")).count() == 1
    assert reconcile.entries_without_addenda(changed("7", 88, "9999999")).count() == 1
    torn = changed("7", 88, "9999999").select("file_id", "line_no", F.expr("if(record_type = '9', concat(line, 'xy'), line) as line"))
    found = Counter((r["check"], r["expected"], r["actual"]) for r in reconcile.findings(torn).collect() if r["check"] != "ORPHAN_ADDENDA")
    files = base.select("file_id").distinct().count()
    assert found.pop(("RECORD_LENGTH", "94", "96")) == files
    ((check, expected, actual),) = found
    assert check == "MISSING_ADDENDA" and expected != "9999999" and actual is None


def test_lines_after_control_belong_to_no_batch(spark):
    _, rec = records(spark, ["1" + " " * 93, "6" + " " * 93, "5" + " " * 93, "6" + " " * 93, "8" + " " * 93, "6" + " " * 93, "9" + " " * 93])
    assert [r["batch_id"] for r in rec.orderBy("line_no").collect()] == [None, None, 1, 1, 1, None, None]
