"""Queries on generated and sliced ACH files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import synth
from tallyframe.plans import shared
from tallyframe.plans.registry import query


@query("g11_ach_files", f"WITH {shared.CLEAN_LINES} SELECT file_id, cast(line_no AS bigint) AS line_no, record_type, line FROM clean_lines")
def g11(spark, folder):
    return shared.clean_lines(spark, folder).select("file_id", "line_no", "record_type", "line")


@query("a3_batch_totals", f"WITH {shared.ENTRIES} SELECT * FROM batches")
def a3(spark, folder):
    return synth.ach_batch_totals(shared.entries(spark, folder), "file_id", "file_no", "batch_no")


@query("s0_damaged_lines", f"WITH {shared.LINES} SELECT file_id, line_no, record_type, line FROM lines")
def s0(spark, folder):
    return shared.lines(spark, folder).select("file_id", "line_no", "record_type", "line")
