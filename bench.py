"""Headline queries, timed to a full materialisation: ``BENCH_SF_DIR=... BENCH_CPUS=8 python bench.py``.

Prints one JSON line. Derived input files are landed first and timed on their own (``land_inputs``)."""

from __future__ import annotations

import json
import os
import sys
import time

from tallyframe.plans import catalog, shared
from tallyframe.session import build_session

HEADLINE = ["g11_ach_files", "c1_validate_files", "a1_validation_report_strict", "c2_reconcile_files", "c3_learn_spec",
            "c4_detect_structure", "c5_identify_files", "g1_spec_rows", "s7_message_tags", "k1_s1_ordered_lines", "w10_distinct_lines",
            "u5_dedup_one_pass", "u5_dedup_documents", "c8_prepare_corpus", "a29_document_model", "a36_model_loss", "w18_training_windows", "st1_audit_stream"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
                          "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.files.openCostInBytes": "131072"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    start = time.time()
    for land in (shared.lines, shared.card_lines, shared.gl_lines):
        land(spark, folder)
    times["land_inputs"] = round(time.time() - start, 3)
    print("land_inputs", times["land_inputs"], file=sys.stderr, flush=True)
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
