"""A sample of the registered queries against their SQL on the smallest tables; TALLYFRAME_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entrypoint
import check

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["g11_ach_files", "p5_record_class", "x30_check_fold", "a1_validation_report", "j5_batch_mismatches", "w3_enclosing_batch", "w16_sequence_rules",
          "a12_type_winner", "c3_learn_spec", "a20_transition_matrix", "t1_top_formats", "c6_learn_spec_documents", "g1_spec_rows", "s7_message_tags",
          "k1_s1_ordered_lines", "w10_distinct_lines", "u5_dedup_one_pass", "w17_next_char_distribution", "x18_char_encode", "a36_model_loss", "st1_audit_stream"]
QUERIES, ORACLES = entrypoint.queries(), entrypoint.oracle_sql()
NAMES = sorted(QUERIES) if os.environ.get("TALLYFRAME_ALL") else SAMPLE


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    ok, text = check.compare(spark, check.oracle(FOLDER), name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
