"""Queries: audit log, training log, user rules, sampling windows, streaming jobs, learned generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import fixed
from tallyframe.operators import audit, generate, profile, sinks, structure, validate
from tallyframe.plans import q_profile, q_structure, shared
from tallyframe.plans.registry import query
from tallyframe.session import scratch_path
from tallyframe.sources import derived, files
from tallyframe.sources.layouts import ACH
from tallyframe.streaming import jobs

ACTIONS = "case event_type when 'view' then 'TRAIN' when 'click' then 'VALIDATE' when 'purchase' then 'GENERATE' when 'signup' then 'DB_QUERY' else 'DELETE' end"
EVENTS_SQL = f"ev AS (SELECT event_id, ts, {ACTIONS} AS action, 'spec-' || (user_id % 5) AS spec, value AS score, cast(round(value * 100) AS bigint) AS cents FROM events)"


def events(spark, folder):
    return derived.table(spark, folder, "events").selectExpr(
        "event_id", "ts", f"{ACTIONS} as action", "concat('spec-', user_id % 5) as spec", "value as score", "cast(round(value * 100) as bigint) as cents")


@query("a27_audit_statistics", f"WITH {EVENTS_SQL} SELECT action, cast(count(*) AS bigint) AS n, round(avg(CASE WHEN action = 'VALIDATE' THEN score END), 2) AS avg_valid_score FROM ev GROUP BY 1")
def a27(spark, folder):
    return audit.by_action(events(spark, folder))


@query("a27_audit_summary", f"""WITH {EVENTS_SQL} SELECT cast(count(*) AS bigint) AS total_events, cast(count(*) FILTER (WHERE action = 'VALIDATE') AS bigint) AS validations_run,
  cast(count(*) FILTER (WHERE action = 'GENERATE') AS bigint) AS files_generated, cast(count(*) FILTER (WHERE action = 'TRAIN') AS bigint) AS specs_trained,
  round(avg(CASE WHEN action = 'VALIDATE' THEN score END), 2) AS avg_valid_score FROM ev""")
def a27b(spark, folder):
    return audit.summary(events(spark, folder))


@query("t2_newest_events", f"WITH {EVENTS_SQL} SELECT event_id, ts, action, spec FROM ev WHERE action = 'VALIDATE' ORDER BY ts DESC, event_id DESC LIMIT 200")
def t2(spark, folder):
    return audit.page(events(spark, folder), action="VALIDATE").select("event_id", "ts", "action", "spec")


@query("k4_audit_append", f"WITH {EVENTS_SQL} SELECT action, spec, cast(count(*) AS bigint) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY 1, 2")
def k4(spark, folder):
    """Events appended twice under one run id (a retried job) and read back: no duplicates."""
    path = scratch_path(spark, "audit")
    for _ in range(2):
        sinks.append_audit(events(spark, folder), path, "run-1")
    return files.read_audit(spark, path).groupBy("action", "spec").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("ts").cast("timestamp_ntz")).alias("first_ts"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last_ts"))


@query("s12_audit_scan", f"WITH {EVENTS_SQL} SELECT action, spec, ts, score FROM ev WHERE event_id % 50 <> 0 AND action = 'VALIDATE' AND spec = 'spec-2'")
def s12(spark, folder):
    """An NDJSON log in which every 50th line is broken."""
    path = scratch_path(spark, "ndjson")
    whole = F.to_json(F.struct(F.col("ts").cast("timestamp").alias("ts"), "action", "spec", "score"), {"timestampFormat": sinks.ISO_MICROS})
    text = F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(whole)
    events(spark, folder).select(text.alias("value")).write.text(path)
    found = files.read_audit(spark, path, "VALIDATE", "spec-2")
    return found.select("action", "spec", F.col("ts").cast("timestamp_ntz").alias("ts"), "score")


TRAIN_S = "event_id as iter, value / 100 as train_loss, value / 90 as val_loss, 0.001D / (1 + event_id) as lr, cast(event_id as double) as elapsed_s"
TRAIN_SQL = """SELECT {run} cast(count(*) AS bigint) AS rows, max_by(value / 100, event_id) AS last_train, max_by(value / 90, event_id) AS last_val, min(value / 90) AS best_val,
  max_by(0.001::double / (1 + event_id), event_id) AS last_lr FROM events {group}"""


def training_log(spark, folder):
    return derived.table(spark, folder, "events").selectExpr(*TRAIN_S.split(", "))


@query("a37_training_summary", TRAIN_SQL.format(run="event_type,", group="GROUP BY 1"))
def a37(spark, folder):
    return audit.training_summary(derived.table(spark, folder, "events").selectExpr("event_type", *TRAIN_S.split(", ")), ["event_type"])


@query("s13_training_log", TRAIN_SQL.format(run="", group=""))
def s13(spark, folder):
    path = scratch_path(spark, "training-csv")
    training_log(spark, folder).write.option("header", True).csv(path)
    return audit.training_summary(files.read_training_log(spark, path), [])


@query("a38_run_statistics", q_profile.LEARN_SQL + f""", {q_structure.LAGGED.replace("WITH ", "", 1)}
  SELECT cast(count(*) AS bigint) AS total_fields, cast(count(*) FILTER (WHERE confidence >= 0.45) AS bigint) AS enriched_fields, cast(count(*) FILTER (WHERE type <> 'STRING') AS bigint) AS typed_fields,
    max(non_empty) AS total_rows, (SELECT cast(count(*) AS bigint) FROM lg WHERE p < q AND record_type <> '5') AS anomalies_found FROM learned""")
def a38(spark, folder):
    anomalies = structure.out_of_order(q_structure.seq(spark, folder), q_structure.ORDERING, "5")
    return audit.run_statistics(profile.learn(q_profile.long(spark, folder)), anomalies, profile.CONFIDENCE_THRESHOLD)


@query("c11_audit_report", f"""WITH {EVENTS_SQL} SELECT action, cast(count(*) AS bigint) AS n, round(avg(CASE WHEN action = 'VALIDATE' THEN score END), 2) AS avg_valid_score,
  max(ts) AS last_ts, cast(count(DISTINCT spec) AS bigint) AS specs, list(event_id ORDER BY ts DESC, event_id DESC)[1:200] AS newest FROM ev GROUP BY 1""")
def c11(spark, folder):
    """Statistics by action next to the newest page of each action."""
    ev = events(spark, folder)
    newest = ev.groupBy("action").agg(F.max("ts").alias("last_ts"), F.countDistinct("spec").alias("specs"))
    return audit.by_action(ev).join(newest, "action").join(audit.newest_pages(ev, "action"), "action")


@query("t9_detection_windows", """SELECT doc_id, array_to_string(string_split(text, chr(10))[1:20], chr(10)) AS first_lines, substr(text, 1, 500) AS short_window, substr(text, 1, 5000) AS long_window FROM documents""")
def t9(spark, folder):
    """The windows format detection may look at when asked to sample (an option; detection reads everything by default)."""
    return derived.table(spark, folder, "documents").selectExpr(
        "doc_id", "array_join(slice(split(text, '\\n', -1), 1, 20), '\\n') as first_lines", "substring(text, 1, 500) as short_window", "substring(text, 1, 5000) as long_window")


# ------------------------------------------------------------------------------------------------------ user rules
@query("v1_field_rules", """SELECT o_orderkey, 'o_totalprice' AS field, cast(cast(o_totalprice AS decimal(18,2)) AS varchar) AS value FROM orders WHERE NOT (o_totalprice < 450000)
  UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders WHERE try_cast(substr(o_orderpriority, 1, 1) AS int) >= 5""")
def v1(spark, folder):
    rows = derived.table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderpriority")
    return validate.field_rules(rows, {
        "o_totalprice": lambda c: c < 450000,
        "o_orderpriority": lambda c: F.substring(c, 1, 1).try_cast("int") < 5}).select("o_orderkey", "field", "value")


@query("v1_field_transforms", "SELECT s_suppkey, coalesce(try_cast(substr(s_name, 10) AS varchar), s_name) AS s_name FROM supplier")
def v1b(spark, folder):
    rows = derived.table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return validate.apply_transforms(rows, {"s_name": F.expr("nullif(substring(s_name, 10), '')")})


@query("v4_text_rules", """SELECT l_suppkey, rule, expected, actual FROM (SELECT l_suppkey, unnest(['sum(l_linenumber) = count(1)', 'max(l_linenumber) = 7']) AS rule,
  unnest([cast(sum(l_linenumber) AS varchar), cast(max(l_linenumber) AS varchar)]) AS expected, unnest([cast(count(*) AS varchar), '7']) AS actual FROM lineitem GROUP BY 1) WHERE expected <> actual""")
def v4(spark, folder):
    return validate.text_rules(derived.table(spark, folder, "lineitem"), "l_suppkey", ["sum(l_linenumber) = count(1)", "max(l_linenumber) = 7"])


# ------------------------------------------------------------------------------------------------------- streaming
@query("st1_audit_stream", f"WITH {EVENTS_SQL} SELECT date_trunc('hour', ts) AS hour, action, cast(count(*) AS bigint) AS n, cast(sum(cents) AS bigint) AS cents FROM ev GROUP BY 1, 2")
def st1(spark, folder):
    schema = derived.table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    shaped = stream.selectExpr("cast(ts as timestamp) as ts", f"{ACTIONS} as action", "cast(round(value * 100) as bigint) as cents")
    return jobs.audit_statistics(shaped).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("st1_audit_hours_batch", f"WITH {EVENTS_SQL} SELECT date_trunc('hour', ts) AS hour, action, cast(count(*) AS bigint) AS n, cast(sum(cents) AS bigint) AS cents FROM ev GROUP BY 1, 2")
def st1b(spark, folder):
    return audit.hourly(events(spark, folder))


@query("st2_validate_stream", shared.ach_checks() + """ SELECT file_id, line_no, field, code FROM (SELECT file_id, line_no, field, unnest(codes) AS code FROM lenient
  UNION ALL SELECT file_id, line_no, 'RECORD_LENGTH', 'RECORD_LENGTH' FROM typed WHERE length(line) <> 94 UNION ALL SELECT file_id, line_no, 'RECORD_TYPE', 'RECORD_TYPE' FROM typed WHERE record_type IS NULL)""")
def st2(spark, folder):
    """Every finding with its line number, from files that arrive in several micro-batches."""
    path = jobs.write_for_stream(shared.raw(spark, folder), "arrivals")
    return jobs.validate_stream(spark, path, ACH, files_per_batch=20).select("file_id", "line_no", "field", "code")


def _totals_sql():
    from tallyframe.plans import q_validate
    j5 = q_validate.J5_SQL.replace("SELECT * FROM x WHERE", "SELECT file_id, batch_id AS batch_no, field, expected, actual FROM x WHERE")
    j6 = q_validate.J6_SQL.replace("SELECT * FROM x WHERE", "SELECT file_id, 0::bigint AS batch_no, field, expected, actual FROM x WHERE")
    return f"SELECT * FROM ({j5}) UNION ALL SELECT * FROM ({j6})"


@query("st3_reconcile_stream", _totals_sql())
def st3(spark, folder):
    path = jobs.write_for_stream(shared.raw(spark, folder), "arrivals")
    return jobs.reconcile_stream(spark, path, files_per_batch=20)


@query("st4_training_stream", TRAIN_SQL.format(run="'all' AS run,", group=""))
def st4(spark, folder):
    path = scratch_path(spark, "training-csv")
    training_log(spark, folder).write.option("header", True).csv(path)
    return jobs.training_metrics(spark, path)


# ------------------------------------------------------------------------------------------- learned generation
@query("g17_learned_generation", None)
def g17(spark, folder):
    """Entry lines in the layout learned from the entry lines of all files, one per customer."""
    lines = shared.raw(spark, folder).withColumn("rid", fixed.learned_record_id(F.col("line"), False))
    return generate.from_learned(derived.table(spark, folder, "customer"), "c_custkey", lines, "6", 94, 11, "2026-04-15")
