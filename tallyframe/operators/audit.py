"""Audit and training-log statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PAGE = 200


def page(events: DataFrame, limit: int = PAGE, action: str | None = None, spec: str | None = None, tie: str = "event_id") -> DataFrame:
    """Newest events first: a page of ``limit`` rows."""
    if action:
        events = events.filter(F.col("action") == action)
    if spec:
        events = events.filter(F.col("spec") == spec)
    return events.orderBy(F.col("ts").desc(), F.col(tie).desc()).limit(limit)


def newest_pages(events: DataFrame, key: str, limit: int = PAGE, tie: str = "event_id") -> DataFrame:
    """(key, newest): the ids of the newest events of each key, a page of ``limit``, newest first. The rank limit runs before the
    shuffle, so a frequent key sends a page per task."""
    order = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col(tie).desc())
    top = events.select(key, "ts", tie).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)
    return top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_rank", tie))).alias("_p")).select(key, F.transform("_p", lambda p: p[tie]).alias("newest"))


def by_action(events: DataFrame) -> DataFrame:
    """Events per action and the mean score of validations."""
    return events.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.expr("round(avg(if(action = 'VALIDATE', score, null)), 2) as avg_valid_score"))


def summary(events: DataFrame) -> DataFrame:
    """Totals over the whole log."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), F.expr("count_if(action = 'VALIDATE') as validations_run"),
        F.expr("count_if(action = 'GENERATE') as files_generated"), F.expr("count_if(action = 'TRAIN') as specs_trained"),
        F.expr("coalesce(round(avg(if(action = 'VALIDATE', score, null)), 2), 0D) as avg_valid_score"))


def hourly(events: DataFrame) -> DataFrame:
    """Events and value sums per hour and action; the batch form of the streaming job."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).select(F.col("w.start").alias("hour"), "action", "n", "cents")


def training_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Rows, last and best losses, last learning rate."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.expr("max_by(train_loss, iter) as last_train"), F.expr("max_by(val_loss, iter) as last_val"),
        F.expr("min(val_loss) as best_val"), F.expr("max_by(lr, iter) as last_lr"))


def run_statistics(learned: DataFrame, anomalies: DataFrame, threshold: float) -> DataFrame:
    """Statistics of a learning run: fields, confident fields, typed fields, anomalies found."""
    fields = learned.agg(
        F.count(F.lit(1)).alias("total_fields"), F.count_if(F.col("confidence") >= threshold).alias("enriched_fields"),
        F.count_if(F.col("type") != "STRING").alias("typed_fields"), F.max("non_empty").alias("total_rows")).withColumn("run", F.lit(1))
    found = anomalies.agg(F.count(F.lit(1)).alias("anomalies_found")).withColumn("run", F.lit(1))
    return fields.join(found, "run").drop("run")
