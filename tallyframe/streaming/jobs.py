"""Structured Streaming jobs: audit statistics, line validation, file reconciliation, training metrics.

Every job runs with ``availableNow`` and a checkpoint in the shared folder; sinks and state tables are idempotent per
micro-batch, so a restarted query or a lost executor leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.operators import audit, reconcile, sinks, validate
from tallyframe.session import dropped, scratch_path, written
from tallyframe.sources import files
from tallyframe.sources.layouts import Spec


def run_to_table(stream: DataFrame, label: str, mode: str, transform: Callable[[DataFrame, int], DataFrame] | None = None,
                 table: str | None = None, checkpoint: str | None = None) -> str:
    """Drain a stream into a parquet table, one directory per micro-batch (rewritten if the batch is repeated). ``transform`` takes the
    micro-batch and its number."""
    spark = stream.sparkSession
    table, checkpoint = table or scratch_path(spark, label), checkpoint or scratch_path(spark, f"{label}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch, batch_id) if transform else batch
        out.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    return table


def latest(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Last version of every key of an update-mode table."""
    rows = spark.read.option("basePath", table).parquet(table)
    values = [c for c in rows.columns if c not in keys and c != "batch_id"]
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return packed.select(*keys, "v.*")


def audit_statistics(events: DataFrame, label: str = "audit-hours", delay: str = "1 hour", **places: str) -> DataFrame:
    """Hourly counts per action over an event stream (ts, action, cents). Windows older than the watermark are closed
    and dropped from state; late events within the delay still count."""
    windowed = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).select(F.col("w.start").alias("hour"), "action", "n", "cents")
    return latest(events.sparkSession, run_to_table(windowed, label, "update", **places), ["hour", "action"])


class State:
    """Small tables that a micro-batch leaves for the next one, below ``path``: version n is what holds after micro-batch n. A
    repeated micro-batch reads version n - 1 again and writes n again, so a restart changes nothing. Versions before the
    last two go."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, version: int, **schemas: str) -> dict[str, DataFrame]:
        if version < 0:
            return {name: self.spark.createDataFrame([], schema) for name, schema in schemas.items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.path}/version={version}/{name}") for name, schema in schemas.items()}

    def write(self, version: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/version={version}/{name}")
        dropped(self.spark, f"{self.path}/version={version - 2}")


def _after(numbered: DataFrame, lines: DataFrame) -> DataFrame:
    """Line numbers of a part, counted on from the lines (file_id, lines) that came before it."""
    joined = numbered.join(lines, "file_id", "left")
    return joined.withColumn("line_no", F.col("line_no") + F.coalesce("lines", F.lit(0))).drop("lines")


def validate_stream(spark: SparkSession, path: str, spec: Spec, dialect: str = "lenient", files_per_batch: int | None = None, state: str | None = None, **places: str) -> DataFrame:
    """Findings of every line as files arrive, with its line number. Parts of a file come in order; the lines of a file so far
    are the state."""
    held = State(spark, state or (f"{places['checkpoint']}-lines" if "checkpoint" in places else scratch_path(spark, "stream-lines")))

    def findings(batch: DataFrame, number: int) -> DataFrame:
        part = files.numbered_lines(batch, files.partition_file_id())
        before = held.read(number - 1, lines="file_id string, lines long")["lines"]
        counts = part.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"))
        held.write(number, lines=before.unionByName(counts).groupBy("file_id").agg(F.sum("lines").alias("lines")))
        return validate.errors(validate.checked(_after(part, before), spec, dialect))

    table = run_to_table(files.raw_lines(spark, path, True, files_per_batch), "stream-errors", "append", findings, **places)
    return spark.read.option("basePath", table).parquet(table).drop("batch_id")


SUMS = ("entries", "entry_addenda_count", "entry_hash", "total_debit_amount", "total_credit_amount")
RECONCILED = {"files": "file_id string, lines long, opened long, closed long, seen long", "batches": "file_id string, batch_id long, " + ", ".join(f"{n} long" for n in SUMS),
              "marks": "file_id string, batch_id long, record_type string, line string"}


def _compared(state: dict[str, DataFrame]) -> DataFrame:
    """Batch and file mismatches from summed parts, as ``reconcile`` finds them in whole files."""
    totals = state["batches"].withColumn("entry_hash", F.col("entry_hash") % reconcile.HASH)
    batches = reconcile.batch_mismatches(state["marks"], totals)
    sums = state["batches"].groupBy("file_id").agg(*[F.sum(n).alias(n) for n in SUMS])
    whole = state["files"].join(sums, "file_id", "left").select(
        "file_id", F.col("opened").alias("batch_count"), F.ceil(F.col("lines") / 10).cast("bigint").alias("block_count"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in SUMS if n != "entry_hash"], (F.coalesce("entry_hash", F.lit(0)) % reconcile.HASH).alias("entry_hash"))
    found = reconcile.file_mismatches(state["marks"], whole).withColumn("batch_id", F.lit(0).cast("bigint"))
    return batches.unionByName(found).withColumnRenamed("batch_id", "batch_no")


def reconcile_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, patience: int | None = None, flush: bool = True, state: str | None = None, **places: str) -> DataFrame:
    """Batch and file mismatches of files that arrive in parts, in any number of micro-batches (the parts of a file in order).

    State, per file: lines, batches opened and closed so far, the sums of each batch, and its header and control lines
    - never detail lines, whose sums are combined before the shuffle, so a huge file is no single task. A micro-batch adds its
    sums. A file is done when its control record has come with as many lines as the record's blocks hold, or when
    ``patience`` micro-batches brought nothing for it; its findings go out and its state goes. ``flush`` does that for all
    files when the stream is drained. Lines that come after that count as a file of their own. With ``flush=False`` and the same
    places a later run goes on with the state."""
    held = State(spark, state or (f"{places['checkpoint']}-files" if "checkpoint" in places else scratch_path(spark, "stream-files")))
    last = {"number": -1}

    def findings(batch: DataFrame, number: int) -> DataFrame:
        before = held.read(number - 1, **RECONCILED)
        part = files.numbered_lines(batch, files.partition_file_id())
        records = written(reconcile.with_batch(part, before["files"].select("file_id", "opened", "closed")), "stream-records")
        kind = F.coalesce("record_type", F.lit(""))
        added = records.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(kind == "5").alias("opened"), F.count_if(kind == "8").alias("closed"), F.lit(number).cast("long").alias("seen"))
        now = {"files": before["files"].unionByName(added).groupBy("file_id").agg(*[F.sum(n).alias(n) for n in ("lines", "opened", "closed")], F.max("seen").alias("seen")),
               "batches": before["batches"].unionByName(reconcile.detail_sums(records)).groupBy("file_id", "batch_id").agg(*[F.sum(n).alias(n) for n in SUMS]),
               "marks": before["marks"].unionByName(records.filter(kind.isin("5", "8", "9")).select("file_id", "batch_id", "record_type", "line"))}
        held.write(number, **{f"all_{n}": df for n, df in now.items()})
        now = {n: df for n, df in zip(now, held.read(number, **{f"all_{n}": s for n, s in RECONCILED.items()}).values())}
        blocks = now["marks"].filter("record_type = '9'").groupBy("file_id").agg(F.max(F.coalesce(F.expr("try_cast(substring(line, 8, 6) as bigint)"), F.lit(0))).alias("blocks"))
        done = now["files"].join(blocks, "file_id", "left").filter((F.col("lines") >= F.col("blocks") * 10) | (F.lit(False) if patience is None else F.col("seen") <= number - patience)).select("file_id")
        held.write(number, **{n: df.join(done, "file_id", "left_anti") for n, df in now.items()})
        last["number"] = number
        return _compared({n: df.join(done, "file_id", "left_semi") for n, df in now.items()})

    table = run_to_table(files.raw_lines(spark, path, True, files_per_batch), "stream-totals", "append", findings, **places)
    out = spark.read.schema("batch_no long, file_id string, field string, expected long, actual long").option("basePath", table).parquet(table).drop("batch_id")
    if flush and last["number"] >= 0:
        out = out.unionByName(_compared(held.read(last["number"], **RECONCILED)))
    return out


def training_metrics(spark: SparkSession, path: str, **places: str) -> DataFrame:
    """Running summary of a growing training log."""
    log = spark.readStream.schema(files.TRAINING_LOG).option("header", True).csv(path).withColumn("run", F.lit("all"))
    return latest(spark, run_to_table(audit.training_summary(log, ["run"]), "training", "update", **places), ["run"])


def write_for_stream(lines: DataFrame, label: str) -> str:
    """Lay lines out as arriving files."""
    path = scratch_path(lines.sparkSession, label)
    sinks.write_lines(lines, path)
    return path
