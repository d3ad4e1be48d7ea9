"""Writers: ordered fixed-width files, delimited, JSON, audit events, reports, corpus splits."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.session import by_key
from tallyframe.sources.files import AUDIT_SCHEMA

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_lines(lines: DataFrame, path: str, line_sep: str = "\n") -> None:
    """Ordered text files, one directory per file_id. Rows are range-partitioned by (file, line), so a huge file
    becomes several ordered part files instead of one task; parts in name order are the file."""
    (lines.select("file_id", "line_no", "line").repartitionByRange("file_id", "line_no")
     .sortWithinPartitions("file_id", "line_no").select("file_id", F.col("line").alias("value"))
     .write.partitionBy("file_id").option("lineSep", line_sep).text(path))


def write_texts(texts: DataFrame, key: str, text: str, path: str) -> int:
    """The texts of each key as lines of a file of their own, ``bucket=.../<key>=<value>.txt``; returns the number of files.

    Tasks open the files themselves. A folder, an attempt's folder and a move for each file, which Spark's writer makes for
    partitions of one file, take many times as long as a small text. A repeated task writes the same names again. Stores that pyarrow does not
    know get Spark's writer, ``<key>=<value>/part-...``."""
    rows = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("value"))
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        rows.withColumnRenamed("key", key).repartition(key).write.partitionBy(key).text(path)
        return rows.select("key").distinct().count()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = fs.FileSystem.from_uri(path)
        folder = f"{inner}/bucket={TaskContext.get().partitionId()}"
        files, last, file = 0, None, None
        try:
            for batch in batches:
                keys, values = batch.columns
                for at, name in enumerate(keys.to_pylist()):
                    if file is None or name != last:
                        if file is None:
                            store.create_dir(folder, recursive=True)
                        else:
                            file.close()
                        shown = "__HIVE_DEFAULT_PARTITION__" if name is None else quote(name, safe=" ")
                        file, last, files = store.open_output_stream(f"{folder}/{key}={shown}.txt", compression=None), name, files + 1
                    value = values[at].as_buffer()
                    if value is not None:
                        file.write(value)
                    file.write(b"\n")
        finally:
            if file is not None:
                file.close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return by_key(rows, "key", "value").sortWithinPartitions("key").mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0


def write_delimited(df: DataFrame, path: str, delimiter: str, header: bool = True) -> None:
    df.write.option("sep", delimiter).option("header", header).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def payload(records: DataFrame, outer_types: list[str]) -> DataFrame:
    """Records for a JSON payload: header and trailer rows and internal columns (leading underscore) go."""
    kept = records.filter(~F.col("_record_type").isin(*outer_types))
    return kept.select(*[c for c in kept.columns if not c.startswith("_")])


def append_audit(events: DataFrame, path: str, run_id: str) -> None:
    """Append audit events partitioned by day and run. A run writes its own partitions and replaces them when it is
    repeated, so a retried job leaves no duplicates."""
    columns = {f.name for f in AUDIT_SCHEMA.fields}
    present = [F.col(f.name).cast(f.dataType) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name)
               for f in AUDIT_SCHEMA.fields]
    extra = [c for c in events.columns if c not in columns]
    (events.select(*present, *extra, F.to_date("ts").alias("day"), F.lit(run_id).alias("run_id"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("timestampFormat", ISO_MICROS)
     .partitionBy("run_id", "day").json(path))


def clear_audit(spark: SparkSession, path: str) -> int:
    """Empty the log; returns the number of events removed."""
    removed = spark.read.schema(AUDIT_SCHEMA).json(path).count()
    spark.createDataFrame([], AUDIT_SCHEMA).write.mode("overwrite").option("partitionOverwriteMode", "static").json(path)
    return removed


def report_json(report: DataFrame, capped: DataFrame) -> DataFrame:
    """One JSON text per file: the report with its capped messages (at most 300 per file)."""
    messages = capped.groupBy("file_id").agg(F.sort_array(F.collect_list(
        F.struct("severity", "rank", "line_no", "field", "code", "value"))).alias("messages"))
    joined = report.join(messages, "file_id", "left")
    return joined.select("file_id", F.to_json(F.struct(*[c for c in joined.columns])).alias("report"))


def write_splits(corpus: DataFrame, path: str) -> None:
    """Corpus lines by split (columns split, position, text) as ordered text."""
    (corpus.repartitionByRange("split", "position").sortWithinPartitions("split", "position")
     .select("split", F.col("text").alias("value")).write.partitionBy("split").text(path))
