"""Session helpers: checkpoint and scratch locations are read from the session, never invented on a cluster."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "tallyframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. A private one only where that is unset and the master is local
    (tests); on a cluster a machine-local folder would be unreadable elsewhere, so an unset folder is an error there."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} shares")
    private = tempfile.mkdtemp(prefix="tallyframe-")
    spark.sparkContext.setCheckpointDir(private)
    return private


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    path = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a written intermediate table."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


#: Bytes of a batch of rows on their way to Python. Spark's own bound of 64 MB is held several times over, in the JVM's buffers and in
#: the worker, by every task that sends whole texts.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside send Python batches of about BATCH_BYTES, or one row; a bound that the caller's session sets stays."""
    if BATCH_SETTING in spark.conf.getAll:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def written(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """An intermediate result that several branches read: written once to the shared folder and read back, so it is
    neither recomputed per branch nor lost with an executor. ``small``: by ``small_batches``."""
    path = scratch_path(df.sparkSession, label)
    with small_batches(df.sparkSession) if small else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Tasks that a core gets of rows dealt out by ``spread``.
TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table in fewer files than cores, dealt out evenly. A file splits no finer than its row groups, so work that is dear
    for every row would otherwise wait for a few tasks. Tables of more files stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(TASKS_PER_CORE * cores) if len(df.inputFiles()) < cores else df


#: Characters of text for a task of ``by_key``.
TASK_CHARS = 8 << 20


def by_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of a key in one task, about TASK_CHARS characters a task. Grouping by the key and by parts of the text then needs no other
    shuffle: the texts travel once instead of their many parts."""
    chars = df.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    tasks = max(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    return df.repartition(tasks, key)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of ours below the shared folder, if it is there."""
    if not path.startswith(shared_dir(spark)) and "version=" not in path:
        raise ValueError(f"{path} is no intermediate table")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
