"""Running values over very long ordered groups without putting a group into one task.

A plain ``Window.partitionBy(file)`` sends a whole file to one task, and a single file may hold a third of all
rows. Here a group is cut into chunks by a monotone integer of its order: the window runs per (group, chunk); the
summaries, one row per chunk of about 131072 rows, are scanned per group, and the offsets come back by an equi-join on
(group, chunk). Only summaries ever meet in one task: a group of 10^12 rows has about 8 million of them.

Line numbers and other dense positions are cut by their value. Keys of any kind (``sparse=True``) are cut where the rows
are: see ``ranged``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.session import TASKS_PER_CORE, written

CHUNK_ROWS = 1 << 17
#: Rows of a task that sorts chunks, and rows beyond which tasks grow in number again. Spark sizes tasks by compressed bytes: 64 MB of them
#: are 250 MB and more of rows in a sort, which spills them all where a task has less memory.
TASK_ROWS, MOST_TASK_ROWS = CHUNK_ROWS // 2, CHUNK_ROWS * 16



def _chunk(order: Column, chunk_rows: int) -> Column:
    return F.floor(order / F.lit(chunk_rows)).cast("bigint")


def ranged(df: DataFrame, keys: Sequence[str], order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``cut`` without its second value."""
    return cut(df, keys, order, chunk_rows)[0]


def cut(df: DataFrame, keys: Sequence[str], order: str, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, bool]:
    """Add ``_chunk``, which rises with the integer ``order`` in each group and holds about ``chunk_rows`` rows, wherever in 64
    bits they lie. Groups of at most that many rows are one chunk. A larger one is cut into equal ranges of values, as many as it has chunks;
    ranges that still hold more than two chunks, around a cluster of values, are cut again the same way (the chunk is the
    path of range numbers). Only ranges to be cut are looked up, fewer than rows / chunk_rows. Equal values stay together. Also
    whether any group was cut."""
    low, wide = F.min(order).cast("decimal(20,0)"), F.max(order).cast("decimal(20,0)")
    out, group = df.withColumns({"_all": F.lit(0), "_chunk": F.array().cast("array<bigint>")}), [*keys, "_all", "_chunk"]
    most = chunk_rows
    while True:
        stats = out.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), low.alias("_low"), wide.alias("_high")).where((F.col("_n") > most) & (F.col("_high") > F.col("_low")))
        step = F.greatest(F.lit(1).cast("decimal(20,0)"), F.ceil((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_n") / chunk_rows))).cast("decimal(20,0)")
        stats = written(stats.select(*group, "_low", step.alias("_step")), "chunk-ranges")
        if stats.isEmpty():
            return out.drop("_all"), most > chunk_rows
        place = F.floor((F.col(order).cast("decimal(20,0)") - F.col("_low")) / F.col("_step")).cast("bigint")
        out = out.join(stats, group, "left").withColumn("_path", F.concat("_chunk", F.array(F.coalesce(place, F.lit(0))))).drop("_low", "_step", "_chunk").withColumnRenamed("_path", "_chunk")
        most = 2 * chunk_rows


def sort_tasks(df: DataFrame) -> int | None:
    """Tasks of about ``TASK_ROWS`` rows for all of ``df``, or None if Spark's own will do. Up to ``MOST_TASK_ROWS`` rows, tasks are no more than
    a shuffle writes to without sorting its input; fewer than Spark's own would be dealt out again for a join."""
    spark = df.sparkSession
    rows, unsorted = df.count(), int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if rows <= TASK_ROWS * TASKS_PER_CORE * spark.sparkContext.defaultParallelism:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-rows // TASK_ROWS), unsorted), -(-rows // MOST_TASK_ROWS))


def _attach(df: DataFrame, offsets: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Equi-join offset columns back by (keys, chunk)."""
    return df.join(offsets.select(*keys, *cols), list(keys), "left")


def _offsets(summary: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Exclusive running sums over chunk summaries."""
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, "_chunk", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before")
                                             for s in sums])


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                 chunk_of: Column | None = None, chunk_rows: int = CHUNK_ROWS,
                 per_group: DataFrame | None = None, sparse: bool = False) -> DataFrame:
    """Add inclusive running sums. ``order`` is a total order whose first column is an integer; ``values`` maps new
    column names to the integer expressions to sum. Keys must not be null. Columns of ``per_group`` (one row per
    group) travel with the chunk offsets, so attaching them costs no further shuffle of the rows. ``sparse``: the first order
    column is no dense position, so chunks follow the rows, and so do tasks."""
    if sparse:
        # a task gets several chunks by their hashes: smaller ones deal the rows out more evenly
        tasks = sort_tasks(df)
        staged, parted = cut(df, keys, order[0], max(1, chunk_rows // 4) if tasks else chunk_rows)
    else:
        tasks = None
        staged = df.withColumn("_chunk", _chunk(chunk_of if chunk_of is not None else F.col(order[0]), chunk_rows))
    staged = staged.withColumns({f"_v_{n}": e.cast("bigint") for n, e in values.items()})
    window = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # the one chunk of groups that are not cut is a constant, which is no key of the window's or the join's
    local = staged.repartition(tasks, *keys, *["_chunk"][:parted]) if tasks else staged
    local = local.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(window) for n in values})
    summary = staged.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    offsets = _offsets(summary, keys, [f"_s_{n}" for n in values])
    carried = []
    if per_group is not None:
        carried = [c for c in per_group.columns if c not in keys]
        offsets = offsets.join(per_group, list(keys), "left")
    out = _attach(local, offsets, [*keys, "_chunk"], [f"_s_{n}_before" for n in values] + carried)
    out = out.withColumns({n: F.col(f"_r_{n}") + F.col(f"_s_{n}_before") for n in values})
    drop = ["_chunk"] + [f"_{p}_{n}" for n in values for p in ("v", "r")] + [f"_s_{n}_before" for n in values]
    return out.drop(*drop)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn",
             chunk_of: Column | None = None, chunk_rows: int = CHUNK_ROWS,
             per_group: DataFrame | None = None, sparse: bool = False) -> DataFrame:
    """Row number 1..n per group in order."""
    return running_sums(df, keys, order, {out: F.lit(1)}, chunk_of, chunk_rows, per_group, sparse)


def neighbour(df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, str], forward: bool,
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Lead (forward) or lag of columns, exact across chunk borders: ``cols`` maps source to new column name."""
    staged = df.withColumn("_chunk", _chunk(F.col(order), chunk_rows))
    by = F.col(order).asc()
    window = Window.partitionBy(*keys, "_chunk").orderBy(by)
    step = F.lead if forward else F.lag
    packed = F.struct(*cols)
    local = staged.withColumn("_near", step(packed, 1).over(window))
    pick = F.min_by if forward else F.max_by
    edge = staged.groupBy(*keys, "_chunk").agg(pick(packed, F.col(order)).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    edge = edge.select(*keys, "_chunk", step("_edge", 1).over(across).alias("_far"))
    out = _attach(local, edge, [*keys, "_chunk"], ["_far"])
    out = out.withColumns({new: F.coalesce(F.col("_near"), F.col("_far"))[old] for old, new in cols.items()})
    return out.drop("_chunk", "_near", "_far")


def last_seen(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Last non-null value at or before each row (as-of within the group)."""
    staged = df.withColumns({"_chunk": _chunk(F.col(order), chunk_rows), "_val": value})
    window = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumn("_near", F.last("_val", ignorenulls=True).over(window))
    edge = staged.groupBy(*keys, "_chunk").agg(
        F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col(order))).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*keys, "_chunk", F.last("_edge", ignorenulls=True).over(across).alias("_far"))
    joined = _attach(local, edge, [*keys, "_chunk"], ["_far"])
    return joined.withColumn(out, F.coalesce("_near", "_far")).drop("_chunk", "_val", "_near", "_far")
