import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ordered, skew


def sample(spark):
    rng = random.Random(3)
    rows = [(f"f{k}", i, rng.randint(0, 9), rng.choice([None, "a", "b"])) for k in range(3) for i in rng.sample(range(1, 200), 80)]
    return rows, spark.createDataFrame(rows, "k string, pos bigint, v int, tag string").repartition(5)


def test_running_sums_match_plain(spark):
    rows, df = sample(spark)
    got = {(r["k"], r["pos"]): (r["s"], r["rn"]) for r in ordered.running_sums(
        df, ["k"], ["pos"], {"s": F.col("v"), "rn": F.lit(1)}, chunk_rows=7).collect()}
    for key in {r[0] for r in rows}:
        total = 0
        for n, (_, pos, v, _) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            total += v
            assert got[key, pos] == (total, n)


def test_global_numbering(spark):
    rows, df = sample(spark)
    flat = df.select((F.col("pos") + F.when(F.col("k") == "f1", 1000).when(F.col("k") == "f2", 2000).otherwise(0)).alias("id"))
    got = [r["rn"] for r in ordered.numbered(flat, [], ["id"], "rn", chunk_rows=16).orderBy("id").collect()]
    assert got == list(range(1, len(rows) + 1))


def test_neighbours_across_chunks(spark):
    rows, df = sample(spark)
    nxt = {(r["k"], r["pos"]): r["n"] for r in ordered.neighbour(df, ["k"], "pos", {"v": "n"}, True, chunk_rows=4).collect()}
    prv = {(r["k"], r["pos"]): r["n"] for r in ordered.neighbour(df, ["k"], "pos", {"v": "n"}, False, chunk_rows=4).collect()}
    for key in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == key)
        for i, (_, pos, _, _) in enumerate(own):
            assert nxt[key, pos] == (own[i + 1][2] if i + 1 < len(own) else None)
            assert prv[key, pos] == (own[i - 1][2] if i else None)


def test_last_seen_across_chunks(spark):
    rows, df = sample(spark)
    got = {(r["k"], r["pos"]): r["seen"] for r in ordered.last_seen(df, ["k"], "pos", F.col("tag"), "seen", chunk_rows=3).collect()}
    for key in {r[0] for r in rows}:
        last = None
        for _, pos, _, tag in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            last = tag if tag is not None else last
            assert got[key, pos] == last


def scattered(spark):
    """One huge group with keys over all 64 bits, a cluster and stray keys far from it; many small groups; equal keys."""
    rng = random.Random(9)
    ids = {rng.randint(-2**63, 2**63 - 1) for _ in range(600)} | set(range(10**6, 10**6 + 900)) | {-2**63, 2**63 - 1}
    rows = [("big", i, 1) for i in ids] + [(f"s{k}", i, k) for k in range(200) for i in (5, 2**40, -7)] + [("same", 4, v) for v in range(300)]
    return rows, spark.createDataFrame(rows, "k string, id bigint, v int").repartition(5)


def test_chunks_follow_the_rows(spark):
    rows, df = scattered(spark)
    chunk = 50
    held = ordered.ranged(df, ["k"], "id", chunk).groupBy("k", "_chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("k", "_chunk").collect()
    assert sum(r["n"] for r in held) == len(rows)
    big = [r for r in held if r["k"] == "big"]
    assert len(held) - len(big) == 201 and len(big) <= 4 * sum(r["n"] for r in big) / chunk
    assert max(r["n"] for r in big) <= 2 * chunk
    assert all(x["b"] < y["a"] for x, y in zip(big, big[1:]))


def test_numbers_over_sparse_keys(spark):
    rows, df = scattered(spark)
    got = {(r["k"], r["id"], r["v"]): r["rn"] for r in ordered.numbered(df, ["k"], ["id", "v"], "rn", chunk_rows=50, sparse=True).collect()}
    for key in {r[0] for r in rows}:
        for n, row in enumerate(sorted(r for r in rows if r[0] == key), 1):
            assert got[row] == n
    whole = ordered.numbered(df, [], ["id", "k", "v"], "rn", chunk_rows=50, sparse=True).orderBy("rn").collect()
    assert [(r["id"], r["k"], r["v"]) for r in whole] == sorted((i, k, v) for k, i, v in rows)
    assert ordered.numbered(df.limit(0), ["k"], ["id"], "rn", sparse=True).collect() == []


def test_lookup_join_with_any_number_of_hot_keys(spark):
    """1,001 keys of equal weight, each far above the partition size at which adaptive execution calls it skewed."""
    big = spark.range(200_200).select("id", (F.col("id") % 1001).alias("key"))
    lookup = big.groupBy("key").agg(F.min("id").alias("first"))
    got = skew.lookup_join(big, lookup, ["key"], ["first"])
    assert got.filter("first = id % 1001").count() == 200_200


@pytest.mark.parametrize("chunk_rows", [1000, 8])
def test_sorts_hold_a_bounded_number_of_rows(spark, monkeypatch, chunk_rows):
    """The rows of many groups, or of the chunks of large ones, are sorted in tasks of about TASK_ROWS rows, dealt out once."""
    monkeypatch.setattr(ordered, "TASK_ROWS", 100, raising=False)
    rows = [(k, i * 7 % 40, i) for k in range(100) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, pos bigint, v int").repartition(3)
    got = ordered.numbered(df, ["k"], ["pos"], chunk_rows=chunk_rows, sparse=True).withColumn("task", F.spark_partition_id())
    assert max(r["count"] for r in got.groupBy("task").count().collect()) <= 400
    assert {(r["k"], r["pos"], r["rn"]) for r in got.collect()} == {(k, p, p + 1) for k, p, _ in rows}
