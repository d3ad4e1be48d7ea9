"""Record structure of files: transitions, ordering, batch pattern, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyframe.functions import fixed
from tallyframe.operators import ordered


def sequence(lines: DataFrame, record_types: Sequence[str]) -> DataFrame:
    """Lines of known record types (padding and unknown lines dropped)."""
    kind = fixed.classify(F.col("line"), record_types, "9" * 94)
    return lines.withColumn("record_type", kind).filter("record_type <> 'padding'").select("file_id", "line_no", "record_type")


def successors(seq: DataFrame) -> DataFrame:
    """The record type that follows each record (null at the end of the file)."""
    return ordered.neighbour(seq, ["file_id"], "line_no", {"record_type": "next_type"}, forward=True)


def frequencies(seq: DataFrame) -> DataFrame:
    """Records per type, first position, and whether the type repeats."""
    return seq.groupBy("file_id", "record_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")).withColumn("repeating", F.col("n") > 1)


def transition_matrix(seq: DataFrame) -> DataFrame:
    """(from, to, n) per file, with the first place the transition occurs."""
    return successors(seq).filter("next_type is not null").groupBy(
        "file_id", F.col("record_type").alias("from_type"), F.col("next_type").alias("to_type")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


def start_types(seq: DataFrame) -> DataFrame:
    """Most common type within the first max(1, n/10) records; ties go to the one seen first."""
    totals = seq.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"))
    numbered = ordered.numbered(seq, ["file_id"], ["line_no"], "rn", per_group=totals)
    head = numbered.filter("rn <= greatest(1, total div 10)").groupBy("file_id", "record_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    return head.groupBy("file_id").agg(F.expr("max_by(record_type, struct(n, -first_line)) as start_type"))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy walk over one file's matrix (at most types x types rows): from the start type to the most frequent
    successor not yet visited; types left over follow by frequency."""
    start = rows["start_type"].iloc[0]
    edges = rows.dropna(subset=["to_type"]).sort_values(["n", "first_line"], ascending=[False, True])
    path, node = [], start
    while node is not None:
        path.append(node)
        open_edges = edges[(edges["from_type"] == node) & ~edges["to_type"].isin(path)]
        node = open_edges["to_type"].iloc[0] if len(open_edges) else None
    counts = rows.drop_duplicates("from_type").set_index("from_type")["type_n"]
    rest = sorted((t for t in counts.index if t not in path), key=lambda t: (-counts[t], t))
    return pd.DataFrame({"file_id": rows["file_id"].iloc[0], "record_type": path + rest,
                         "position": range(len(path) + len(rest))})


def inferred_ordering(seq: DataFrame) -> DataFrame:
    """(file_id, record_type, position) by the greedy walk. The grouped input is the aggregated matrix, whose size per
    file is bounded by the square of the number of record types."""
    matrix = transition_matrix(seq)
    types = frequencies(seq).select("file_id", F.col("record_type").alias("from_type"), F.col("n").alias("type_n"))
    rows = types.join(matrix, ["file_id", "from_type"], "left").join(start_types(seq), "file_id")
    return rows.groupBy("file_id").applyInPandas(_walk, "file_id string, record_type string, position int")


def batch_pattern(seq: DataFrame, header: str, trailer: str) -> DataFrame:
    """Distinct types from the first batch header to the first trailer behind it, in first-seen order."""
    opened = seq.filter(F.col("record_type") == header).groupBy("file_id").agg(F.min("line_no").alias("opened"))
    closed = seq.filter(F.col("record_type") == trailer).join(opened, "file_id").filter("line_no >= opened") \
        .groupBy("file_id", "opened").agg(F.min("line_no").alias("closed"))
    placed = ordered.numbered(seq, ["file_id"], ["line_no"], "rn", per_group=closed)
    seen = placed.filter("line_no between opened and closed").groupBy("file_id", "record_type").agg(
        F.min("line_no").alias("first_line"))
    return seen.groupBy("file_id").agg(F.expr(
        "array_join(transform(sort_array(collect_list(struct(first_line, record_type))), x -> x.record_type), ',') as pattern"))


def out_of_order(seq: DataFrame, ordering: Sequence[str], restart: str | None = None) -> DataFrame:
    """Records whose place in the expected ordering is lower than that of the known record before them. With
    ``restart`` (a batch header) the order starts anew there; without it every second batch is reported."""
    place = F.expr("case record_type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(ordering)) + " end")
    known = seq.withColumn("place", place).filter("place is not null")
    paired = ordered.neighbour(known, ["file_id"], "line_no", {"place": "previous"}, forward=False)
    wrong = paired.filter("place < previous")
    return wrong if restart is None else wrong.filter(F.col("record_type") != restart)


def repeated_headers(seq: DataFrame, headers: Sequence[str]) -> DataFrame:
    return seq.filter(F.col("record_type").isin(*headers)).groupBy("file_id", "record_type").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1")
