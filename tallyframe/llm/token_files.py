"""Token files: Parquet with one row per document in ascending id order and its subword ids as a list column.

Ids are dictionary or delta coded; row groups and pages have a controlled size, and the page indexes that Parquet's writer
adds let a reader skip to the rows and columns it needs - counts and positions without the tokens, tokens of a few documents
without the rest. Order is by range partitions; positions come from per-file sums, so no task sees more than its range.

Defined cases: a null text is empty and holds only the end id; null ids come first; equal ids are ordered by text; equal
rows stand beside each other; an empty table gives files without rows; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyframe.llm.common import field, slices, subwords
from tallyframe.session import written

END, GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 2, 32 << 20, 1 << 20, 2_000
ROWS = "doc_id long, part int, place long, n_tokens long, tokens array<int>"


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Rows of ``ROWS`` in ascending id order: range partition, place in it, and the ids with the end id."""
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    tie = F.xxhash64(F.col("_text"))
    rows = rows.repartitionByRange(F.col("_id"), tie).sortWithinPartitions("_id", tie)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, place = subwords(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "_text", 6 << 20):
            ids, ends = coder.encode(field(batch, "_text"))
            n = batch.num_rows
            sizes = np.diff(ends, prepend=0) + 1
            out = np.insert(ids.astype(np.int32), ends, end)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([field(batch, "_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(sizes.astype(np.int64)), lists],
                                             names=["doc_id", "part", "place", "n_tokens", "tokens"])
            place += n

    return rows.mapInArrow(encode, ROWS)


def write(tokens: DataFrame, path: str, coding: str = "dictionary", group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes token rows. ``coding``: "dictionary" or "delta" (delta binary packing of the ids)."""
    if coding not in ("dictionary", "delta"):
        raise ValueError(coding)
    out = tokens.write.option("parquet.block.size", group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    out = out.option("parquet.enable.dictionary", str(coding == "dictionary").lower()).option("parquet.dictionary.page.size", 1 << 20).option("compression", "zstd")
    if coding == "delta":
        out = out.option("parquet.writer.version", "v2")
    out.parquet(path)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(path)


def positions(files: DataFrame, *more: str) -> DataFrame:
    """(part, place, doc_id, n_tokens, start, more) from the metadata columns alone."""
    meta = files.select("part", "place", "doc_id", "n_tokens", *more)
    sums = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a file
    offsets = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_offset"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    return meta.withColumn("_within", within).join(offsets, "part").select("part", "place", "doc_id", "n_tokens", (F.col("_offset") + F.col("_within")).alias("start"), *more)


def tokens_of(files: DataFrame, ids: list[int]) -> DataFrame:
    """The token rows of a few documents; the filter reaches the page index."""
    return files.where(F.col("doc_id").isin(ids)).select("doc_id", "tokens")


def token_range(files: DataFrame, start: int, end: int) -> DataFrame:
    """(doc_id, from, tokens): the stretch ``start .. end - 1`` of the whole id stream, per document."""
    found = positions(files).where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start))
    rows = found.join(files.select("part", "place", "tokens"), ["part", "place"])
    first = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    count = F.least(F.lit(end), F.col("start") + F.col("n_tokens")) - F.greatest(F.lit(start), F.col("start"))
    return rows.select("doc_id", (F.col("start") + first).alias("from"), F.slice("tokens", (first + 1).cast("int"), count.cast("int")).alias("tokens"))


def checksums(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document as read from the files. Tokens stay in the reading task; only
    counts and checksums go on to the positions."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = field(batch, "tokens")
            ends = lists.offsets.to_numpy()
            view = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crcs = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([field(batch, "doc_id"), field(batch, "part"), field(batch, "place"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
                                             names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    read = files.select("doc_id", "part", "place", "tokens").mapInArrow(digest, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return positions(written(read, "token-checksums"), "ids_crc32").select("doc_id", "start", "n_tokens", "ids_crc32")
