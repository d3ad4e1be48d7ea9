"""Helpers of the training-data operators: word cutting on Arrow buffers, bounded slices, subword ids, components."""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe.session import written

SLICE_BYTES = 8 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def absent(docs: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as no column of ``docs`` starts with (in any case), so that helper columns never hide
    one of the table's own."""
    bar = "_"
    while any(c.lower() == (bar + n).lower() for c in docs.columns for n in names):
        bar += "_"
    return [bar + n for n in names]


def row_mark(docs: DataFrame, *columns: str) -> Column:
    """Text by which rows meet their verdict again: a SHA-256 of the columns' values, null told from empty."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """A 256-entry byte map: separators become blanks and, if asked for, A-Z become a-z. UTF-8 stays valid."""
    table = np.arange(256, dtype=np.uint8)
    table[np.frombuffer(separators, np.uint8)] = 32
    if lower:
        table[65:91] += 32
    return table


def blank_separated(lower: bool) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return byte_table(bytes([0x20, *range(0x09, 0x0E)]), lower)


def letter_words() -> np.ndarray:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased text (digits, a-z and all beyond ASCII)."""
    table = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)
    table[65:91] = np.arange(97, 123)
    return table


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0]:offs[-1]]


def cut_words(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of a string column as one binary array, and where each row's words start (length rows + 1)."""
    offs, raw = text_buffers(texts)
    data = table[raw]
    inside = data != 32
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    bounds = np.searchsorted(np.flatnonzero(start), offs)
    kept = data[inside]
    at = np.append(np.flatnonzero(start[inside]), len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(kept)])
    return words, bounds.astype(np.int64)


def encoded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds at most ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges ``start .. start + length - 1``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


HASH_BASE = 0x9E3779B97F4A7C15
HASH_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values: random numbers per byte, weighted by the powers of an odd base, and the length."""
    offs, raw = text_buffers(words)
    powers = np.cumprod(np.full(len(raw) + 1, HASH_BASE, np.uint64))
    inverse = np.cumprod(np.full(len(raw) + 1, pow(HASH_BASE, -1, 1 << 64), np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(HASH_BYTES[raw] * powers[:-1]))
    value = (sums[offs[1:]] - sums[offs[:-1]]) * inverse[offs[:-1]] + np.diff(offs).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return value ^ (value >> np.uint64(29))


class Subwords:
    """Subword ids of whole texts. The tokenizer's pre-tokens never cross a blank or line feed, so each distinct unit
    between those is encoded once. Ids of the first ``most`` units are kept, by the units' hashes; that only saves work."""

    def __init__(self, file: str, most: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.table = Tokenizer.from_file(file), most, byte_table(b" \n", False)
        self.keys, self.starts, self.sizes, self.store = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, ends of the rows)"""
        units, bounds = cut_words(texts, self.table)
        return self.expanded(*encoded(units), bounds)

    def expanded(self, codes: np.ndarray, distinct: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from units that are cut and coded already."""
        starts, sizes, store = self.units(distinct)
        sizes = sizes[codes]
        return store[gather(starts[codes], sizes)], np.append(0, np.cumsum(sizes))[bounds[1:]]

    def units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each unit are: starts and sizes in the returned ids."""
        hashes = word_hashes(distinct)
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        starts, sizes = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        missing = np.flatnonzero(~known)
        if not len(missing):
            return starts, sizes, self.store
        words, ids = distinct.take(pa.array(missing)).to_pylist(), [self.store]
        for a in range(0, len(words), 20_000):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[a:a + 20_000]], add_special_tokens=False)]
            sizes[missing[a:a + 20_000]] = [len(x) for x in coded]
            ids.append(np.fromiter(itertools.chain.from_iterable(coded), np.uint32))
        starts[missing] = len(self.store) + np.cumsum(sizes[missing]) - sizes[missing]
        store = np.concatenate(ids)
        if len(self.keys) + len(missing) <= self.most:
            order = missing[np.argsort(hashes[missing])]
            place = np.searchsorted(self.keys, hashes[order])
            self.keys, self.store = np.insert(self.keys, place, hashes[order]), store
            self.starts, self.sizes = np.insert(self.starts, place, starts[order]), np.insert(self.sizes, place, sizes[order])
        return starts, sizes, store


@functools.lru_cache(1)
def subwords(file: str) -> Subwords:
    """One per Python worker, so that its cache lasts from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Subwords(file)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component = the smallest node reachable), for nodes that
    have an edge. Alternating large-star and small-star rounds; each is a shuffle-only aggregate and join, so no node's
    neighbours meet in one task, and each round is written to the shared folder."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, seen = written(now, label), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(small.where("u <> v").distinct(), label)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
