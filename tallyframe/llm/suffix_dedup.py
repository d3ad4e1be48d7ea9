"""Removal of repeated byte strings by a column-wise multi-document Burrows-Wheeler construction.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or earlier
in its own. Strings are judged on the input.

1. Every document is cut into pieces: runs of consecutive windows of ``length`` bytes with the same minimizer (the smallest
   hashed ``MER``-gram in the window). Equal windows have equal minimizers at equal places, so they fall into pieces of the
   same minimizer and, aligned at it, start in the same column.
2. Pieces are dealt by (minimizer, content) in ranges. Of equal pieces only the earliest can hold a first occurrence; all
   others go whole. Where one minimizer has several distinct pieces, the earliest of each take part in step 3.
3. The construction: the pieces of a bounded block of groups, aligned in columns, get one symbol each per round, right to
   left. A round sorts the suffixes that start in its column from the order of the round before (stable, by the new symbol)
   and carries the column up to which neighbours agree, the minima between them being taken over. Columns, order and
   agreement are files that are read and written front to back, one column a round. Neighbours that agree over ``length``
   columns are equal windows; all but the earliest of a run of them are marked.
   A group too large for a block is split by content; its classes are then merged by content hash with a partial aggregate.
4. Marked windows and whole pieces meet their document and are merged into removed runs.

Defined cases: null is empty; texts shorter than ``length`` lose nothing; equal ids are ordered by text hash (equal rows by
an arbitrary but fixed row number), a null id comes first; very long texts are cut into stretches that overlap by ``length - 1``
bytes; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import field, gather, slices, text_buffers
from tallyframe.session import dropped, scratch_path, written

LENGTH, MER = 100, 30
STRETCH, RUN, GROUP, BLOCK, PLACE_BITS = 1 << 21, 1 << 17, 4096, 30_000, 24
BASE = np.uint64(0x9E3779B97F4A7C15)


def hashed_mers(raw: np.ndarray, mer: int) -> np.ndarray:
    """A hash of each ``mer`` bytes, from a few shifted sums: doubling the width of the hashed stretch."""
    def mix(x):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    value, width = (raw.astype(np.uint64) + np.uint64(1)) * BASE, 1
    value ^= value >> np.uint64(31)
    while width < mer:
        step = min(width, mer - width)
        value = mix(value[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + value[step:])
        width += step
    return value


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def pieces(raw: np.ndarray, ends: np.ndarray, length: int, mer: int) -> tuple[np.ndarray, ...]:
    """(row, start in row, bytes, minimizer's place in the piece, minimizer hash, content hash) of all pieces of the rows that
    end at ``ends``."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64))
    if len(raw) < length:
        return none
    mers = hashed_mers(raw, mer)
    bits = np.uint64(PLACE_BITS)
    if len(raw) >> PLACE_BITS:
        raise ValueError("a stretch is too long")
    # the smallest hash, of equal ones the first: the place fills the low bits
    packed = (mers >> bits << bits) | np.arange(len(mers), dtype=np.uint64)
    least = sliding_least(packed, length - mer + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    place = least.astype(np.int64)
    at = np.arange(len(place))
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    whole = row[at] == row[at + length - 1]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (place[1:] != place[:-1]) | (row[at[1:]] != row[at[:-1]])
    start = np.flatnonzero(first)
    if not len(start):
        return none
    last = np.flatnonzero(np.append((~whole[1:]) | first[1:], True) & whole)
    size = (last - start + length).astype(np.int32)
    # content hash of a piece: a polynomial sum of its bytes' prefix sums, mixed with its size
    weight = np.cumprod(np.full(len(raw), BASE | np.uint64(1), np.uint64))
    sums = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * weight))
    inverse = np.cumprod(np.full(len(raw), np.uint64(pow(int(BASE | np.uint64(1)), -1, 1 << 64)), np.uint64))
    content = ((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
    content ^= content >> np.uint64(32)
    begin = np.append(0, ends[:-1])[row[start]]
    return row[start], start - begin, size, (place[start] - start).astype(np.int32), mers[place[start]].astype(np.int64), content.astype(np.int64)


PIECE = "mini long, content long, doc long, start long, size int, anchor int, local boolean"


def cut(docs: DataFrame, length: int, mer: int) -> DataFrame:
    """Pieces of the rows (_doc, _text). Of equal pieces of one slice only the earliest goes on to the groups; the later ones
    are already known to go (``local``) and carry a minimizer of their own, so that they are dealt evenly."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", STRETCH):
            ids = field(part, "_doc").to_numpy()
            for row, start, size, anchor, mini, content in stretches(part, length, mer):
                order = np.lexsort((start, ids[row], content, mini))
                row, start, size, anchor, mini, content = (x[order] for x in (row, start, size, anchor, mini, content))
                local = np.zeros(len(row), bool)
                local[1:] = (mini[1:] == mini[:-1]) & (content[1:] == content[:-1])
                spread = np.where(local, (start.astype(np.uint64) * BASE + ids[row].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.int64), mini)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (spread, content, ids[row], start, size, anchor, local)], names=["mini", "content", "doc", "start", "size", "anchor", "local"])

    return docs.mapInArrow(work, PIECE)


def stretches(part: pa.RecordBatch, length: int, mer: int) -> Iterator[tuple]:
    """Pieces of a slice; a row longer than a stretch is cut with an overlap, so that each window is in one stretch."""
    offs, raw = text_buffers(field(part, "_text"))
    if part.num_rows > 1 or len(raw) <= 2 * STRETCH:
        found = []  # a few rows at a time: the arrays of a run take some hundred times its bytes
        bounds = np.unique(np.append(np.searchsorted(offs, np.arange(0, len(raw), RUN)), part.num_rows))
        for a, b in zip(bounds[:-1], bounds[1:]):
            row, *rest = pieces(raw[offs[a]:offs[b]], offs[a + 1:b + 1] - offs[a], length, mer)
            found.append((row + a, *rest))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))
        return
    for at in range(0, len(raw), STRETCH):
        piece = raw[at:at + STRETCH + length - 1]
        row, start, *rest = pieces(piece, np.array([len(piece)]), length, mer)
        yield row, start + at, *rest


def sifted(dealt: DataFrame) -> DataFrame:
    """(doc, start, size, anchor, mini, content, whole): of each partition sorted by (mini, content, doc, start) the pieces
    that go whole, and the earliest of each content where a minimizer has several contents. The first and last minimizer of
    a partition may go on in a neighbour and count as several."""
    schema = "doc long, start long, size int, anchor int, mini long, content long, whole boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first_mini, last_mini, last_content, last_mixed = None, None, None, None, False
        names = ["doc", "start", "size", "anchor", "mini", "content"]

        def out(rows: dict, keep: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(rows[n][keep]) for n in names], pa.array(whole[keep])], names=[*names, "whole"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: field(batch, n).to_numpy() for n in names}
            local = field(batch, "local").to_numpy(zero_copy_only=False)
            if local.any():
                yield out(rows, local, local)
                rows = {n: v[~local] for n, v in rows.items()}
            mini, content = rows["mini"], rows["content"]
            if not len(mini):
                continue
            if first_mini is None:
                first_mini = mini[0]
            group = np.append(last_mini is None or mini[0] != last_mini, mini[1:] != mini[:-1])
            fresh = group | np.append(content[0] != last_content, content[1:] != content[:-1])
            number = np.cumsum(group)
            several = np.bincount(number, fresh, minlength=number[-1] + 1) - (np.arange(number[-1] + 1) > 0) > 0  # group 0 goes on from before
            several[number[mini == first_mini]] = True
            if not group[0] and last_mixed:
                several[0] = True
            if held is not None:
                if not group[0] and several[0]:
                    yield held
                    held = None
                elif group[0]:
                    held = None
            whole = ~fresh
            mixed = several[number]
            yield out(rows, whole | (fresh & mixed), whole)
            if number[-1] > 0 and not group[0]:
                held = None
            end = number == number[-1]
            if group[end].any() and not mixed[-1]:
                at = np.flatnonzero(end & fresh)
                held = out(rows, at[:1], whole)
            last_mini, last_content, last_mixed = mini[-1], content[-1], bool(mixed[-1])
        if held is not None:
            yield held

    return dealt.mapInArrow(work, schema)


class Columns:
    """The construction over a block of aligned pieces: see the module's step 3. ``text``: the pieces' bytes one after the
    other; ``group``: their group; ``left``: column of their first byte; ``size``: bytes."""

    def __init__(self, text: np.ndarray, group: np.ndarray, left: np.ndarray, size: np.ndarray, folder: str):
        self.group, self.left, self.right, self.folder, self.n = group, left, left + size, folder, len(group)
        self.width = int(self.right.max())
        ends = np.cumsum(size)
        row = np.repeat(np.arange(self.n), size)
        column = np.arange(len(text)) - np.repeat(ends - size - left, size)
        order = np.argsort(column, kind="stable")  # one column after the other, as the rounds read them, from the last on
        self.starts = np.searchsorted(column[order], np.arange(self.width + 1))
        text[order].tofile(os.path.join(folder, "symbols"))
        row[order].astype(np.int32).tofile(os.path.join(folder, "rows"))

    def column(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        a, n = int(self.starts[j]), int(self.starts[j + 1] - self.starts[j])
        return (np.fromfile(os.path.join(self.folder, "rows"), np.int32, n, offset=4 * a), np.fromfile(os.path.join(self.folder, "symbols"), np.uint8, n, offset=a))

    def rounds(self, length: int, lowest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each column from the last to ``lowest``: the rows that have a symbol there in the order of their suffixes, and
        whether each equals the one before it over ``length`` columns."""
        with open(os.path.join(self.folder, "order"), "w+b", 0) as order_file, open(os.path.join(self.folder, "agree"), "w+b", 0) as agree_file:
            yield from self._rounds(length, lowest, order_file, agree_file)

    def _rounds(self, length: int, lowest: int, order_file: io.FileIO, agree_file: io.FileIO) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        symbol = np.zeros(self.n, np.int64)
        n = 0
        for j in range(self.width - 1, lowest - 1, -1):
            rows, symbols = self.column(j)
            symbol[rows] = symbols
            order, agree = (np.frombuffer(os.pread(f.fileno(), 4 * n, 0), np.int32) for f in (order_file, agree_file))
            fresh = rows[self.right[rows] == j + 1]  # their suffix behind this column is empty: first in their group
            if len(order):
                ongoing = self.left[order] <= j
                if not ongoing.all():  # a row whose first byte was reached leaves; its neighbours agree as far as both did with it
                    runs = np.cumsum(ongoing)
                    low = np.full(runs[-1] + 1, np.iinfo(np.int32).max, np.int32)
                    np.minimum.at(low, np.where(ongoing, runs - 1, runs), agree)
                    order, agree = order[ongoing], low[:runs[-1]]
            both = np.concatenate([fresh, order])
            level = np.concatenate([np.full(len(fresh), j + 1, np.int32), agree])
            level[:len(fresh) + 1] = np.minimum(level[:len(fresh) + 1], j + 1)
            by_group = np.argsort(self.group[both], kind="stable")
            both, level = both[by_group], level[by_group]
            group = self.group[both]
            new_group = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
            # rows that were merged in front of a group make its old first row a neighbour that agrees on nothing
            entered = self.right[both] == j + 1
            level[np.flatnonzero(entered[:-1] & ~entered[1:]) + 1] = j + 1
            level[entered] = j + 1
            key = group * 256 + symbol[both]
            after = np.argsort(key, kind="stable")
            order = both[after]
            same = np.append(False, key[after][1:] == key[after][:-1])
            level[new_group] = j + 1
            agree = np.full(len(order), j, np.int32)
            at = np.flatnonzero(same)
            if len(at):
                agree[at] = range_least(level, after[at - 1] + 1, after[at] + 1)
            # written over what was there: a file cut to nothing and filled again is sent to the disk by each close
            n = len(order)
            for f, values in ((order_file, order), (agree_file, agree)):
                rewrite(f, values.astype(np.int32))
            yield order, same & (agree >= j + length)


def rewrite(file: io.FileIO, values: np.ndarray) -> None:
    """The file's first bytes become those of ``values``."""
    data = memoryview(values.tobytes())
    file.seek(0)
    while len(data):
        data = data[file.write(data):]


def range_least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of x[a:b] for each pair, a < b: most ranges are one long, the others come from a table of doubling widths."""
    out = x[a].copy()
    wide = np.flatnonzero(b - a > 1)
    if len(wide):
        size = (b - a)[wide]
        power = np.frexp(size.astype(float))[1] - 1
        table = x
        for p in range(int(power.max()) + 1):
            if p:
                table = np.minimum(table[:-(1 << (p - 1))], table[(1 << (p - 1)):])
            use = wide[power == p]
            out[use] = np.minimum(table[a[use]], table[b[use] - (1 << p)])
    return out


def marked(rows: pd.DataFrame, length: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """For a block of pieces (mini, salt, salts, doc, start, size, anchor, bytes): windows that go, as (doc, start, size), and
    for groups that were split the earliest window of each class, as (mini, one, two, doc, start)."""
    rows = rows.sort_values(["mini", "salt"], kind="stable").reset_index(drop=True)
    group = (rows[["mini", "salt"]].ne(rows[["mini", "salt"]].shift()).any(axis=1)).cumsum().to_numpy(np.int64)
    top = int(rows["anchor"].max())
    left, size = (top - rows["anchor"]).to_numpy(np.int64), rows["size"].to_numpy(np.int64)
    doc, start, salts, mini = (rows[c].to_numpy(np.int64) for c in ("doc", "start", "salts", "mini"))
    place = np.empty(len(rows), np.int64)
    place[np.lexsort((start - left, doc))] = np.arange(len(rows))  # same column: earlier piece, earlier window
    text = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
    begin = np.cumsum(size) - size
    gone, classes, split = [], [], bool((salts > 1).any())
    folder = tempfile.mkdtemp(prefix="columns-")
    try:
        block = Columns(text, group, left, size, folder)
        j = block.width
        for order, equal in block.rounds(length, int(left.min())):
            j -= 1
            if j + length > block.width or not equal.any() and not split:
                continue
            full = block.right[order] >= j + length
            run = np.cumsum(~equal) - 1
            best = np.minimum.reduceat(place[order], np.flatnonzero(~equal))
            late = (place[order] != best[run]) & full
            if late.any():
                r = order[late]
                gone.append((r, np.full(len(r), j)))
            head = order[full & ~late & (salts[order] > 1)]
            if len(head):
                digests = np.frombuffer(b"".join(hashlib.blake2b(text[begin[r] + j - left[r]:begin[r] + j - left[r] + length].tobytes(), digest_size=16).digest() for r in head.tolist()), np.int64).reshape(-1, 2)
                classes.append(pd.DataFrame({"mini": mini[head], "one": digests[:, 0], "two": digests[:, 1], "doc": doc[head], "start": start[head] + j - left[head]}))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    if gone:
        r, c = (np.concatenate([g[i] for g in gone]) for i in (0, 1))
        order = np.lexsort((c, r))
        r, c = r[order], c[order]
        at = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)))
        last = np.append(at[1:], len(r)) - 1
        spans = pd.DataFrame({"doc": doc[r[at]], "start": start[r[at]] + c[at] - left[r[at]], "size": c[last] - c[at] + length})
    else:
        spans = pd.DataFrame({"doc": [], "start": [], "size": []}).astype("int64")
    empty = pd.DataFrame({k: np.zeros(0, np.int64) for k in ("mini", "one", "two", "doc", "start")})
    return spans, pd.concat([empty, *classes])


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_doc, _id, _text): _doc is unique and ascends with the id. Where ids are null or repeated, rows are numbered in order of
    (id, text hash) by range partitions."""
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    twice = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 OR _id IS NULL")
    if twice.isEmpty():
        return rows.withColumn("_doc", F.col("_id"))
    tie = F.xxhash64("_text")
    ordered = rows.repartitionByRange(F.col("_id"), tie).sortWithinPartitions("_id", tie)
    # the number's upper part is the range partition; written, so that it stays as it is
    return written(ordered.withColumn("_doc", F.monotonically_increasing_id()), "repeats-numbered")


def spans_of(rows: DataFrame, length: int, mer: int) -> DataFrame:
    """(doc, start, size): stretches that go, overlapping ones as they were found."""
    # written, as the ranges come from a pass of their own over the pieces
    path = scratch_path(rows.sparkSession, "repeats-cut")
    cut(rows.select("_doc", "_text"), length, mer).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path).repartitionByRange("mini", "content").sortWithinPartitions("mini", "content", "doc", "start")
    found = written(sifted(dealt), "repeats-pieces")
    dropped(rows.sparkSession, path)
    several = found.where("NOT whole").drop("whole")
    sizes = several.groupBy("mini").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("mini", F.ceil(F.col("k") / GROUP).cast("int").alias("salts"))
    several = written(several.join(sizes, "mini"), "repeats-several")
    blocks = -(-several.count() // BLOCK) or 1
    own = several.groupBy("doc").agg(F.collect_list(F.struct("mini", F.pmod(F.col("content"), F.col("salts")).alias("salt"), "salts", "start", "size", "anchor")).alias("own"))
    cut_out = rows.select(F.col("_doc").alias("doc"), F.encode("_text", "UTF-8").alias("_body")).join(own, "doc").select("doc", "_body", F.explode("own").alias("p"))
    cut_out = cut_out.select("p.mini", "p.salt", "p.salts", "doc", "p.start", "p.size", "p.anchor", F.expr("substring(_body, cast(p.start + 1 AS int), p.size)").alias("bytes"))
    cut_out = cut_out.withColumn("block", F.pmod(F.xxhash64("mini", "salt"), F.lit(blocks)))

    def construct(rows: pd.DataFrame) -> pd.DataFrame:
        spans, classes = marked(rows, length)
        return pd.concat([spans.assign(mini=0, one=0, two=0, head=False), classes.assign(size=length, head=True)])[["doc", "start", "size", "mini", "one", "two", "head"]].astype({"head": bool})

    made = written(cut_out.groupBy("block").applyInPandas(construct, "doc long, start long, size long, mini long, one long, two long, head boolean"), "repeats-spans")
    heads = made.where("head")
    first = heads.groupBy("mini", "one", "two").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    late = heads.join(first, ["mini", "one", "two"]).where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return found.where("whole").select("doc", "start", F.col("size").cast("long").alias("size")).union(made.where("NOT head").select("doc", "start", "size")).union(late.select("doc", "start", "size"))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, mer: int = MER, texts: bool = False) -> DataFrame:
    """One row per document: (key, n_bytes, n_removed, n_spans, kept_sha256), with ``texts`` also the kept bytes."""
    rows = keyed(docs, key, text)
    spans = spans_of(rows, length, mer).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "size")).alias("_gone"))
    both = rows.join(spans, "_doc", "left").select("_id", "_text", F.col("_gone.start").alias("_start"), F.col("_gone.size").alias("_size"))
    schema = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 8 << 20):
            offs, raw = text_buffers(field(part, "_text"))
            starts, sizes = field(part, "_start"), field(part, "_size")
            lists = starts.value_lengths().fill_null(0).to_numpy()
            first, size = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, sizes))
            gone = np.zeros(len(raw) + 1, bool)
            gone[gather(np.repeat(offs[:-1], lists) + first, size)] = True
            gone[-1] = False
            begins = gone[:-1].copy()
            inner = np.ones(len(raw), bool)
            inner[offs[:-1][offs[:-1] < len(raw)]] = False
            begins[1:] &= ~(gone[:-2] & inner[1:])
            count, runs = (np.diff(np.append(0, np.cumsum(x))[offs]) for x in (gone[:-1], begins))
            kept = [raw[a:b][~gone[a:b]].tobytes() if n else raw[a:b].tobytes() for a, b, n in zip(offs[:-1], offs[1:], count)]
            columns = [field(part, "_id"), pa.array(np.diff(offs)), pa.array(count.astype(np.int64)), pa.array(runs.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(take, schema)
