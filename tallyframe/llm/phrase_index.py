"""Benchmark decontamination on a distributed positional inverted index.

The corpus index is a table of segments: a segment covers a bounded run of whole documents and has one row per term with
the sorted positions of that term (delta coded), and one directory row with its documents. Building it moves nothing
between tasks. The test items get an index of the same kind (term -> item, place). Both meet by a join on the term; the
terms of one segment and one block of items then form a bounded group in which offset-adjusted position lists are
intersected from the rarest term on. Exact phrases and proximity (at most ``slop`` foreign words between neighbours, same
order) are answered the same way; only windows that a walk from their rarest term's positions covers are read in full, and of their
other terms only the positions that the walk came by.

Defined cases: null or wordless texts have no positions, hits or items; an item shorter than the window is one window;
repeated documents are rows of their own, repeated equal items count once; a null item id counts as an empty string; empty
tables give rows without hits, or no rows; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.common import absent, cut_words, encoded, field, gather, letter_words, row_mark, slices
from tallyframe.session import scratch_path, written

WINDOW, SEGMENT_BYTES, BLOCK_WORDS, BROADCAST_WORDS = 13, 12 << 20, 200_000, 100_000
INDEX = "segment long, term binary, n int, positions binary, keys array<string>, words array<long>"
HIT = "segment long, item string, position long, length int"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``docs``, written to the shared folder. Rows with a term are postings, those without are directories:
    the keys (as strings) and word counts of the segment's documents in order of position."""
    rows = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).cast("string").alias("_text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task, made = letter_words(), TaskContext.get().partitionId(), 0
        schema = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("n", pa.int32()), ("positions", pa.binary()), ("keys", pa.list_(pa.string())), ("words", pa.list_(pa.int64()))])
        for part in slices(batches, "_text", SEGMENT_BYTES):
            segment = (task << 32) + made
            made += 1
            words, bounds = cut_words(field(part, "_text"), table)
            counts = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([None], pa.binary()), pa.array([0], pa.int32()), pa.array([None], pa.binary()),
                                              pa.array([field(part, "_key").to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], schema=schema)
            if not len(words):
                continue
            codes, terms = encoded(words)
            order = np.argsort(codes, kind="stable").astype(np.int32)
            sizes = np.bincount(codes, minlength=len(terms))
            first = np.cumsum(sizes) - sizes
            deltas = np.diff(order, prepend=np.int32(0))
            deltas[first] = order[first]
            ends = np.append(0, np.cumsum(sizes) * 4).astype(np.int32)
            lists = pa.BinaryArray.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(ends), pa.py_buffer(deltas)])
            step = 50_000
            for at in range(0, len(terms), step):
                n = min(step, len(terms) - at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, segment)), terms.slice(at, n).cast(pa.binary()), pa.array(sizes[at:at + n].astype(np.int32)),
                                                  lists.slice(at, n), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)

    path = scratch_path(docs.sparkSession, "phrase-index")
    rows.mapInArrow(index, INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """The items' own postings: (block, term, uses of (hash of the item row, item, place, words of the item))."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))
    rows = written(rows.where(F.size("words") > 0).distinct(), "phrase-items")
    total = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS) or 1
    hashed = F.xxhash64("item", F.array_join("words", " "))
    uses = rows.select(F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"), hashed.alias("row"), "item", F.size("words").alias("length"), F.posexplode("words").alias("place", "word"))
    terms = uses.groupBy("block", F.encode("word", "UTF-8").alias("term")).agg(F.collect_list(F.struct("row", "item", "place", "length")).alias("uses"))
    terms = written(terms, "phrase-terms")
    return F.broadcast(terms) if total <= BROADCAST_WORDS else terms


def spans(lists: list[np.ndarray], slop: int, rarest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of the rarest term, or of that at the given place, from which the whole sequence can be read, with at most ``slop`` foreign words between
    neighbours; position of its first word; of its last). Each word takes the nearest place from which the rest can be read,
    so no other reading has a later first word or an earlier last one: if this one reaches into another document, all do."""
    rarest = min(range(len(lists)), key=lambda i: len(lists[i])) if rarest is None else rarest
    alive = np.ones(len(lists[rarest]), bool)
    ends = {1: lists[rarest], -1: lists[rarest]}
    for side in (1, -1):
        chain = range(rarest + 1, len(lists)) if side > 0 else range(rarest - 1, -1, -1)
        # walk to the end of the chain and back: a position stays if its next one is reachable and stays
        path = [rarest, *chain]
        good, reach = np.ones(len(lists[path[-1]]), bool), lists[path[-1]]
        for here, there in zip(path[-2::-1], path[:0:-1]):
            target, far = (lists[there], reach) if good.all() else (lists[there][good], reach[good])
            if not len(target):
                return lists[rarest][:0], lists[rarest][:0], lists[rarest][:0]
            at = target.searchsorted(lists[here], "right") if side > 0 else target.searchsorted(lists[here], "left") - 1
            gap = (target.take(at, mode="clip") - lists[here]) * side  # none beyond the ends: these are not on this side
            good = (gap > 0) & (gap <= slop + 1)
            reach = far.take(at, mode="clip")
        alive &= good
        ends[side] = reach
    return lists[rarest][alive], ends[-1][alive], ends[1][alive]


def near(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Positions of the rarest term in ``spans``."""
    return spans(lists, slop)[0]


def exact(lists: list[np.ndarray]) -> np.ndarray:
    """Start positions at which the lists follow each other directly, from the rarest list on."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    starts = lists[order[0]] - order[0]
    for i in order[1:]:
        here = starts + i
        starts = starts[lists[i].take(lists[i].searchsorted(here), mode="clip") == here]
        if not len(starts):
            break
    return starts


def reached(lists: list[np.ndarray], at: int, step: int, most: int, slop: int) -> list[np.ndarray]:
    """The positions that a chain from any position of ``lists[at]`` comes by, list after list in one direction (``step`` 1 or -1): at most
    ``most`` lists, up to the first without any."""
    out, here = [], lists[at]
    while len(out) < most and 0 <= at + step * (len(out) + 1) < len(lists):
        there = lists[at + step * (len(out) + 1)]
        beside = (here[:, None] + step * np.arange(1, slop + 2)).ravel() if slop else here + step
        here = beside[there.take(there.searchsorted(beside), mode="clip") == beside]
        if not len(here):
            break
        if slop and len(here) > 1:
            here = np.unique(here)
        out.append(here)
    return out


def candidates(lists: list[np.ndarray], need: int, slop: int) -> Iterator[tuple[list[np.ndarray], int]]:
    """(lists, place of the rarest) of the windows of ``need`` lists that may be read. Windows that slide over the same rarest term share
    the walk from its positions, which mostly ends after a few words. No reading through the rarest term has other positions than
    the walk came by, and each of them keeps all that follow it, so the other lists are cut to these."""
    known: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    sizes = [len(x) for x in lists]
    for s in range(len(lists) - need + 1):
        rarest = min(range(s, s + need), key=sizes.__getitem__)
        if rarest not in known:
            known[rarest] = reached(lists, rarest, -1, need - 1, slop), reached(lists, rarest, 1, need - 1, slop)
        left, right = known[rarest]
        before, after = rarest - s, s + need - 1 - rarest
        if before <= len(left) and after <= len(right):
            yield [*left[:before][::-1], lists[rarest], *right[:after]], before


def matcher(window: int, slop: int):
    def match(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """All occurrences of the block's windows in one segment."""
        lists = [np.cumsum(np.frombuffer(x, np.int32), dtype=np.int64) for x in group["positions"]]
        uses = [(u["row"], u["place"], u["length"], i, u["item"]) for i, us in enumerate(group["uses"]) for u in us]
        uses.sort(key=lambda u: u[:2])
        found, at = [], 0
        while at < len(uses):
            end = at + 1
            while end < len(uses) and uses[end][0] == uses[at][0] and uses[end][1] == uses[end - 1][1] + 1:
                end += 1
            need = min(window, uses[at][2])  # only unbroken runs of an item's words can hold a window
            row = [lists[uses[k][3]] for k in range(at, end)]
            for run, rarest in candidates(row, need, slop):
                if slop:
                    _, first, last = spans(run, slop, rarest)
                else:
                    first = exact(run)
                    last = first + need - 1
                if len(first):
                    found.append((uses[at][4], first, last - first + 1))
            at = end
        out = {"segment": np.full(sum(len(h) for _, h, _ in found), key[0]), "item": pd.Series([i for i, h, _ in found for _ in h], dtype=object),
               "position": np.concatenate([h for _, h, _ in found]) if found else np.zeros(0, np.int64), "length": np.concatenate([n for *_, n in found]) if found else np.zeros(0, np.int64)}
        return pd.DataFrame(out)
    return match


def matches(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(segment, item, position, length): occurrences of every item's windows, of the phrase (``slop`` 0) or of the words in order
    and near each other, from the first word's position to the last word's. Those that reach into the next document are taken out
    where documents are looked up."""
    terms = item_terms(items, key, text)
    postings = index.where(F.col("term").isNotNull()).select("segment", "term", "positions")
    return postings.join(terms, "term").select("segment", "block", "positions", "uses").groupBy("segment", "block").applyInPandas(matcher(window, slop), HIT)


def placed(docs: list, items: list, position: np.ndarray, length: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"doc": pd.Series(docs, dtype=object), "item": pd.Series(items, dtype=object), "position": position, "length": length})


def located(index: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc, item, position in the document, length) of the matches; those that reach into the next document are none."""
    def place(found: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
        keys, words = directory["keys"].iloc[0], np.asarray(directory["words"].iloc[0], np.int64)
        ends = np.cumsum(words)
        start = found["position"].to_numpy(np.int64)
        doc = np.searchsorted(ends, start, side="right")
        inside = start + found["length"].to_numpy(np.int64) <= ends[doc]
        return placed([keys[d] for d in doc[inside]], found["item"][inside].tolist(), (start - (ends - words)[doc])[inside], found["length"][inside].to_numpy(np.int64))

    directory = index.where(F.col("term").isNull()).select("segment", "keys", "words")
    return hits.groupBy("segment").cogroup(directory.groupBy("segment")).applyInPandas(
        lambda a, b: place(a, b) if len(a) else placed([], [], np.zeros(0, np.int64), np.zeros(0, np.int64)), "doc string, item string, position long, length int")


def per_document(index: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc, n_words, n_hit, n_items, items_sha256) of every indexed row: words inside any occurrence, items with one."""
    nothing = hashlib.sha256(b"").hexdigest()

    def count(found: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
        keys, words = directory["keys"].iloc[0], np.asarray(directory["words"].iloc[0], np.int64)
        n_hit, n_items, digests = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [nothing] * len(words)
        if len(found):
            ends = np.cumsum(words)
            start, length = found["position"].to_numpy(np.int64), found["length"].to_numpy(np.int64)
            doc = np.searchsorted(ends, start, side="right")
            inside = start + length <= ends[doc]
            start, length, doc, item = start[inside], length[inside], doc[inside], found["item"].to_numpy()[inside]
            hit = np.zeros(int(ends[-1]), bool)
            hit[gather(start, length)] = True
            n_hit = np.diff(np.append(0, np.cumsum(hit)[ends - 1] * (ends > 0)))
            for d, own in pd.Series(item).groupby(doc):
                names = sorted(set(own))
                n_items[d], digests[d] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest()
        return pd.DataFrame({"doc": pd.Series(list(keys), dtype=object), "n_words": words, "n_hit": n_hit, "n_items": n_items, "items_sha256": pd.Series(digests, dtype=object)})

    directory = index.where(F.col("term").isNull()).select("segment", "keys", "words")
    return directory.groupBy("segment").cogroup(hits.groupBy("segment")).applyInPandas(lambda a, b: count(b, a), "doc string, n_words long, n_hit long, n_items long, items_sha256 string")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def checked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", slop: int = 0) -> DataFrame:
    """(doc as string, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``; with ``slop`` also n_near and
    n_near_items, the words and items of windows whose words stand in order with at most that many foreign words between two."""
    index = build(docs, key, text)
    if not slop:
        return per_document(index, matches(index, items)).withColumn("contaminated", contaminated())
    marked = index.withColumn("keys", F.when(F.col("keys").isNotNull(), F.transform("keys", lambda k, i: F.concat(F.col("segment").cast("string"), F.lit(":"), i.cast("string"), F.lit(":"), F.coalesce(k, F.lit(""))))))
    exactly, nearby = per_document(marked, matches(index, items)), per_document(marked, matches(index, items, slop=slop))
    out = exactly.join(nearby.select("doc", F.col("n_hit").alias("n_near"), F.col("n_items").alias("n_near_items")), "doc")
    own = F.regexp_extract("doc", r"(?s)^\d+:\d+:(.*)$", 1)
    return out.withColumn("doc", own).withColumn("contaminated", contaminated())


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text is not contaminated; rows meet their verdict by id and text."""
    (mark,) = absent(docs, "mark")
    marked = docs.withColumn(mark, row_mark(docs, key, text))
    gone = checked(marked, items, mark, text).where("contaminated").select(F.col("doc").alias(mark)).distinct()
    return marked.join(gone, mark, "left_anti").select(*docs.columns)
