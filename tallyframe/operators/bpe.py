"""Byte-pair encoding: merges are learned on the word-frequency table, never on the raw corpus."""

from __future__ import annotations

from collections.abc import Container, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tallyframe.functions import text as tx
from tallyframe.operators.ngram import SPECIALS
from tallyframe.session import written

WORD_END = "</w>"
GLUE = "\x1f"


def word_frequencies(texts: DataFrame, text: str) -> DataFrame:
    """(word, freq), combined map-side."""
    return texts.select(F.explode(tx.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def segmented(words: DataFrame) -> DataFrame:
    """Add ``symbols``: characters and the end mark, as one string with a separator around every symbol."""
    return words.withColumn("symbols", F.concat(F.lit(GLUE), F.array_join(tx.characters(F.col("word")), GLUE), F.lit(GLUE + WORD_END + GLUE)))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n): neighbouring symbols weighted by word frequency."""
    parts = F.split(F.expr("substring(symbols, 2, length(symbols) - 2)"), GLUE)
    pairs = words.select("freq", parts.alias("s")).filter(F.size("s") > 1).select("freq", F.expr(
        "inline(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> struct(a as left, b as right)))"))
    return pairs.groupBy("left", "right").agg(F.sum("freq").alias("n"))


#: Pairs looked at in a round; a round takes as many of the first ones as cannot influence each other.
TOP_PAIRS = 512
#: Rounds between two written states.
CUT_EVERY = 8


def independent(top: list[tuple[str, str, int]], known: Container[str], whole: bool) -> list[tuple[str, str]]:
    """The first pairs of ``top`` (most frequent first, the smaller on ties) that one merge after the other would choose in this order.

    Merging (a, b) takes from the counts of the pairs (x, a) and (b, y) and makes pairs (x, ab) and (ab, y) that are at most as
    frequent as those. So the next pair follows if it is none of these and strictly more frequent than all of them. Pairs
    beyond the end of ``top`` count as frequent as its last, unless it is ``whole``. A merge that yields a symbol that exists already
    raises other counts; it stands alone."""
    taken: list[tuple[str, str]] = []
    lefts, rights = set(), set()
    for i, (left, right, n) in enumerate(top):
        if taken:
            touched = max((m for a, b, m in top[i:] if b in lefts or a in rights), default=0 if whole else top[-1][2])
            if right in lefts or left in rights or n <= touched or left + right in known or any(left + right == a + b for a, b in taken):
                break
        taken.append((left, right))
        if left + right in known:
            break
        lefts.add(left)
        rights.add(right)
    return taken


def _spread(found: np.ndarray) -> np.ndarray:
    """Of neighbouring places (runs of one symbol) the first, third, fifth ..."""
    first = np.flatnonzero(np.diff(found, prepend=-2) > 1)
    offset = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
    return found[offset % 2 == 0]


def _pairs(flat: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of neighbouring symbols within words, and the word of each."""
    word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = word[:-1] == word[1:]
    return (flat[:-1] * width + flat[1:])[inside], word[:-1][inside]


def _deltas(keys: np.ndarray, weights: np.ndarray, names: list[str], rows: int) -> pa.Array:
    """Summed weights per pair as a list on the first of ``rows`` rows."""
    distinct, place = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, place, weights)
    distinct, sums = distinct[sums != 0], sums[sums != 0]
    table = pa.array(names, pa.string())
    parts = pa.StructArray.from_arrays([table.take(pa.array(distinct // len(names))), table.take(pa.array(distinct % len(names))), pa.array(sums)], ["left", "right", "n"])
    return pa.ListArray.from_arrays(pa.array([0] + [len(sums)] * rows, pa.int32()), parts)


STATE = "freq long, s array<int>, delta array<struct<left: string, right: string, n: long>>"


def lettered(words: DataFrame, names: list[str]) -> DataFrame:
    """(word, freq) as numbered symbols, with the pair counts as first deltas. ``names`` are the sorted letters, then the end mark."""
    points, end = np.array([ord(c) for c in names[:-1]], np.int64), len(names) - 1

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, freq = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes = np.array([len(w) + 1 for w in listed], np.int64)
            ends = np.cumsum(sizes)
            flat = np.full(int(sizes.sum()), end, np.int64)
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            flat[inner] = np.searchsorted(points, np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32))
            keys, word = _pairs(flat, ends, len(names))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(freq), lists, _deltas(keys, freq[word], names, len(listed))], names=["freq", "s", "delta"])

    return words.select("word", "freq").mapInArrow(number, STATE)


def merged(words: DataFrame, pairs: dict[tuple[int, int], int], names: list[str]) -> DataFrame:
    """One round: every left-to-right occurrence of a pair becomes its symbol. Only words that hold one change, and only their
    pairs, old and new, go into the deltas."""
    width = len(names)
    keys = np.array(sorted(a * width + b for a, b in pairs), np.int64)
    symbol = np.array([pairs[divmod(k, width)] for k in keys.tolist()], np.int64)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            freq, lists = batch.column(0), batch.column(1)
            flat, ends = lists.flatten().to_numpy().astype(np.int64), np.cumsum(pc.list_value_length(lists).to_numpy())
            here, word = _pairs(flat, ends, width)
            at = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == here)
            # pairs are numbered without the words' last symbols; places are in the flat array
            place = _spread(hit + word[hit])
            changed = np.zeros(len(ends), bool)
            changed[word[hit]] = True
            new = flat.copy()
            new[place] = symbol[np.searchsorted(keys, flat[place] * width + flat[place + 1])] if len(place) else 0
            gone = np.zeros(len(flat), bool)
            gone[place + 1] = True
            new, new_ends = new[~gone], ends - np.append(0, np.cumsum(gone))[ends]
            later, later_word = _pairs(new, new_ends, width)
            weight = freq.to_numpy()
            before, after = changed[word], changed[later_word]
            delta = _deltas(np.append(here[before], later[after]), np.append(-weight[word[before]], weight[later_word[after]]), names, len(ends))
            out = pa.ListArray.from_arrays(pa.array(np.append(0, new_ends).astype(np.int32)), pa.array(new.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([freq, out, delta], names=["freq", "s", "delta"])

    return words.select("freq", "s").mapInArrow(join, STATE)


def learned(texts: DataFrame, text: str, vocab_size: int = 1000, cut_every: int = CUT_EVERY, top_pairs: int = TOP_PAIRS) -> tuple[list[tuple[str, str]], dict[str, int], int]:
    """(merges in order, vocabulary, rounds). The result is that of merging the most frequent pair again and again, the smaller
    pair on ties, but a round takes all pairs at the head that do not influence each other.

    Word table and pair counts stay distributed. A round is one job: the words that hold a merged pair change, their deltas are
    summed per task, added to the counts, and the head of the counts reaches the driver (``top_pairs`` rows). Both tables are
    cached for the next round and written to the shared folder every few rounds, which cuts their lineage; a lost executor's part is
    computed again from there."""
    words = written(word_frequencies(texts, text), "bpe-words")
    letters = [r["ch"] for r in words.select(F.explode(tx.characters(F.col("word"))).alias("ch")).distinct().collect()]
    vocabulary = dict(SPECIALS)
    for ch in sorted({*letters, WORD_END}):
        vocabulary.setdefault(ch, len(vocabulary))
    names = [*sorted(letters), WORD_END]
    number = {name: i for i, name in enumerate(names)}
    left, merges, rounds = vocab_size - len(vocabulary), [], 0
    state = lettered(words, names).persist()
    first = state.select(F.explode("delta").alias("d")).select("d.*")
    counts = first.groupBy("left", "right").agg(F.sum("n").alias("n")).persist()
    old: list[DataFrame] = []
    while left > len(merges):
        top = [(r["left"], r["right"], r["n"]) for r in counts.where("n > 0").orderBy(F.col("n").desc(), "left", "right").limit(top_pairs).collect()]
        for df in old:
            df.unpersist()
        pairs = independent(top, number, len(top) < top_pairs)[:left - len(merges)]
        if not pairs:
            break
        merges += pairs
        rounds += 1
        for a, b in pairs:
            vocabulary.setdefault(a + b, len(vocabulary))
            if a + b not in number:
                number[a + b] = len(names)
                names = [*names, a + b]
        if rounds % cut_every == 0:
            fresh = written(state.select("freq", "s"), "bpe-state"), written(counts, "bpe-counts")
            state.unpersist()
            counts.unpersist()
            state, counts = fresh
        old = [state, counts]
        state = merged(state, {(number[a], number[b]): number[a + b] for a, b in pairs}, names).persist()
        changes = state.select(F.explode("delta").alias("d")).select("d.*")
        counts = counts.unionByName(changes).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n <> 0").persist()
    for df in (*old, state, counts):
        df.unpersist()
    return merges, vocabulary, rounds


def learn(texts: DataFrame, text: str, vocab_size: int = 1000, **how: int) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """(merges in order, vocabulary), see ``learned``."""
    return learned(texts, text, vocab_size, **how)[:2]


class Joins:
    """The learned pairs over numbered symbols, applied to many words at once. All words lie in one flat array, each behind
    a gap that pairs with nothing. In one pass the places that start a known pair form runs of neighbours; scanning a run
    from the left joins its first, third, fifth ... place. Passes go on until no known pair is left."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int]):
        symbols = sorted({*vocabulary, WORD_END, *(s for left, right in merges for s in (left, right, left + right))})
        number = {s: i for i, s in enumerate(symbols)}
        self.foreign, self.gap, self.end, self.width = len(symbols), len(symbols) + 1, number[WORD_END], len(symbols) + 2
        letters = sorted((ord(s), i) for s, i in number.items() if len(s) == 1)
        self.points, self.numbers = (np.array([x[k] for x in letters], np.int64) for k in (0, 1))
        pairs = sorted((number[left] * self.width + number[right], number[left + right]) for left, right in set(merges))
        self.pairs, self.joined = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
        self.ids = np.array([*(vocabulary.get(s, SPECIALS["<UNK>"]) for s in symbols), SPECIALS["<UNK>"]], np.int32)

    @staticmethod
    def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``wanted`` in the sorted ``keys``, and which of them are there."""
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def __call__(self, words: list[str]) -> list[np.ndarray]:
        """The ids of every word."""
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        at, known = self.found(self.points, text)
        flat = np.full(len(text) + 2 * len(words), self.gap, np.int64)
        ends = np.cumsum(sizes + 2) - 1
        flat[ends] = self.end
        inner = np.ones(len(flat), bool)
        inner[ends] = inner[ends - sizes - 1] = False
        flat[inner] = np.where(known, self.numbers[at], self.foreign) if len(self.numbers) else self.foreign
        while len(flat) > 1:
            at, known = self.found(self.pairs, flat[:-1] * self.width + flat[1:])
            places = np.flatnonzero(known)
            if not len(places):
                break
            first = np.flatnonzero(np.diff(places, prepend=-2) > 1)
            offset = np.arange(len(places)) - np.repeat(first, np.diff(np.append(first, len(places))))
            places = places[offset % 2 == 0]
            flat[places] = self.joined[at[places]]
            flat = np.delete(flat, places + 1)
        starts = np.flatnonzero(flat == self.gap)
        ids = self.ids[flat[flat != self.gap]]
        return np.split(ids, (starts - np.arange(len(starts)))[1:]) if len(starts) else []


def encode(texts: DataFrame, text: str, merges: list[tuple[str, str]], vocabulary: dict[str, int]) -> DataFrame:
    """Add ``ids``. The distinct words of a batch are encoded together; merges and vocabulary are bounded by the vocabulary size."""
    shared = texts.sparkSession.sparkContext.broadcast((merges, vocabulary))

    @pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        joins = Joins(*shared.value)
        for batch in batches:
            lists = [() if ws is None else ws for ws in batch]
            codes, distinct = pd.factorize(np.array([w for ws in lists for w in ws], object))
            coded, ends = joins(list(distinct)), np.cumsum([len(ws) for ws in lists])
            yield pd.Series([None if ws is None else np.concatenate([coded[c] for c in codes[e - len(ws):e]]) if len(ws) else np.zeros(0, np.int32)
                             for ws, e in zip(batch, ends)], dtype=object)

    return texts.withColumn("ids", ids(tx.words(F.col(text))))


def decode(encoded: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Add ``decoded``: tokens joined, the end mark as a blank; the vocabulary bounds the lookup array."""
    inverse = [t for t, _ in sorted(vocabulary.items(), key=lambda kv: kv[1])]
    table = encoded.sparkSession.createDataFrame([(inverse,)], "t array<string>")
    staged = encoded.withColumn("_t", table.scalar())
    return staged.withColumn("decoded", F.expr(
        f"trim(replace(array_join(transform(filter(ids, i -> i > 2), i -> coalesce(try_element_at(_t, i + 1), '?')), ''), '{WORD_END}', ' '))")).drop("_t")
