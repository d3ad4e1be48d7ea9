"""Spelling variants: words one edit apart, found with FM-indexes of the delimited vocabulary read in both directions.

Two words are near if they differ by one inserted, deleted or replaced code point. Then one half of the asked word - its first
L // 2 letters or the rest - stands unchanged at the same end of the other word. The search scheme has two searches:

* first half exact, over an index that extends matches to the right (the index of the words read backwards);
* second half exact, over an index that extends matches to the left.

Both start at the delimiter next to their half, match the half, then extend over the other half with one error and end
at the other delimiter. What they extend is an interval of suffix ranks; a step is two lookups in the sorted
(symbol, rank) pairs of the Burrows-Wheeler transform, for all words of a block at once. Delimiters are ordered like their words, so
the rank where a search ends is the word. A pair that both searches could find is left to the first, so that every pair comes once.

Distribution: the exact half holds the word's first (or last) three letters, so only words that agree there need
a common index. Each word goes to one place per direction, by those letters; places hold about ``BLOCK`` words. Letters that more
words share are split: their words stand in blocks, each asked by every block of the same letters, so no task
gets more than two blocks whatever the share of a word's beginning. What leaves a task is one row a word.

Forms: a word's form is the near word with the largest count (ties: the smaller in code-point order) if that is at least ``ratio``
times its own. Counts grow by that factor along forms, so chains are short; roots come by doubling links.

Defined cases: a null text has no words, a null id counts as an empty text in the damage; runs and texts may have any length;
the vocabulary's words are distinct, equal words given to ``near`` are taken together by ``counted``; an empty
table has no words; only the columns named are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import cut_words, encoded, field, gather, slices, text_buffers
from tallyframe.session import written

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Words to a place, and words asked at once.
BLOCK, ASKED = 20_000, 4_096
ENDS = 3  # letters that decide the place; the exact half has at least as many


def letter_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased, as ``cut_words``. In UTF-8 those beyond ASCII are the characters with
    the first byte C3."""
    offs, raw = text_buffers(texts)
    low = raw | 0x20
    plain = (low >= 0x61) & (low <= 0x7A)
    wide = raw == 0xC3
    wide[1:] |= wide[:-1].copy()
    data = np.where(plain, low, np.where(wide, raw, 32)).astype(np.uint8)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(data)])
    return cut_words(array, np.arange(256, dtype=np.uint8))


def damaged_words(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 31, least: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): partial counts of the runs of all texts with at least ``least`` letters. Where ``modulus`` divides the checksum of
    ``<id>:<run>`` the run loses the letter at checksum % length; 0 damages none."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.col(text).cast("string").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words, bounds = letter_runs(field(batch, "_text"))
            codes, distinct = encoded(words)
            length = pc.utf8_length(distinct.cast(pa.large_string())).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            fit = length[codes] >= least
            found, n = np.unique(row[fit] * len(distinct) + codes[fit], return_counts=True)
            row, codes = found // max(1, len(distinct)), found % max(1, len(distinct))
            listed = distinct.to_pylist()
            starts = [zlib.crc32(f"{i}:".encode()) for i in field(batch, "_id").to_pylist()]
            sums = np.fromiter((zlib.crc32(listed[c], starts[r]) for c, r in zip(codes.tolist(), row.tolist())), np.int64, len(codes))
            hit = sums % modulus == 0 if modulus else np.zeros(len(sums), bool)
            whole = np.bincount(codes[~hit], n[~hit], len(distinct)).astype(np.int64)
            kept = np.flatnonzero(whole)
            cut, cut_n = [], []
            for c, h, k in zip(codes[hit].tolist(), sums[hit].tolist(), n[hit].tolist()):
                word = listed[c].decode()
                at = h % len(word)
                if len(word) > least:
                    cut.append(word[:at] + word[at + 1:])
                    cut_n.append(k)
            values = pa.concat_arrays([distinct.take(pa.array(kept)).cast(pa.large_string()), pa.array(cut, pa.large_string())])
            yield pa.RecordBatch.from_arrays([values.cast(pa.string()), pa.array(np.append(whole[kept], np.array(cut_n, np.int64)))], names=["word", "n"])

    return rows.mapInArrow(count, "word string, n long")


def counted(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """The vocabulary: distinct words with their counts, from partial counts."""
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Index:
    """FM-index of distinct words, each followed by its delimiter. ``words`` are sorted here; ``self.words[i]`` is the word of rank i."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        self.size = len(self.words)
        points, lens = code_points(self.words)
        self.letters = np.unique(points)
        self.symbols = len(self.letters) + 1
        ends = np.cumsum(lens + 1) - 1
        self.n = n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = 1 + np.searchsorted(self.letters, points)
        first = np.zeros(n, bool)
        first[ends - lens] = True
        order = suffix_order(np.where(inside, self.size + text, 0) + np.where(inside, 0, np.cumsum(~inside) - 1))
        self.transform = np.where(first[order], 0, text[order - 1])
        self.pairs = np.sort(self.transform * n + np.arange(n))

    def coded(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for those that no word has."""
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, 1 + at, -1)

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank intervals of symbol + what the intervals hold; empty for unknown symbols."""
        known = np.maximum(symbol, 0) * self.n
        new_low, new_high = np.searchsorted(self.pairs, known + low), np.searchsorted(self.pairs, known + high)
        return new_low, np.where(symbol >= 0, new_high, new_low)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions by a letter: (which interval, symbol, low, high). Small intervals are read from the transform, others try
        every symbol."""
        small = np.flatnonzero(high - low <= self.symbols)
        large = np.flatnonzero(high - low > self.symbols)
        sizes = (high - low)[small]
        met = np.repeat(small, sizes) * self.symbols + self.transform[gather(low[small], sizes)]
        met = np.append(np.unique(met), (large[:, None] * self.symbols + np.arange(self.symbols)).ravel())
        which, symbol = met // self.symbols, met % self.symbols
        new_low, new_high = self.extended(symbol, low[which], high[which])
        ok = (new_high > new_low) & (symbol > 0)
        return which[ok], symbol[ok], new_low[ok], new_high[ok]

    def near(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``words``, rank): all words one edit away whose last ``exact`` letters are those of the asked word."""
        points, lens = code_points(words)
        codes, start = self.coded(points), np.cumsum(lens) - lens
        found = []

        def onward(q, left, low, high):
            """A letter on without an error; words at their first letter must meet the delimiter."""
            done = left == 0
            low, high = self.extended(np.where(done, 0, codes[np.where(done, 0, start[q] + left - 1)]), low, high)
            some = high > low
            if (end := done & some).any():
                found.append(q[end] * self.size + low[end])
            go = some & ~done
            return q[go], left[go] - 1, low[go], high[go]

        q, left = np.arange(len(words)), lens.copy()
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.size, np.int64)
        rest = lens - exact
        waiting = []
        while len(q):  # the exact half
            ready = left <= rest[q]
            waiting.append((q[ready], left[ready], low[ready], high[ready]))
            q, left, low, high = q[~ready], left[~ready], low[~ready], high[~ready]
            low, high = self.extended(codes[start[q] + left - 1], low, high)
            go = high > low
            q, left, low, high = q[go], left[go] - 1, low[go], high[go]
        q, left, low, high = (np.concatenate(x) for x in zip(*waiting))
        erred = tuple(np.zeros(0, np.int64) for _ in range(4))
        while len(q) or len(erred[0]):  # the other half: words without an error yet, and all that have one, go on a letter a round
            which, symbol, child_low, child_high = self.children(low, high)
            some = left > 0
            own = np.where(some, codes[np.where(some, start[q] + left - 1, 0)], 0)
            other = some[which] & (symbol != own[which])
            inserted = q[which], left[which], child_low, child_high
            replaced = q[which[other]], left[which[other]] - 1, child_low[other], child_high[other]
            deleted = q[some], left[some] - 1, low[some], high[some]
            erred = onward(*(np.concatenate(x) for x in zip(erred, inserted, replaced, deleted)))
            q, left = q[some], left[some]
            low, high = self.extended(own[some], low[some], high[some])
            go = high > low
            q, left, low, high = q[go], left[go] - 1, low[go], high[go]
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // self.size, pairs % self.size


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def suffix_order(key: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling. Delimiters are all different, so no suffix is compared beyond its own."""
    n, width = len(key), 1
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        beyond = np.zeros(n, np.int64)
        beyond[:n - width] = rank[width:]
        key, width = rank * n + beyond, 2 * width


def asked(side: int, words: list[str], counts: np.ndarray, indexed: np.ndarray, queries: np.ndarray) -> Iterator[tuple]:
    """(word, n, n_near, form_n, form) of each query word over the indexed words; side 0 takes the first half as exact, side 1 the second."""
    turn = (lambda w: w[::-1]) if side == 0 else (lambda w: w)
    index = Index([turn(words[i]) for i in indexed])
    n_of = {words[i]: int(counts[i]) for i in indexed}
    for at in range(0, len(queries), ASKED):
        block = queries[at:at + ASKED]
        mine = [words[i] for i in block]
        exact = np.array([len(w) // 2 if side == 0 else len(w) - len(w) // 2 for w in mine], np.int64)
        which, rank = index.near([turn(w) for w in mine], exact)
        n_near, best = [0] * len(mine), [None] * len(mine)
        for q, r in zip(which.tolist(), rank.tolist()):
            word, other = mine[q], turn(index.words[r])
            if side and other.startswith(word[:len(word) // 2]):
                continue  # the other search finds it
            n_near[q] += 1
            this = (-n_of[other], other)
            if best[q] is None or this < best[q]:
                best[q] = this
        for q, word in enumerate(mine):
            yield word, int(counts[block[q]]), n_near[q], -best[q][0] if best[q] else None, best[q][1] if best[q] else None


def near(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form_n, form): for every word of ``vocabulary`` (word, n), how many words are near and the most frequent of them.
    The vocabulary is read several times: give a written one. Its words have at least ``2 * ENDS`` letters."""
    if least := vocabulary.where(F.length("word") < 2 * ENDS).head(1):
        raise ValueError(f"{least[0]['word']!r} has fewer than {2 * ENDS} letters")
    places = max(1, -(-vocabulary.count() // block))
    both = vocabulary.select("word", "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, ENDS).alias("ends")), F.struct(F.lit(1).alias("side"), F.right("word", F.lit(ENDS)).alias("ends")))).alias("_at"))
    both = both.select("word", "n", "_at.*")
    hot = both.groupBy("side", "ends").count().where(F.col("count") > block).select("side", "ends", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    both = both.join(hot, ["side", "ends"], "left")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # with parts: in the index of block i for each asking block j, and asking from block j in each i; without: one row for both
    spots = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("use")))).otherwise(F.concat(
        F.transform(every, lambda j: F.struct(part.alias("i"), j.alias("j"), F.lit(0).alias("use"))), F.transform(every, lambda i: F.struct(i.alias("i"), part.alias("j"), F.lit(1).alias("use")))))
    both = both.withColumn("_spot", F.explode(spots)).withColumn("place", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("side", "ends"), places).cast("string")).otherwise(F.col("ends")))
    both = both.select("side", F.col("parts").isNotNull().alias("split"), "place", "_spot.*", "word", "n")

    def search(group: pa.Table) -> pa.Table:
        words, counts, use = group["word"].to_pylist(), group["n"].to_numpy(), group["use"].to_numpy()
        indexed, queries = np.flatnonzero(use != 1), np.flatnonzero(use != 0)
        rows = list(asked(group["side"][0].as_py(), words, counts, indexed, queries)) if len(indexed) and len(queries) else []
        columns = list(zip(*rows)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n", "n_near", "form_n", "form"])

    answers = both.groupBy("side", "split", "place", "i", "j").applyInArrow(search, "word string, n long, n_near long, form_n long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form"))))
    return answers.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n", "n_near", (-F.col("_best.less")).alias("form_n"), F.col("_best.form").alias("form"))


def grouped(vocabulary: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): forms at least ``ratio`` times as frequent, and where following them ends."""
    if ratio < 2:
        raise ValueError("counts must grow along forms")
    vocabulary = written(vocabulary, "spelling-words")
    found = near(vocabulary, block)
    fits = F.col("form_n") >= ratio * F.col("n")
    found = written(found.select("word", F.when(fits, F.col("form")).alias("form"), "n", "n_near", F.when(fits, F.col("form_n")).alias("form_n")), "spelling-near")
    links = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), "n")
    most, reach = vocabulary.agg(F.max("n")).first()[0] or 0, 1
    while ratio ** (reach + 1) <= most:  # a chain longer than reach may exist
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        links = written(links.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), "n"), "spelling-roots")
        reach *= 2
    out = found.join(links.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
