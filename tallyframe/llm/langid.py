"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent letter n-grams (1 to 3, within words, word ends marked) over all
training texts. A document's own ranking is compared with each profile: the out-of-place distance sums how far each n-gram
stands from its place in the profile; n-grams missing there count the longest distance. The nearest language wins.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text when there is nothing to learn
from; rows with a null language are not learned from; equal counts rank by n-gram, equal distances by language name; a null
id counts as an empty string when rows are held out; whole texts count, however long; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.llm.common import field, slices

ORDERS, RANKS, UNKNOWN = 3, 300, "und"
MOST_LANGUAGES = 2000
BITS = 21
COUNTS = "lang string, gram long, n long"


class Letters:
    """Is a code point a letter: a table for the first planes' common part, one look per other code point."""

    def __init__(self, common: int = 0x3000):
        self.table = np.array([chr(c).isalpha() for c in range(common)])

    def __call__(self, points: np.ndarray) -> np.ndarray:
        beyond = points >= len(self.table)
        if not beyond.any():
            return self.table[points]
        found = self.table[np.where(beyond, 0, points)]
        kinds, inverse = np.unique(points[beyond], return_inverse=True)
        found[beyond] = np.array([chr(c).isalpha() for c in kinds])[inverse]
        return found


IS_LETTER = Letters()


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts in order of text, start of each text's n-grams): packed code points, a word end is 1."""
    lowered = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    points = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ok = IS_LETTER(points)
    code = np.where(ok, points + 2, 1)
    before, after = np.ones_like(code), np.ones_like(code)
    before[1:], after[:-1] = code[:-1], code[1:]
    # around each letter: the letter, the pair with the next sign, the pair with a word start, the triple around it
    values, mask = np.empty((len(code), 4), np.int64), np.empty((len(code), 4), bool)
    values[:, 0], values[:, 1], values[:, 2] = code, code << BITS | after, before << BITS | code
    values[:, 3] = values[:, 2] << BITS | after
    mask[:] = ok[:, None]
    mask[:, 2] &= before == 1
    starts = np.append(0, np.cumsum(ok * 3 + mask[:, 2])[ends - 1])
    return values[mask], starts


def tallied(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        values = np.sort(values)
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        return values[first], np.diff(np.append(first, len(values)))
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(weights, first) if len(first) else weights


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", ranks: int = RANKS) -> pd.DataFrame:
    """(lang, gram, rank): at most ``ranks`` rows a language. Counts are combined in each task before the shuffle."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush():
            for name, parts in held.items():
                g, n = tallied(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(g), pa.string()), "gram": g, "n": n.astype(np.int64)})

        for part in slices(batches, "_text", 2 << 20):
            names = np.array(field(part, "_lang").to_pylist(), object)
            texts = field(part, "_text").to_pylist()
            for name in set(names.tolist()):
                values, _ = grams([texts[i] for i in np.flatnonzero(names == name)])
                found = tallied(values)
                held.setdefault(name, []).append(found)
                size += len(found[0])
            if size > 2_000_000:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    counts = rows.mapInArrow(count, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = counts.withColumn("rank", place - 1).where(F.col("rank") < ranks)
    found = top.select("lang", "gram", "rank").limit(ranks * MOST_LANGUAGES + 1).toPandas()
    if len(found) > ranks * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return found


class Distances:
    """Out-of-place distances of texts to all profiles."""

    def __init__(self, model: pd.DataFrame, ranks: int = RANKS):
        self.ranks, self.names = ranks, sorted(model["lang"].unique().tolist())
        self.grams = np.unique(model["gram"].to_numpy(np.int64))
        self.place = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        column = np.array([self.names.index(x) for x in model["lang"]], np.int64)
        self.place[np.searchsorted(self.grams, model["gram"].to_numpy(np.int64)), column] = model["rank"].to_numpy(np.int64)

    def nearest(self, values: np.ndarray) -> tuple[str, float]:
        if not len(values) or not self.names:
            return UNKNOWN, 0.0
        found, counts = tallied(values)
        if len(found) > self.ranks:
            # all n-grams that may rank, then the exact order: count down, n-gram up
            least = np.partition(counts, len(counts) - self.ranks)[len(counts) - self.ranks]
            may = counts >= least
            found, counts = found[may], counts[may]
        found = found[np.argsort(-counts, kind="stable")][:self.ranks]
        at = np.searchsorted(self.grams, found)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != found)] = len(self.grams)
        place = self.place[at]
        far = np.where(place < 0, self.ranks, np.abs(place - np.arange(len(found))[:, None])).sum(0)
        best = int(np.argmin(far))
        return self.names[best], 1 - float(far[best]) / (self.ranks * len(found))


def held_out(key: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text leaves ``part``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part


def identified(docs: DataFrame, model: pd.DataFrame, text: str = "text", ranks: int = RANKS) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the rows, without the text."""
    others = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["lang_pred string", "score double"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Distances(model, ranks)
        for part in slices(batches, text, 2 << 20):
            values, starts = grams(field(part, text).to_pylist())
            found = [judge.nearest(values[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([*[field(part, f.name) for f in others], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                             names=[*[f.name for f in others], "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)
