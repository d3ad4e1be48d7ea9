"""Packing: pieces against the tokenizer itself, sequences against their definition, plain best fit and the least number possible."""

import collections
import functools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import packing
from tallyframe.llm.q_documents import op13_packing, tokenizer
from tallyframe.session import written

SCHEMA = "doc_id long, text string, row int, length string, bin int, shard int"
TEXTS = [None, "", " ", "\n\n  x", "a  b", "tail  ", "it's we'll  don't", "café noir à　 b  c", "<|endoftext|> in <|endoftext|>text", "\t\ttabs\r\n \r\nlines", "1234 5678 a1b2", "\U0001F600 \U0001F600漢字 漢", "x\x1c y\x85 z",
         "word " * 5_000, "word" * 3_000, "é" * 2_500, "!? " * 2_047, " ".join(["a"] * 2_047), " ".join(["a"] * 2_048), " ".join(["a"] * 4_095), " ".join(["a"] * 4_096)]


def made():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    return [*enumerate(TEXTS * 2), *((100 + i, " ".join(rng.choices(words, k=rng.choice((5, 60, 250, 600))))) for i in range(250)), (None, "no id"), (None, "no id"), (7, "the same id")]


@functools.lru_cache(1)
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def coded(text):
    return plain().encode(text or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def rows():
    return made()


def check_places(places, limit):
    """(sequence_id, offset, length): gapless from 0 and within the limit."""
    bins = collections.defaultdict(list)
    for seq, offset, length in places:
        bins[seq].append((offset, length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert 0 < at <= limit
    return len(bins)


def test_pieces_and_sequences(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = op13_packing(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = [tuple(r) for r in out.collect()]
    want = []
    for doc, text in rows:
        ids = coded(text)
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        for piece, (a, b) in enumerate([(0, first), *((a, a + 2048) for a in range(first, len(ids), 2048))]):
            want.append((doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert collections.Counter(r[:5] for r in got) == collections.Counter(want)
    bins = check_places([(r[5], r[6], r[3]) for r in got], 2048)
    assert bins <= plain_best_fit([r[3] for r in got], 2048)


def test_ids_of_sequences(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = written(packing.pieces(docs, tokenizer("byte_bpe_50k.json"), limit=64).withColumn("row", F.monotonically_increasing_id()), "test-pieces")
    placed = found.join(packing.packed(found.select("row", "length"), limit=64, shard=100), "row")
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert bytes(whole[r["sequence_id"]])[4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert sum(len(x) for x in whole.values()) == 4 * sum(len(coded(t)) for _, t in rows)


def plain_best_fit(lengths, limit):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(limit - n)
    return len(free)


@pytest.mark.parametrize("kind", ["even", "halves", "thirds", "large", "equal", "tiny"])
def test_bins_are_few(spark, kind):
    """Over several shards and rounds no more bins than best fit over all pieces at once, but for one in a hundred."""
    rng = random.Random(kind)
    draw = {"even": lambda: rng.randint(1, 999), "halves": lambda: rng.randint(400, 600), "thirds": lambda: rng.randint(260, 400), "large": lambda: rng.randint(501, 999), "equal": lambda: 301, "tiny": lambda: rng.randint(1, 9)}[kind]
    lengths = [draw() for _ in range(1_500)] + [1000] * 5
    table = written(spark.createDataFrame([(i, n, n) for i, n in enumerate(lengths)], "row long, length long, bin long").repartition(4), "test-lengths")
    got = packing.packed(table.select("row", "length"), limit=1000, shard=400).collect()
    assert sorted(r["row"] for r in got) == list(range(len(lengths)))
    bins = check_places([(r["sequence_id"], r["offset"], lengths[r["row"]]) for r in got], 1000)
    assert bins <= plain_best_fit(lengths, 1000) * 1.01 + 1
    again = packing.packed(table.select("row", "length"), limit=1000, shard=400).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_crossover_keeps_whole_bins_and_all_pieces():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(50, 700, 300))[::-1].copy()
    island = packing.Island(lengths, 1000, [1])
    island.found(None, 2)
    if len(island.members) < 2:
        island.add(np.arange(300))
    one, other = island.members[0][2], island.members[-1][2]
    child = island.crossed(one, other)
    fill = np.bincount(child, lengths)
    assert len(child) == 300 and fill.max() <= 1000 and fill.min() > 0
    groups = lambda genome: {tuple(np.flatnonzero(genome == b)) for b in np.unique(genome)}
    assert groups(child) & groups(other)


def test_evolution_beats_its_founders():
    """Triples that fill a bin exactly: best fit misses some, crossover finds more of them."""
    rng = np.random.default_rng(7)
    parts = []
    for _ in range(40):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2 + 1))
        parts += [a, b, 1000 - a - b]
    lengths = np.sort(np.array(parts))[::-1].copy()
    island = packing.Island(lengths, 1000, [3])
    island.found(None, 8)
    before = island.members[0][:2]
    island.evolve(300, 8)
    assert island.members[0][:2] < before


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert op13_packing(spark, str(tmp_path)).collect() == []
