"""Exact n-gram Jaccard join of whole texts, by prefix filtering with rare n-grams first.

Every text is its set of distinct word n-grams, ordered rare first by a fixed-size table of document counts of hashed
n-grams over all texts (any order common to all gives whole results; counts only make prefixes selective). Texts with equal
sets are one class. Two classes can only be similar enough if they share an n-gram of their prefixes, which is where they
meet. Length, positional and suffix filters drop pairs that cannot reach the threshold; what is left is verified once per
pair on the full sets.

Not all pairs of a group are made: classes first meet one pivot per prefix n-gram and length band, a row with few n-grams of
its own before the shared one; after that all pairs that the links found so far do not connect are tried, and never pairs tried
before. So no link between different components is lost, and a group of near copies costs about as many pairs as it has
members.

Defined cases: null, empty and blank texts have no n-grams and are linked with nothing (their own component); texts with
fewer words than n are one n-gram; repeated rows are one class; a null id takes part, but the smallest id that is not null
names a component (null if there is none); an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.llm.common import absent, blank_separated, components, cut_words, encoded, field, slices
from tallyframe.session import written

BITS, SHARDS, FAN_IN, BINS = 20, 16, 64, 32
PRIMES = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * PRIMES[4]
    x = (x ^ (x >> np.uint64(29))) * PRIMES[6]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each row the sorted 64-bit hashes of its distinct word n-grams."""
    words, bounds = cut_words(texts, blank_separated(True))
    codes, distinct = encoded(words)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()], np.uint64)
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        rolled += h[k:len(h) - n + 1 + k] * PRIMES[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            s = np.sort(rolled[a:b - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(mixed(np.array([sum(int(x) * int(p) for x, p in zip(h[a:b], PRIMES)) + b - a & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def frequencies(texts: DataFrame, n: int) -> np.ndarray:
    """Document counts of hashed n-grams in 2**BITS cells, over all rows: one array a task, summed in a tree of bounded
    groups; the result has a fixed size."""
    cells = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for part in slices(batches, "_text", 4 << 20):
            sets = shingle_sets(field(part, "_text"), n)
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64), minlength=cells).astype(np.uint32)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"shard": pa.array(range(SHARDS), pa.int32()), "part": pa.array([task] * SHARDS, pa.int64()), "counts": [x.tobytes() for x in np.split(total, SHARDS)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(cells // SHARDS, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x, np.uint32)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "part": [group["part"].iloc[0] // FAN_IN], "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    schema = "shard int, part long, counts binary"
    now = written(texts.select("_text").mapInArrow(count, schema), "shingle-counts", small=True)
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        now = written(now.groupBy("shard", F.floor(F.col("part") / FAN_IN)).applyInPandas(add, schema), "shingle-counts")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    out = np.zeros((SHARDS, cells // SHARDS), np.uint32)
    for shard, counts in now.select("shard", "counts").toLocalIterator():
        out[shard] = np.frombuffer(counts, np.uint32)
    return out.ravel()


SIGNED = "row long, id long, mark long, n int, d1 long, d2 long, prefix array<long>, bins binary"


def signed(texts: DataFrame, n: int, percent: int, order: np.ndarray) -> DataFrame:
    """For each row (_id, _mark, _text): the set's size, a 128-bit digest of the set, its prefix (rare first) and its suffix profile."""
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, row = shared.value, TaskContext.get().partitionId() << 40
        for part in slices(batches, "_text", 4 << 20):
            sizes, one, two, prefixes, bins = [], [], [], [], []
            for s in shingle_sets(field(part, "_text"), n):
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                cell = counts[(s >> np.uint64(64 - BITS)).astype(np.int64)]
                if keep < len(s):
                    may = np.flatnonzero(cell <= np.partition(cell, keep - 1)[keep - 1])
                else:
                    may = np.arange(len(s))
                first = s[may[np.lexsort((s[may], cell[may]))[:keep]]]
                sizes.append(len(s))
                x, y = digest(s)
                one.append(x)
                two.append(y)
                prefixes.append(first.astype(np.int64))
                bins.append(np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS).astype(np.uint32).tobytes())
            ends = np.append(0, np.cumsum([len(p) for p in prefixes])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + part.num_rows)), field(part, "_id"), field(part, "_mark"), pa.array(sizes, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes))), pa.array(bins, pa.binary())], names=["row", "id", "mark", "n", "d1", "d2", "prefix", "bins"])
            row += part.num_rows

    return written(texts.select("_id", "_mark", "_text").mapInArrow(sign, SIGNED), "shingle-signs", small=True)


def met(prefixes: DataFrame, percent: int) -> DataFrame:
    """Prefix rows (token, row, n, pos, s: earlier shared tokens of the row) -> pairs (a, b) that share the token and pass the length and positional filters,
    where b is the pivot of its length band or of the band below."""
    band = F.floor(F.log("n") / float(-np.log(percent / 100))).cast("int") if percent < 100 else F.col("n")
    rows = prefixes.withColumn("band", band)
    pivots = rows.groupBy("token", "band").agg(F.min(F.struct((F.col("pos") - F.col("s")).alias("own"), "n", "row", "pos", "s")).alias("p"), F.count(F.lit(1)).alias("k"))
    near = pivots.select("token", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "p")
    found = rows.join(near, ["token", "band"]).where(F.col("row") != F.col("p.row"))
    return close(found.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("s").alias("sa"), F.col("p.row").alias("b"), F.col("p.n").alias("nb"), F.col("p.pos").alias("pb"), F.col("p.s").alias("sb")), percent)


def close(pairs: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """The distinct pairs left by the length filter and the positional filter (tokens behind the shared one are all that the
    pair can still share). With ``every`` a pair comes once per token that its prefixes share, and these must be enough: of the
    two prefixes one ends first, and behind it the pair shares at most what that set has left. A token whose rows have too few
    such tokens (``all`` of a row, ``s`` before the shared one) makes no pair."""
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100.0 + percent) - 1e-9)
    length = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    # what two sets share before the token stands in both prefixes, so it is among their prefix tokens that others have too
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("sa", "sb")
    left = pairs.where(length & (reach >= need))
    named = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    if not every:
        return left.select(*named).distinct()
    # a link passes the positional filter at each of its tokens, so its count is whole
    behind = [F.ceil(percent * F.col(c) / 100) - 1 for c in ("na", "nb")]
    least = need - F.greatest(*behind)
    most = F.least("sa", "sb") + F.least(F.col("alla") - F.col("sa"), F.col("allb") - F.col("sb"))
    return left.where(most >= least).select(*named, least.alias("least")).groupBy("a", "b", "least").agg(F.count(F.lit(1)).alias("m")).where("m >= least").select("a", "b")


def unconnected(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """Prefix rows of tokens whose rows are in several components, with their component and the token's most frequent one."""
    rows = prefixes.join(labels, "row", "left").withColumn("c", F.coalesce("component", "row")).drop("component")
    sizes = rows.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "c")).alias("m"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    rows = rows.join(main.select("token", F.col("m.c").alias("main")), "token")
    # rows of different components share no token but these, so a row's place among them is what the filters need
    own = Window.partitionBy("row")
    rows = rows.withColumn("s", F.row_number().over(own.orderBy("pos")) - 1).withColumn("all", F.count(F.lit(1)).over(own))
    return written(rows, "shingle-unconnected")


def sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("token", F.col("row").alias(side), F.col("n").alias(f"n{side}"), F.col("pos").alias(f"p{side}"), F.col("s").alias(f"s{side}"), F.col("all").alias(f"all{side}"), F.col("c").alias(f"c{side}"), (F.col("c") == F.col("main")).alias(f"main_{side}"))


def untried(rows: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """All pairs of unconnected rows in different components whose prefixes share enough tokens, without those tried before.
    Rows of a token's main component are not paired with each other, so a token costs its other rows times its rows."""
    found = sided(rows, "a").where("NOT main_a").join(sided(rows, "b"), "token").where((F.col("ca") != F.col("cb")) & (F.col("main_b") | (F.col("a") > F.col("b"))))
    return close(found, percent, every=True).join(tried, ["a", "b"], "left_anti")


def texts_of(heads: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(row, _text) of the classes (row, id, d1, d2, n_class). Equal ids may have several texts: a class's text is one with its
    digest. Only a class of several rows can meet its text more than once."""
    named = texts.join(heads, texts["_id"].eqNullSafe(heads["id"])).select("row", "d1", "d2", "n_class", "_text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 4 << 20):
            sets = shingle_sets(field(part, "_text"), n)
            one, two = field(part, "d1").to_pylist(), field(part, "d2").to_pylist()
            same = [digest(s) == (x, y) for s, x, y in zip(sets, one, two)]
            yield part.select(["row", "n_class", "_text"]).filter(pa.array(same, pa.bool_()))

    found = written(named.mapInArrow(own, "row long, n_class long, _text string"), "shingle-texts", small=True)
    return found.where("n_class = 1").select("row", "_text").union(found.where("n_class > 1").groupBy("row").agg(F.first("_text").alias("_text")))


def verified(pairs: DataFrame, heads: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs of classes (``heads``) whose sets are similar enough. The suffix filter compares how the sets spread over hash
    ranges; what it leaves is decided on the whole texts, which meet their pairs by two joins."""
    bins = heads.select("row", F.col("n").alias("size"), "bins")
    both = pairs.join(bins.select(F.col("row").alias("a"), F.col("size").alias("na"), F.col("bins").alias("ba")), "a") \
        .join(bins.select(F.col("row").alias("b"), F.col("size").alias("nb"), F.col("bins").alias("bb")), "b")

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(field(batch, c).to_pylist()), np.uint32).reshape(-1, BINS) for c in ("ba", "bb"))
            most = np.minimum(one, two).sum(1, dtype=np.int64)
            union = field(batch, "na").to_numpy().astype(np.int64) + field(batch, "nb").to_numpy() - most
            keep = pa.array(100 * most >= percent * union)
            yield pa.RecordBatch.from_arrays([field(batch, "a").filter(keep), field(batch, "b").filter(keep)], names=["a", "b"])

    left = written(both.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(suffix, "a long, b long"), "shingle-pairs")
    wanted = left.select(F.col("a").alias("row")).union(left.select("b")).distinct()
    found = texts_of(heads.join(wanted, "row").select("row", "id", "d1", "d2", "n_class"), texts, n)
    both = left.join(found.select(F.col("row").alias("a"), F.col("_text").alias("ta")), "a").join(found.select(F.col("row").alias("b"), F.col("_text").alias("tb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta", 2 << 20):
            for part in slices(iter([batch]), "tb", 2 << 20):
                codes, distinct = encoded(pa.concat_arrays([field(part, "ta"), field(part, "tb")]))
                sets, rows = shingle_sets(distinct, n), part.num_rows
                shared = np.array([overlap(sets[x], sets[y]) for x, y in zip(codes[:rows], codes[rows:])], np.int64)
                sizes = np.array([len(x) for x in sets], np.int64)[codes]
                yield part.select(["a", "b"]).filter(pa.array(100 * shared >= percent * (sizes[:rows] + sizes[rows:] - shared)))

    return written(both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long"), "shingle-links", small=True)


def overlap(one: np.ndarray, two: np.ndarray) -> int:
    """Common members of two sorted sets."""
    both = np.sort(np.concatenate([one, two]))
    return int((both[1:] == both[:-1]).sum())


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set only."""
    return int(s.sum(dtype=np.uint64).astype(np.int64)), int(mixed(s ^ PRIMES[1]).sum(dtype=np.uint64).astype(np.int64))


def placed(docs: DataFrame, key: str, text: str, n: int, percent: int, mark: Column) -> DataFrame:
    """One row per document: (id, mark, n, component: a number, component_id, n_class). ``mark`` goes along with the id."""
    texts = docs.select(F.col(key).cast("long").alias("_id"), mark.alias("_mark"), F.col(text).cast("string").alias("_text"))
    signs = signed(texts, n, percent, frequencies(texts, n))
    classes = written(signs.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("n_class"), F.min("id").alias("least")), "shingle-classes")
    heads = signs.drop("mark").join(classes.select(F.col("head").alias("row"), "n_class"), "row")
    prefixes = heads.select("row", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    own = F.row_number().over(Window.partitionBy("row").orderBy("pos")) - 1  # a window over one prefix
    prefixes = written(prefixes.join(shared, "token").withColumn("s", own), "shingle-prefixes")
    heads = written(heads.drop("prefix"), "shingle-heads")
    tried = written(met(prefixes, percent), "shingle-tried")
    links = verified(tried, heads, texts, n, percent)
    labels = components(links).select(F.col("node").alias("row"), "component")
    links = links.union(verified(untried(unconnected(prefixes, labels), tried, percent), heads, texts, n, percent))
    labels = written(components(links).select(F.col("node").alias("head"), "component"), "shingle-labels")
    classes = classes.join(labels, "head", "left").withColumn("component", F.coalesce("component", "head"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").select("d1", "d2", "n", "component", "component_id", "n_class")
    return signs.select("id", "mark", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left").drop("d1", "d2")


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: (key, n_shingles, component_id, n_class: texts with the same set). ``percent``: least Jaccard
    similarity in hundredths."""
    out = placed(docs, key, text, n, percent, F.lit(0).cast("long"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"))


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """Of each component one row stays: that with the smallest id (null last), of rows that share it the one with the smallest
    hash of its columns, of rows that are alike in all columns any one; rows without n-grams all stay, with all columns."""
    # rows are told apart by their id and a hash of all that can be hashed
    mark = F.xxhash64(*[c for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))])
    found = placed(docs, key, text, n, percent, mark).where("n > 0")
    found = written(found.groupBy("component", "id", "mark").agg(F.count(F.lit(1)).alias("k")), "shingle-rows")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"))
    first = first.select("component", F.col("first.id").alias("_first"), F.col("first.mark").alias("_least"))
    stays = F.col("id").eqNullSafe(F.col("_first")) & (F.col("mark") == F.col("_least"))
    found = written(found.join(first, "component").select(F.col("id").alias("_id"), F.col("mark").alias("_row"), "k", (~stays).alias("gone")).where("gone OR k > 1"), "shingle-verdicts")
    (name,) = absent(docs, "mark")
    marked = docs.withColumn(name, mark)
    these = lambda rows, other: (rows[name] == other["_row"]) & rows[key].cast("long").eqNullSafe(other["_id"])
    gone, again = found.where("gone"), found.where("NOT gone")
    left = marked.join(gone, these(marked, gone), "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    # rows that repeat the one that stays: one of them
    once = marked.join(again, these(marked, again), "left_semi").dropDuplicates([key, name])
    return left.join(again, these(left, again), "left_anti").union(once).select(*docs.columns)
