"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A document's subword ids, with an end id, are one piece; only documents longer than a sequence are cut, from their end, so
that the first piece may be shorter than ``limit`` and the others fill a sequence each. Pieces that fill one need no search.

The others are dealt by hash into shards of about ``SHARD`` pieces, so a task holds a bounded number however many there are. A
member of a shard's population is a whole packing of it, kept as the bin number of each piece. The shard is evolved on ``ISLANDS``
islands, each a group of its own with its own random numbers:

* founders: best fit in order of length, once exactly and else with lengths blurred, and what the pieces were packed in before;
* crossover: a share of the best filled bins of one parent goes whole into the other, whose bins that hold any of the same
  pieces are dissolved; pieces that are then without a bin are best-fitted, longest first. Better children replace the worst members;
* migration: after an epoch, written to the shared folder, each island's best member goes to the next island of its shard. Shards
  with a member of the fewest bins that the sum of lengths allows are settled and take no part in further epochs.

Between rounds the bins with room left (more than ``limit // 64``) are opened again; whole bins of many shards meet in new, fewer
shards, whose founders include the bins as they were. Rounds end with the first that has one shard, or that leaves more than half of its
pieces in open bins. All random numbers follow from round, epoch, shard and island: a lost task repeats its result.

Defined cases: a null text is empty and holds only the end id; equal ids and equal rows are packed as rows of their own; an
empty table gives no pieces; texts of any length (pieces go out in batches of bounded size); ties take the lower bin; only the id and
text columns are read. A special token written in a text counts as the tokenizer takes it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyframe.llm.common import encoded, field, slices, subwords, text_buffers
from tallyframe.session import written

LIMIT, END = 2048, 0
SHARD, ISLANDS, MEMBERS, GENERATIONS, EPOCHS = 2_048, 3, 5, 10, 3
OUT_PIECES = 4_096  # of a batch
BIN_BITS, ROUND_BITS = 16, 57
MEMBER = "shard long, island int, member int, bins int, fitness double, settled boolean, rows array<long>, lengths array<int>, genome array<int>"


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Stretches of the texts that a byte-level tokenizer's pre-tokens never cross, and where each row's start: cut before white space
    that follows a visible ASCII character or a letter U+00C0 to U+00FF. No pre-token holds white space behind anything else."""
    offs, raw = text_buffers(texts)
    space = (raw == 0x20) | (raw >= 0x09) & (raw <= 0x0D)
    solid = (raw > 0x20) & (raw < 0x7F)
    solid[1:] |= raw[:-1] == 0xC3
    start = np.zeros(len(raw) + 1, bool)
    start[1:-1] = space[1:] & solid[:-1]
    start[offs] = True
    at = np.flatnonzero(start[:-1])
    bounds = np.searchsorted(at, offs)
    ends = np.append(at, len(raw)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]), bounds


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids: little-endian unsigned 32-bit) of every document, with the end id."""
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(tokenizer)
        for batch in slices(batches, "_text", 6 << 20):
            found, bounds = units(field(batch, "_text"))
            ids, ends = coder.expanded(*encoded(found), bounds)
            sizes = np.diff(ends, prepend=0) + 1
            ids = np.insert(ids.astype("<u4"), ends, end)
            first = (sizes - 1) % limit + 1
            number = 1 + (sizes - first) // limit
            doc = np.repeat(np.arange(batch.num_rows), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            length = np.where(piece == 0, first[doc], limit)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * limit)
            at = np.append(0, np.cumsum(length))
            for a in range(0, len(doc), OUT_PIECES):
                b = min(a + OUT_PIECES, len(doc))
                held = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * (at[a:b + 1] - at[a])).astype(np.int32)), pa.py_buffer(ids[at[a]:at[b]])])
                yield pa.RecordBatch.from_arrays([field(batch, "_id").take(pa.array(doc[a:b])), pa.array(piece[a:b].astype(np.int32)), pa.array(start[a:b]), pa.array(length[a:b]), held],
                                                 names=["doc_id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, order: np.ndarray, genome: np.ndarray, fill: list[int], limit: int) -> None:
    """Puts the pieces of ``order`` into the fullest bin with room, or a new one; changes ``genome`` and ``fill``."""
    scale = len(fill) + len(order) + 1
    room = sorted((limit - f) * scale + b for b, f in enumerate(fill) if f < limit)
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        at = bisect.bisect_left(room, length * scale)
        if at < len(room):
            left, chosen = divmod(room.pop(at), scale)
        else:
            left, chosen = limit, len(fill)
            fill.append(0)
        genome[i] = chosen
        fill[chosen] += length
        if left > length:
            bisect.insort(room, (left - length) * scale + chosen)


class Island:
    """The members of one island: packings of the same pieces, longest first."""

    def __init__(self, lengths: np.ndarray, limit: int, seed: list[int]):
        self.lengths, self.limit, self.random = lengths, limit, np.random.default_rng(seed)
        self.least = -(-int(lengths.sum()) // limit)
        self.members: list[tuple[int, float, np.ndarray]] = []

    def add(self, genome: np.ndarray) -> None:
        """Few bins first; of equally many, those with full ones."""
        genome = np.unique(genome, return_inverse=True)[1].astype(np.int32)
        fill = np.bincount(genome, self.lengths) / self.limit
        self.members.append((len(fill), float(-(fill * fill).mean()), genome))
        self.members.sort(key=lambda m: m[:2])

    def settled(self) -> bool:
        return bool(self.members) and self.members[0][0] == self.least

    def found(self, before: np.ndarray | None, size: int) -> None:
        if before is not None:
            self.add(before)
        for k in range(size):
            if self.settled():
                return
            blurred = self.lengths * (1 + (0.1 * k) * self.random.random(len(self.lengths)))
            genome = np.zeros(len(self.lengths), np.int32)
            best_fit(self.lengths, np.argsort(-blurred, kind="stable"), genome, [], self.limit)
            self.add(genome)

    def crossed(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """``one`` with well-filled bins of ``other``: those at least as full as the mean go over with even chances."""
        fill = np.bincount(other, self.lengths)
        given = (fill >= fill.mean()) & (self.random.random(len(fill)) < 0.5)
        taken = given[other]
        lost = np.zeros(int(one.max()) + 1, bool)
        lost[one[taken]] = True
        homeless = lost[one] & ~taken
        genome = np.where(taken, len(lost) + other, one)
        settled = ~homeless
        bins, genome[settled] = np.unique(genome[settled], return_inverse=True)
        best_fit(self.lengths, np.flatnonzero(homeless), genome, np.bincount(genome[settled], self.lengths[settled], len(bins)).astype(np.int64).tolist(), self.limit)
        return genome

    def evolve(self, generations: int, size: int) -> None:
        for _ in range(generations):
            if self.settled() or len(self.members) < 2:
                break
            # of two drawn members the better one is a parent
            one, other = (min(self.random.choice(len(self.members), 2, replace=False)) for _ in range(2))
            if one == other:
                other = len(self.members) - 1 if one != len(self.members) - 1 else 0
            self.add(self.crossed(self.members[one][2], self.members[other][2]))
            del self.members[size:]

    def table(self, shard: int, island: int, rows: np.ndarray) -> pa.Table:
        n = len(self.members)
        listed = lambda arrays, kind: pa.array([a.tolist() for a in arrays], pa.list_(kind))
        return pa.table([pa.array([shard] * n, pa.int64()), pa.array([island] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([m[0] for m in self.members], pa.int32()),
                         pa.array([m[1] for m in self.members]), pa.array([self.settled()] * n), listed([rows] * n, pa.int64()), listed([self.lengths] * n, pa.int32()), listed([m[2] for m in self.members], pa.int32())],
                        names=["shard", "island", "member", "bins", "fitness", "settled", "rows", "lengths", "genome"])


def settlers(opened: DataFrame, shards: int, turn: int, limit: int) -> DataFrame:
    """The first epoch: ``opened`` (row, length, bin: the bin before, or null) in shards on islands, as rows of ``MEMBER``."""
    # pieces that shared a bin stay together
    shard = F.pmod(F.xxhash64(F.coalesce("bin", "row"), F.lit(turn)), F.lit(shards))
    here = opened.select("row", F.col("length").cast("int").alias("length"), "bin", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))

    def start(key: tuple, group: pa.Table) -> pa.Table:
        shard, island = (k.as_py() for k in key)
        rows, lengths = group["row"].to_numpy(), group["length"].to_numpy().astype(np.int64)
        order = np.lexsort((rows, -lengths))
        held = Island(lengths[order], limit, [turn, 0, shard, island])
        before = np.unique(group["bin"].to_numpy()[order], return_inverse=True)[1] if not group["bin"].null_count else None
        held.found(before, MEMBERS)
        held.evolve(GENERATIONS, MEMBERS)
        return held.table(shard, island, rows[order])

    return here.groupBy("shard", "island").applyInArrow(start, MEMBER)


def migrated(members: DataFrame, turn: int, epoch: int, limit: int) -> DataFrame:
    """A further epoch, in which every island also has the best member of the island before it."""
    elite = members.where("member = 0").withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")).withColumn("member", F.lit(-1))

    def go_on(key: tuple, group: pa.Table) -> pa.Table:
        shard, island = (k.as_py() for k in key)
        group = group.sort_by("member")
        held = Island(np.array(group["lengths"][0].as_py(), np.int64), limit, [turn, epoch, shard, island])
        for genome in group["genome"]:
            held.add(np.array(genome.as_py(), np.int32))
        held.evolve(GENERATIONS, MEMBERS)
        return held.table(shard, island, np.array(group["rows"][0].as_py(), np.int64))

    return members.unionByName(elite).groupBy("shard", "island").applyInArrow(go_on, MEMBER)


def laid_out(best: DataFrame, turn: int) -> DataFrame:
    """(row, length, bin, offset, fill) of the chosen members' pieces; bins are numbered by round, shard and bin."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rows, lengths, genome in zip(*(field(batch, c) for c in ("shard", "rows", "lengths", "genome"))):
                rows, lengths, genome = (x.values.to_numpy().astype(np.int64) for x in (rows, lengths, genome))
                if genome.max() >> BIN_BITS:
                    raise ValueError("a shard with more bins than its numbers allow")
                order = np.argsort(genome, kind="stable")
                ends = np.cumsum(lengths[order])
                fill = np.bincount(genome, lengths).astype(np.int64)
                offset = ends - lengths[order] - np.repeat(np.cumsum(fill) - fill, np.bincount(genome))
                name = (turn << ROUND_BITS) + (shard.as_py() << BIN_BITS) + genome[order]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[order], lengths[order], name, offset, fill[genome[order]])], names=["row", "length", "bin", "offset", "fill"])

    return best.mapInArrow(places, "row long, length long, bin long, offset long, fill long")


def packed(rows: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """(row, sequence_id, offset) for ``rows`` (row: unique and not negative, length: 1 to ``limit``), which are read several times: give a
    written table."""
    opened = rows.where(F.col("length") < limit).select("row", "length", F.lit(None).cast("long").alias("bin"))
    out = rows.where(F.col("length") == limit).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    many, turn = opened.count(), 0
    while many:
        shards = -(-many // shard)
        members, done = written(settlers(opened, shards, turn, limit), "packing-members"), None
        for epoch in range(1, EPOCHS):
            settled = members.where("settled").select("shard").distinct()
            ready = members.join(settled, "shard", "left_semi")
            done = ready if done is None else done.unionByName(ready)
            if members.count() == ready.count():
                members = None
                break
            members = written(migrated(members.join(settled, "shard", "left_anti"), turn, epoch, limit), "packing-members")
        every = done if members is None else done.unionByName(members)
        best = every.groupBy("shard").agg(F.min_by(F.struct("rows", "lengths", "genome"), F.struct("bins", "fitness", "island", "member")).alias("_best")).select("shard", "_best.*")
        placed = written(laid_out(best, turn), "packing-bins")
        room = F.col("fill") < limit - limit // 64
        left = placed.where(room).count()
        last = shards == 1 or 2 * left > many
        final = placed if last else placed.where(~room)
        out = out.unionByName(final.select("row", F.col("bin").alias("sequence_id"), "offset"))
        opened, many, turn = placed.where(room).select("row", "length", "bin"), 0 if last else left, turn + 1
    return out


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from rows (sequence_id, offset, ids). A sequence is at most ``limit`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.expr("aggregate(_parts, cast('' as binary), (all, part) -> concat(all, part.ids))").alias("ids"))
