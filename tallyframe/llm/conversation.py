"""Conversation structure repair: the cheapest edits that make a conversation alternate, streamed in turn order.

Roles count by their first letter: s(ystem), u(ser), a(ssistant), any other. A whole conversation reads ``(s?(ua)+)?``. A row's first
fault counts: blank (no character but white space), duplicate (role and text seen earlier), truncated (no sentence end).
Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and duplicate rows), Insert a row without
text 3; a truncated row that stays adds 3. Of equally cheap edit sequences the one least in ASCII order is taken.

One shuffle brings a conversation's rows into one partition; every pass after it streams that partition, sorted outside
memory by Spark:

1. duplicates: a running number per (conversation, role and text) in turn order;
2. backwards (latest turn first): the cost of the rest from each of the four grammar states is carried from batch to batch.
   Each row gets its backpointers: one byte, two bits a state. They are not kept in the task: they go out as a column
   of the rows, and Spark's next sort spills them with the rows. So a conversation of any length needs the same memory, no
   task writes a file of its own, and a lost executor's rows come back by lineage;
3. forwards (earliest turn first): the walk along the bytes gives the edits, one row each;
4. ``audited`` folds the edit rows of a conversation into one row while they stream by. Only its edit letters grow with it.

Defined cases: null roles and texts count as one space; null turns come first; rows of one turn are ordered by role, then
text; equal rows of one turn stand beside each other, and all but one are duplicates; rows with a null conversation id form one conversation;
rows that are not ``present`` take no part, but their conversation is reported (no present rows: no edits, all counts 0,
the hash of an empty string); an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.llm.common import field, slices

START, SYSTEM, USER, ASSISTANT = range(4)  # grammar states: nothing read, or the last role
#: State after a role (first letter s, u, a) where the grammar allows it; state after the role that Insert and Rerole give.
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DIKR"  # in ASCII order, two bits each
DELETE, INSERT, RETAIN, REROLE = range(4)
COSTS = (4, 3, 0, 3)
TRUNCATED = 3
#: Cost from a state to an accepting one behind the last row.
CLOSING = (0, 2 * COSTS[INSERT], COSTS[INSERT], 0)
FINE, CUT, GONE, ABSENT = range(4)  # what a row's fault means for its edits
SPACE = "\x20\t\n\x0b\x0c\r"


@functools.lru_cache(None)
def step(rest: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """One row back: the cost of the rest from each state with this row (less the least of them), and the row's byte. Costs
    relative to the least take few values, so that each case is computed once."""
    letter, fault = kind % 4, kind // 4
    if fault == ABSENT:
        return rest, 0
    extra = TRUNCATED if fault == CUT else 0
    options = [[COSTS[DELETE] + rest[s], None, None, None] for s in range(4)]
    if fault != GONE:
        for s in range(4):
            options[s][REROLE] = COSTS[REROLE] + extra + rest[NEXT[s]]
            if (s, letter) in KEEP:
                options[s][RETAIN] = extra + rest[KEEP[s, letter]]
    cost = [min(x for x in o if x is not None) for o in options]
    for _ in range(3):
        cost = [min(cost[s], COSTS[INSERT] + cost[NEXT[s]]) for s in range(4)]
    byte = 0
    for s in range(4):
        options[s][INSERT] = COSTS[INSERT] + cost[NEXT[s]]
        byte |= options[s].index(cost[s]) << 2 * s
    return tuple(c - min(cost) for c in cost), byte


def backpointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, latest first, with their byte."""
    now, rest, first = None, CLOSING, True
    for batch in batches:
        out = np.zeros(batch.num_rows, np.int16)
        for i, (conv, kind) in enumerate(zip(field(batch, "_conv").to_pylist(), field(batch, "_kind").to_pylist())):
            if conv != now or first:
                now, rest, first = conv, CLOSING, False
            rest, out[i] = step(rest, kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "_byte"])


class Walk:
    """Forwards through the rows: collects the edits of a batch as parallel lists."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.now, self.state, self.place = kind, None, None, 0
        self.clear()

    def clear(self) -> None:
        self.conv, self.row, self.places, self.edit, self.given = [], [], [], [], []

    def put(self, row: int | None, edit: str, role: str | None) -> None:
        self.conv.append(self.now)
        self.row.append(row)
        self.places.append(self.place)
        self.edit.append(edit)
        self.given.append(role)
        self.place += 1

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.put(None, "I", NAMES[self.state])

    def close(self) -> None:
        while self.state in (SYSTEM, USER):
            self.insert()

    def read(self, i: int, conv, kind: int, byte: int) -> None:
        if self.state is None or conv != self.now:
            self.close()
            self.now, self.state, self.place = conv, START, 0
        if kind // 4 == ABSENT:
            return self.put(i, "", None)
        while (edit := byte >> 2 * self.state & 3) == INSERT:
            self.insert()
        if edit == RETAIN:
            self.state = KEEP[self.state, kind % 4]
        elif edit == REROLE:
            self.state = NEXT[self.state]
        self.put(i, LETTERS[edit], NAMES[self.state] if edit == REROLE else None)

    def batch(self, rows: pa.RecordBatch | None) -> pa.RecordBatch:
        """What was collected since the last call; ``rows`` are those that its row numbers mean."""
        at = pa.array(self.row, pa.int64())
        took = [field(rows, c).take(at) if rows is not None else pa.nulls(len(at), t) for c, t in
                (("_turn", pa.int64()), ("_role", pa.string()), ("_text", pa.string()), ("_kind", pa.int32()), ("_fault", pa.string()))]
        given = pa.array(self.given, pa.string())
        columns = [pa.array(self.conv, self.kind), pa.array(self.places, pa.int64()), took[0], pa.array(self.edit, pa.string()), pc.coalesce(given, took[1]),
                   took[1], took[2].fill_null(""), took[3], took[4]]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, names=["conv", "place", "turn", "edit", "role", "role_before", "text", "kind", "fault"])


def edits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The edits, one row each: (conv, place: their order, turn, edit: K, R, D, I or empty for rows that are not present, role: after
    the edit, role_before: null if inserted, text, kind, fault: blank, duplicate, truncated or null). The repaired conversation is
    the rows with edit K, R or I by place. Rows of a conversation stay in one partition in order of place."""
    rows = rows.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_role"),
                       F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("_text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("_present"))
    same = F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)
    rows = rows.repartition("_conv").withColumn("_same", same)
    seen = F.row_number().over(Window.partitionBy("_conv", "_same", "_present").orderBy(F.col("_turn").asc_nulls_first()))
    rows = rows.withColumn("_again", seen > 1)
    end = F.right(F.rtrim("_text", F.lit(SPACE)), F.lit(1))
    fault = F.when(~F.col("_present"), None).when(end == "", "blank").when(F.col("_again"), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    letter = F.when(F.col("_role").startswith("s"), 0).when(F.col("_role").startswith("u"), 1).when(F.col("_role").startswith("a"), 2).otherwise(3)
    effect = F.when(~F.col("_present"), ABSENT).when(F.col("_fault").isin("blank", "duplicate"), GONE).when(F.col("_fault") == "truncated", CUT).otherwise(FINE)
    rows = rows.withColumn("_fault", fault).withColumn("_kind", (letter + 4 * effect).cast("int"))
    rows = rows.select("_conv", "_turn", "_role", "_text", "_again", "_kind", "_fault")
    order = ["_conv", "_turn", "_role", "_text", "_again"]
    late = rows.sortWithinPartitions(*[F.col(c).desc() for c in order])
    kind = rows.schema["_conv"].dataType.simpleString()
    marked = late.mapInArrow(backpointers, f"_conv {kind}, _turn long, _role string, _text string, _again boolean, _kind int, _fault string, _byte smallint")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = None
        for batch in slices(batches, "_text"):
            walker = walker or Walk(field(batch, "_conv").type)
            for i, row in enumerate(zip(*(field(batch, c).to_pylist() for c in ("_conv", "_kind", "_byte")))):
                walker.read(i, *row)
            yield walker.batch(batch)
        if walker:
            walker.close()
            yield walker.batch(None)

    early = marked.sortWithinPartitions(*[F.col(c).asc() for c in order])
    return early.mapInArrow(walk, f"conv {kind}, place long, turn long, edit string, role string, role_before string, text string, kind int, fault string")


class Audit:
    """What is counted of one conversation while its edits stream by."""

    LEGAL = {(0, 1), (1, 2), (2, 1)}

    def __init__(self, conv):
        self.conv, self.hash, self.first, self.letters = conv, hashlib.sha256(), True, []
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0

    def read(self, turn, edit, role, text, kind, fault) -> None:
        if edit == "":
            return
        self.letters.append(edit)
        self.cost += COSTS[LETTERS.index(edit)]
        if kind is not None:
            self.illegal += self.last is not None and (self.last, kind % 4) not in self.LEGAL
            self.last = kind % 4
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if fault:
                setattr(self, fault, getattr(self, fault) + 1)
                self.cost += TRUNCATED * (fault == "truncated" and edit != "D")
        if edit != "D":
            self.hash.update((b"" if self.first else b"\n") + role + b":")
            self.hash.update(text)
            self.first = False

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest()


def audited(edited: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation from the rows of ``edits``, which must still stand as that returned them: (conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[conv, *names])

        for batch in batches:
            kind, done = field(batch, "conv").type, []
            columns = [field(batch, c).to_pylist() for c in ("conv", "turn", "edit")]
            columns += [field(batch, c).cast(pa.binary()).to_pylist() for c in ("role", "text")]
            columns += [field(batch, c).to_pylist() for c in ("kind", "fault")]
            for c, *row in zip(*columns):
                if now is None or c != now.conv:
                    if now:
                        done.append(now.row())
                    now = Audit(c)
                now.read(*row)
            if done:
                yield out(done)
        if now:
            yield out([now.row()])

    types = f"`{conv}` {edited.schema['conv'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[:6]) + ", audit string, repaired_sha256 string"
    return edited.mapInArrow(fold, types)
