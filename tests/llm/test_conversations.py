"""Conversation repair against an exhaustive search over edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import conversation
from tallyframe.llm.q_conversations import damaged, op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, place int, edit string, _conv int, kind string"
GRAMMAR = re.compile("(s?(ua)+)?")
BLANK = "\x20\t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out += [(conv, turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, roles and texts) by trying every edit; insertions up to two before any row and at the end."""
    def after(prefix):  # is prefix the start of a legal conversation
        return any(GRAMMAR.fullmatch(prefix + rest) for rest in ("", "a", "ua"))

    @functools.lru_cache(None)
    def best(i, initials, inserted):
        # initials: only what the grammar needs of them
        found = []
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            found.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if after(initials + role[0]):
                    cost, audit, kept = best(i, tail(initials + role[0]), inserted + 1)
                    found.append((3 + cost, "I" + audit, ((role, ""), *kept)))
        if i < len(rows):
            cost, audit, kept = best(i + 1, initials, 0)
            found.append((4 + cost, "D" + audit, kept))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                for edit, price, role in (("K", 0, rows[i][2]), ("R", 3, "user"), ("R", 3, "assistant")):
                    if role[:1] and after(initials + role[0]):
                        cost, audit, kept = best(i + 1, tail(initials + role[0]), 0)
                        found.append((price + extra + cost, edit + audit, ((role, rows[i][3]), *kept)))
        return min(found, default=(10**9, "", ()))

    def tail(initials):
        return initials if len(initials) < 4 else initials[-2:] if initials[-1] == "a" else "ua" + initials[-1]

    return best(0, "", 0)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damage(r for r in rows if r[0] == conv)), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in mine:
            left = text.strip(BLANK)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in mine if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, kept = cheapest(mine, faults)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def made():
    rng = random.Random(3)
    rows = [(None, 1, "user", "No id."), (None, None, None, None), (7, None, "user", "No turn."), (7, 5, "assistant", "Yes!"), (8, 1, "", "no role"), (8, 2, "User", "Upper."), (9, 1, "user", ""), (9, 1, "user", "Tie."), (9, 1, "user", "Tie."),
            (10, 1, "system", "long " * 50_000), (-1, 10**15, "assistant", "é "), (-1, -5, "tool", "漢字?")]
    for conv in range(100, 400):
        turn = 0
        for k in range(rng.randint(1, 9)):
            turn += rng.choice((1, 1, 1, 2, 5))
            role = rng.choice(("user", "assistant")) if rng.random() < 0.5 else ("user", "assistant")[k % 2]
            role = "system" if rng.random() < 0.15 else role
            rows.append((conv, turn, role, rng.choice(("Yes.", "No!", "Why?", "cut off", " ", "done. \n", "e.g. this"))))
    dropped = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Dropped.")], dropped


@pytest.fixture(scope="module")
def rows():
    return made()[0]


def query(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(3)
    out = conversation.audited(conversation.edits(damaged(docs), present=F.col("present")))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def test_repair_equals_exhaustive_search(spark, rows):
    got, want = query(spark, rows), expected(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}
    assert got[made()[1]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {letter for row in got.values() for letter in row[6]} == set("DIKR")


def test_state_is_carried_across_batches(spark, rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert query(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_edit_rows_make_the_repaired_conversation(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "assistant", "Hello."), (1, 3, "assistant", "Again."), (1, 4, "user", " "), (1, 5, "user", "Bye."), (2, 1, "user", "Same."), (2, 2, "assistant", "One."), (2, 3, "user", "Same.")]
    got = conversation.edits(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv", "place").collect()
    by = [[(r["edit"], r["role"], r["role_before"], r["fault"]) for r in got if r["conv"] == c] for c in (1, 2)]
    assert by[1] == [("K", "user", "user", None), ("K", "assistant", "assistant", None), ("D", "user", "user", "duplicate")]
    kept = "".join(r[1][0] for r in by[0] if r[0] in "KRI")
    assert GRAMMAR.fullmatch(kept) and by[0][-2][0] == "I" or by[0][-1][0] == "I"


def test_giant_conversation(spark):
    giant = spark.range(60_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                       F.concat(F.lit("Text "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    row = conversation.audited(conversation.edits(giant)).collect()
    whole = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:Text {i}." for i in range(60_000))
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "K" * 60_000, hashlib.sha256(whole.encode()).hexdigest())]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert op11_conversation_repair(spark, str(tmp_path)).collect() == []
