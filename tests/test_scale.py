"""Work that is done once, in many tasks, and moves texts instead of their parts; the results are those of the plain ways."""

import collections
import math
import random

from pyspark.sql import functions as F

from tallyframe.functions import checks
from tallyframe.operators import corpus, identify, ngram, specdoc
from tallyframe.plans import q_synth
from tallyframe.session import by_key, spread


def planned(df):
    """The plan that is run."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_f1_generators_run_in_many_tasks(spark, tmp_path):
    spark.range(500).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = q_synth.customers(spark, str(tmp_path))
    assert len({r[0] for r in rows.select(F.spark_partition_id()).distinct().collect()}) > 4
    assert sorted(r[0] for r in rows.collect()) == list(range(500))
    many = spark.range(500).repartition(5)
    many.write.parquet(f"{tmp_path}/many")
    assert "RoundRobin" not in planned(spread(spark.read.parquet(f"{tmp_path}/many")))  # five files, four cores


def luhn(digits, doubled):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == doubled else 1)
        total += d - 9 * (d > 9)
    return total


def test_f11_luhn_of_any_length(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("0123456789") for _ in range(n)) for n in range(41) for _ in range(6)] + [None, "4111 1111-1111 1111", "0" * 13]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").selectExpr("x", f"{checks.luhn_ok('x')} as ok", f"{checks.luhn_check_digit('x')} as digit").collect()
    for r in rows:
        d = "".join(c for c in r["x"] or "" if c.isdigit())
        assert r["ok"] == (len(d) >= 13 and luhn(d, 1) % 10 == 0), r
        if r["x"] is None or r["x"] == d:
            assert r["digit"] == (None if r["x"] is None else -luhn(d, 0) % 10), r
    assert "cast(v as bigint)" in checks.luhn_ok("x")  # a card number is looked up pair by pair, not digit by digit


def test_f10_f12_texts_travel_to_their_key(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (1, "abc"), (2, " \n"), (3, None), (None, "abab"), (4, "a b a b a b a")], "doc_id long, text string")
    model = ngram.model(spark.createDataFrame([("f", "abc"), ("f", "abd")], "field string, text string"), "field", "text")
    looked = ngram.lookup(docs, model, "doc_id", "text")
    assert planned(looked).count("Exchange hashpartitioning") == 1
    found = {(r["doc_id"], r["context"] + r["next"]): (r["n"], r["p"]) for r in looked.collect()}
    grams = lambda t: [f"^^{t}$"[i:i + 3] for i in range(len(t) + 1)]
    want = collections.Counter((k, g) for k, t in ((1, "abcabc"), (1, "abc"), (None, "abab"), (4, "a b a b a b a")) for g in grams(t))
    assert {k: n for k, (n, _) in found.items()} == dict(want)
    assert found[1, "^^a"] == (2, 1.0) and found[1, "abc"] == (3, 0.5) and found[1, "bca"] == (1, ngram.FLOOR)
    rates = corpus.repetition_rate(docs)
    assert planned(rates).count("g#") == 0 or "hashpartitioning(doc_id" in planned(rates) and "hashpartitioning(doc_id#" in planned(rates) and ", g#" not in "".join(
        x for x in planned(rates).splitlines() if "Exchange" in x)
    assert {r["doc_id"]: r["repetition"] for r in rates.collect()}[4] == 1.0
    left = corpus.bigram_profile(by_key(docs, "doc_id", "text"), ["doc_id"])
    right = spark.createDataFrame([("ab", 2), ("zz", 1)], "bigram string, m long")
    cosine = identify.cosine(left, right, "doc_id", "bigram")
    assert planned(cosine).count("Exchange hashpartitioning") == 1
    assert math.isclose({r["doc_id"]: r["overlap"] for r in cosine.collect()}[1], round(3 * 2 / math.sqrt(5 * (9 + 9 + 1)), 6))


def test_f2_f6_ids_are_made_once(spark):
    texts = spark.createDataFrame([(2, "añ😀b"), (1, "ab" * 40), (3, ""), (4, None)], "k long, text string")
    ids = ngram.encode(texts, "text", ngram.char_vocabulary(texts.filter("k = 1"), "text"))
    assert {r["k"]: r["ids"] for r in ids.collect()} == {1: [4, 5] * 40, 2: [4, 3, 3, 5], 3: [], 4: None}
    found = ngram.stream_windows(ids, "k", 8, 4)
    assert "ArrowEvalPython" not in planned(found)
    assert "Exchange hashpartitioning(_segment" in planned(found)  # also where all texts are one chunk
    stream = [4, 5] * 40 + [4, 3, 3, 5]
    assert sorted((r["start"], r["x"], r["y"]) for r in found.collect()) == [(s, stream[s:s + 8], stream[s + 1:s + 9]) for s in range(0, len(stream) - 8, 4)]


def test_f7_terms_are_counted_once(spark):
    texts = spark.createDataFrame([("a", "pan pan x"), ("a", "amount"), ("b", "nothing"), (None, "pan")], "k string, line string")
    terms = spark.createDataFrame([("s", "pan", 2), ("s", "amount", 1), ("t", "pan", 1)], "spec string, term string, weight long")
    scores = identify.similarity(identify.term_counts(texts, "k", "line"), "k", terms)
    assert planned(scores).count("regexp_extract_all") == 1
    assert {(r["k"], r["spec"]): r["score"] for r in scores.collect()} == {("a", "s"): round(5 / math.sqrt(6 * 5), 6), ("a", "t"): round(2 / math.sqrt(6), 6)}


def test_f19_lines_of_spec_documents_are_matched_once(spark):
    lines = spark.createDataFrame([("s", 1, "ACCOUNT NO  1-5  5  AN"), ("s", 2, "# no"), ("t", 1, "BALANCE: amount due 12")], "spec string, line_no long, line string")
    learned = specdoc.learn(lines)
    assert "RLIKE" not in planned(learned)
    assert {(r["spec"], r["name"], r["start"], r["end"]) for r in learned.collect()} == {("s", "ACCOUNT_NO", 1, 5), ("t", "BALANCE", 1, 12)}
