"""The document operators against brute force on a small fixture with every awkward case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from tallyframe.llm import attention_lm, common, jaccard, langid, mixing, phrase_index, quality, suffix_dedup, token_files
from tallyframe.llm.q_documents import TARGETS, tokenizer

BLANK = re.compile("[^\x20\x09-\x0D]+")
LETTERS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# other columns clash with names that the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, row int, n int, template string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def made():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(300)
    common_passage = text(70)
    texts = [None, "", " \n\t ", "One", "Two words", base, base, base.upper(), base + " tail", "x " + base, common_passage + "\n" + text(80), text(60) + "\n" + common_passage, common_passage,
             text(4000), "the same line\n" * 40, "a" * 500, "a" * 400, "b\n" + "ab" * 300, "é" * 200, "#** " * 80, "<|endoftext|> it's I'M", "tab\tsep\x0bvt\x0cff\rcr", "\U0001F600 emoji 漢字 " * 10]
    for k in range(12):  # near copies of one text
        near = base.split()
        for _ in range(rng.randint(1, 6)):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [text(rng.randint(1, 200)) for _ in range(40)]
    return [(i * 3 + 1, t, ["en", "fr", None][i % 3], "s", 1, 2, 3, "t") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def twice(spark, rows):
    """Repeated rows, a repeated id with another text, and a null id."""
    return spark.createDataFrame([*rows[:30], *rows[:10], (rows[5][0], "other text of the same id", *rows[5][2:]), (None, rows[5][1], *rows[5][2:])], SCHEMA)


def test_words_are_cut_as_the_patterns_say(rows):
    texts = pa.array([r[1] for r in rows] + ["A-b_c9 É", "{|}x"], pa.string())
    for table, pattern in ((common.blank_separated(True), BLANK), (common.letter_words(), LETTERS)):
        words, bounds = common.cut_words(texts, table)
        got = [[w.decode() for w in words[a:b].to_pylist()] for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [pattern.findall(lower(t)) for t in texts.to_pylist()]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (3, 40), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 40: 1, 10: 10, 11: 10, 12: 10}


# -- op2


def contamination(texts, items):
    windows = collections.defaultdict(set)
    for name, t in items:
        w = LETTERS.findall(lower(t))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(name)
    out = []
    for t in texts:
        w, hit, own = LETTERS.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    own |= windows[tuple(w[i:i + n])]
        digest = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((len(w), len(hit), len(own), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def items_of(rows):
    return [(10, rows[12][1]), (9, "Two, words!"), (8, None), (7, "..."), (6, " ".join(rows[13][1].split()[100:140])), (10, rows[12][1]), (5, "no such words here at all")]


def test_decontamination(spark, rows, docs, empty, twice):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = dict(zip([r[0] for r in rows], contamination([r[1] for r in rows], [(str(i), t) for i, t in items])))
    got = {int(r.doc): tuple(r[1:]) for r in phrase_index.checked(docs, bench).collect()}
    assert got == want and any(v[4] for v in want.values())
    assert phrase_index.checked(empty, bench).count() == 0
    assert phrase_index.checked(docs, bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    assert phrase_index.checked(twice, bench).count() == twice.count()
    left = phrase_index.clean_documents(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, v in want.items() if not v[4]}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y y gamma"), (2, "alpha x x x beta gamma"), (3, "alpha beta"), (4, "gamma beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = phrase_index.build(docs)
    hits = phrase_index.matches(index, items, slop=2)
    keys = index.where("term IS NULL").select("segment", "keys", "words").collect()
    found = set()
    for h in hits.collect():
        row = next(k for k in keys if k.segment == h.segment)
        found.add(row["keys"][int(np.searchsorted(np.cumsum(row.words), h.position, side="right"))])
    assert found == {"1"}
    assert phrase_index.matches(index, items).count() == 0
    place = phrase_index.located(index, phrase_index.matches(index, spark.createDataFrame([(2, "x beta y")], "item_id long, text string"))).collect()
    assert [(r.doc, r.item, r.position, r.length) for r in place] == [("1", "2", 1, 3)]


def test_proximity_stays_in_its_document(spark):
    """Documents of one segment: a sequence over their border is no match, one whose rarest word stands at a document's end is."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta gamma"), (3, "alpha x beta y gamma"), (4, "alpha alpha beta"), (5, "x gamma")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = phrase_index.build(docs)
    assert index.where("term IS NULL").count() == 1
    place = phrase_index.located(index, phrase_index.matches(index, items, slop=1)).collect()
    assert [(r.doc, r.item, r.position, r.length) for r in place] == [("3", "1", 0, 5)]
    got = {r.doc: (r.n_hit, r.n_items, r.n_near, r.n_near_items) for r in phrase_index.checked(docs, items, slop=1).collect()}
    assert got == {"1": (0, 0, 0, 0), "2": (0, 0, 0, 0), "3": (0, 0, 5, 1), "4": (0, 0, 0, 0), "5": (0, 0, 0, 0)}


def test_proximity_equals_brute_force(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices("abcdx", k=rng.randint(0, 25))) for _ in range(60)]
    item = "a b c d"
    for slop in (1, 2):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
        got = {int(r.doc): r.n_near_items for r in phrase_index.checked(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), slop=slop).collect()}
        for i, t in enumerate(texts):
            reach = {k for k, w in enumerate(t.split()) if w == "a"}
            for w in "bcd":
                reach = {k for k, x in enumerate(t.split()) if x == w and any(0 < k - j <= slop + 1 for j in reach)}
            assert got[i] == int(bool(reach)), t


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_only_windows_that_may_be_read_are_read(monkeypatch, slop):
    """Every window with a reading is found, and of windows without any nearly none is read in full."""
    rng = random.Random(slop)
    text = [rng.choice("abcdefghijklmnop") for _ in range(3000)]
    items = [text[at:at + 20] for at in range(0, 2000, 100)] + [[rng.choice("abcdefghijklmnop") for _ in range(20)] for _ in range(60)]
    terms = sorted(set(text))
    at = {t: np.array([i for i, w in enumerate(text) if w == t], np.int32) for t in terms}
    uses = [[{"row": r, "item": str(r), "place": p, "length": 20} for r, words in enumerate(items) for p, w in enumerate(words) if w == t] for t in terms]
    group = pd.DataFrame({"positions": [np.diff(at[t], prepend=np.int32(0)).astype(np.int32).tobytes() for t in terms], "uses": uses})
    calls = collections.Counter()
    for name in ("spans", "exact"):
        monkeypatch.setattr(phrase_index, name, lambda *a, f=getattr(phrase_index, name): (calls.update(["read"]), f(*a))[1])
    got = phrase_index.matcher(8, slop)((3, 0), group)
    read = calls["read"]
    want = collections.Counter()
    for r, words in enumerate(items):
        for s in range(13):
            run = [at[w].astype(np.int64) for w in words[s:s + 8]]
            first, last = phrase_index.spans(run, slop)[1:] if slop else ((x := phrase_index.exact(run)), x + 7)
            want.update((str(r), int(a), int(b - a + 1)) for a, b in zip(first, last))
    assert collections.Counter(zip(got["item"], got["position"], got["length"])) == want and len(want) >= 20 * 13
    assert read < 0.6 * 80 * 13


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_windows_read_no_far_positions_of_frequent_words(monkeypatch, slop):
    """The other terms' positions are cut to those near the rarest term's, and the readings are those over all positions."""
    rng = random.Random(slop)
    text = [rng.choice(["the", "of", "the", "and", f"w{rng.randint(0, 300)}"]) for _ in range(20_000)]
    items = [text[at:at + 9] for at in range(0, 20_000, 400)] + [["w1", "the", "the", "of"], ["the", "w2", "and", "the", "w3"]]
    terms = sorted({w for words in items for w in words})
    at = {t: np.array([i for i, w in enumerate(text) if w == t], np.int64) for t in terms}
    uses = [[{"row": r, "item": str(r), "place": p, "length": len(words)} for r, words in enumerate(items) for p, w in enumerate(words) if w == t] for t in terms]
    group = pd.DataFrame({"positions": [np.diff(at[t], prepend=0).astype(np.int32).tobytes() for t in terms], "uses": uses})
    want, whole, sizes = collections.Counter(), 0, []
    for r, words in enumerate(items):
        for s in range(max(1, len(words) - 4)):
            run = [at[w] for w in words[s:s + 5]]
            first, last = phrase_index.spans(run, slop)[1:] if slop else ((x := phrase_index.exact(run)), x + len(run) - 1)
            want.update((str(r), int(a), int(b - a + 1)) for a, b in zip(first, last))
            whole += sum(map(len, run))
    for name in ("spans", "exact"):
        monkeypatch.setattr(phrase_index, name, lambda *a, f=getattr(phrase_index, name): (sizes.append(sum(map(len, a[0]))), f(*a))[1])
    got = phrase_index.matcher(5, slop)((3, 0), group)
    assert collections.Counter(zip(got["item"], got["position"], got["length"])) == want and len(want) >= 200
    assert sum(sizes) < 0.2 * whole


# -- op3


def without_repeats(rows, length):
    seen, out = set(), {}
    for key, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[key] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_suffix_dedup(rows, docs, empty, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 2: every group is split and its classes are merged
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50)
    got = {r.doc_id: tuple(r[1:]) for r in suffix_dedup.removed(docs).collect()}
    want = without_repeats([(r[0], r[1]) for r in rows], 100)
    assert got == want and sum(v[1] for v in want.values()) > 5000
    assert suffix_dedup.removed(empty).count() == 0


def test_suffix_dedup_cuts_its_pieces_once(docs, monkeypatch):
    """The ranges of the pieces are found over written pieces, not by a second pass over the texts."""
    plans, sifted = [], suffix_dedup.sifted
    monkeypatch.setattr(suffix_dedup, "sifted", lambda dealt: plans.append(dealt._jdf.queryExecution().toString()) or sifted(dealt))
    assert suffix_dedup.removed(docs).count() == docs.count()
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_rounds_write_over_their_files(tmp_path):
    """Files that are cut to nothing and filled again in each round would be sent to the disk as often."""
    texts = [b"xxabcabcab", b"abcabc", b"bcabcabcabc", b"zz"]
    block = suffix_dedup.Columns(np.frombuffer(b"".join(texts), np.uint8), np.zeros(4, np.int64), np.zeros(4, np.int64), np.array([len(t) for t in texts]), str(tmp_path))
    sizes, column = [], block.width
    for order, equal in block.rounds(3, 0):
        column -= 1
        sizes.append([(tmp_path / name).stat().st_size for name in ("order", "agree")])
        assert order.tolist() == sorted((i for i, t in enumerate(texts) if len(t) > column), key=lambda i: (texts[i][column:], ))
        tails = [texts[i][column:column + 3] for i in order]
        assert equal.tolist() == [i > 0 and len(t) == 3 and t == tails[i - 1] for i, t in enumerate(tails)]
    assert sizes == sorted(sizes) and sizes[-1] == [16, 16]
    # a block that loses rows on its way leaves their bytes in the files
    block = suffix_dedup.Columns(np.frombuffer(b"abcde" * 2 + b"e", np.uint8), np.zeros(3, np.int64), np.array([0, 0, 4]), np.array([5, 5, 1]), str(tmp_path))
    seen = [(order.tolist(), (tmp_path / "order").stat().st_size) for order, _ in block.rounds(3, 0)]
    assert [len(order) for order, _ in seen] == [3, 2, 2, 2, 2] and {size for _, size in seen} == {12}


def test_suffix_dedup_of_repeated_and_null_ids(twice):
    got = suffix_dedup.removed(twice).collect()
    assert len(got) == twice.count()
    assert sum(r.n_bytes - r.n_removed for r in got) <= sum(v[0] - v[1] for v in without_repeats([(r[0], r[1]) for r in made()[:30]], 100).values()) + 100  # texts below 100 bytes stay


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    rng = random.Random(3)
    piece = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(1, "".join(rng.choice("abcdefgh ") for _ in range(3000)) + piece + "x" * 30 + piece), (2, piece[100:400])]
    batch = pa.RecordBatch.from_arrays([pa.array([rows[0][1]])], names=["_text"])
    monkeypatch.setattr(suffix_dedup, "STRETCH", 512)
    windows = set()
    for row, start, size, *_ in suffix_dedup.stretches(batch, 100, 30):
        for a, n in zip(start.tolist(), size.tolist()):
            windows.update(range(a, a + n - 99))
    assert windows == set(range(len(rows[0][1]) - 99))


# -- op4


def similar(texts, n, percent):
    sets = {}
    for key, t in texts:
        w = BLANK.findall(lower(t))
        sets[key] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (3, 100)])
def test_jaccard_join(rows, docs, empty, n, percent):
    want = similar([(r[0], r[1]) for r in rows], n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(docs, n=n, percent=percent).collect()}
    assert got == want
    left = jaccard.one_per_component(docs, n=n, percent=percent)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {k for k, (size, c) in want.items() if not size or c == k}
    if percent == 90:
        assert jaccard.joined(empty).count() == 0


def test_jaccard_join_of_repeated_and_null_ids(twice):
    got = jaccard.joined(twice).collect()
    assert len(got) == twice.count()
    # 19 and the null id have the text of 16
    assert {r.component_id for r in got if r.doc_id in (19, None)} == {16}


def test_one_per_component_goes_by_rows(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    lone = [f"{w}1 {w}2 {w}3 {w}4 {w}5 {w}6" for w in "pqrst"]
    rows = [(1, near, "en"), (5, near + " tail", "en"), (5, lone[0], "en"), (6, lone[1], "en"), (6, lone[2], "en"),  # an id with unlike texts
            (7, lone[3], "en"), (7, lone[3], "en"), (7, lone[3], "en"),  # a row three times
            (None, near, "en"), (None, lone[4], "en"),  # a null id with a known and a text of its own
            (None, "only null ids have this text", "en"), (None, "only null ids have this text", "de"), (None, "only null ids have this text", "de"),
            (8, None, "en"), (8, None, "en"), (None, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    left = jaccard.one_per_component(docs, n=2, percent=80)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    want = [(1, near), (5, lone[0]), (6, lone[1]), (6, lone[2]), (7, lone[3]), (None, lone[4]), (None, "only null ids have this text"), (8, None), (8, None), (None, "")]
    assert got == sorted(want, key=str)


# -- op5


def counts_of(t):
    w, lines = BLANK.findall(t or ""), [x for x in (t or "").split("\n") if BLANK.search(x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(tri)
    inside = {k for i, x in enumerate(tri) if often[x] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)


def binomial(k, n, p):
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


def test_quality_counts_and_verdicts(spark, rows, docs, empty):
    labels = spark.createDataFrame([(r[0], 1, None) for r in rows[:20]] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    for r in rows:
        want, g = counts_of(r[1]), got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert g.base_failed == failed and g.kept == (not failed)  # too few labels for any cutoff
    assert quality.judged(empty, labels).count() == 0
    left = quality.kept_documents(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, g in got.items() if g.kept}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (1, 50), (3, 400), (7, 5000), (0, 0), (30, 5000), (90, 100)]
    out = spark.createDataFrame([(float(k), float(n)) for k, n in cases], "_k double, _n double").select("_k", "_n", quality.binomial_tail(F.col("_k"), F.col("_n"), 0.01).alias("p")).collect()
    for r in out:
        k, n = int(r._k), int(r._n)
        want = binomial(k, n, 0.01) if k < n * 0.01 else 1.0
        assert r.p == pytest.approx(want, rel=1e-8)


def test_cutoffs_hold_the_risk(spark):
    rng = random.Random(1)
    # good rows exceed 0.5 in one of 2000 cases, 0.1 in a tenth; bad ones nearly always
    rows = [("a", True, 0.7 if i % 2000 == 0 else 0.2 if i % 10 == 0 else 0.0) for i in range(40_000)] + [("a", False, rng.choice([0.05, 0.3, 0.9, 0.9])) for _ in range(500)]
    rows += [("few", True, 0.0)] * 20 + [("few", False, 0.9)] * 20
    scored = spark.createDataFrame(rows, "s string, good boolean, symbols double")
    cuts = {r.s: r.cut_symbols for r in quality.calibrated(scored, "s", "good", alpha=0.005, cost=0.1, grids={"symbols": [0.8, 0.5, 0.25, 0.1, 0.01]}).collect()}
    assert cuts == {"a": 0.25, "few": None}


def test_cutoffs_of_few_labels(spark):
    # one stratum of 1,900 good rows, three of 400: alone, pooled, and a fourth rule that turns away good rows
    rows = [("en", True, 0.0, 0.3 if i % 50 == 0 else 0.0) for i in range(1900)] + [("en", False, 0.4, 0.0)] * 30 + [("en", False, 0.0, 0.3)] * 2
    for lang in ("de", "es", "fr"):
        rows += [(lang, True, 0.0, 0.0)] * 400 + [(lang, False, 0.4, 0.0)] * 5
    grids = {"symbols": [4.0, 2.0, 1.0, 0.5, 0.35, 0.25], "repeats": [0.5, 0.4, 0.2, 0.1]}
    scored = spark.createDataFrame(rows, "s string, good boolean, symbols double, repeats double")
    cuts = {r.s: (r.cut_symbols, r.cut_repeats) for r in quality.calibrated(scored, "s", "good", grids=grids).collect()}
    assert cuts == {lang: (0.35, None) for lang in ("en", "de", "es", "fr")}
    # the pool alone is too small
    few = quality.calibrated(scored.where("s <> 'fr'"), "s", "good", grids=grids).collect()
    assert {r.s: r.cut_symbols for r in few} == {"en": 0.35, "de": None, "es": None}
    # a looser cutoff that fails ends the tests of its rule, and what turns away too many good rows is never used
    worse = scored.withColumn("symbols", F.when(F.col("good") & (F.col("s") == "en") & (F.rand(1) < 0.02), 3.0).otherwise(F.col("symbols")))
    assert {r.s: r.cut_symbols for r in quality.calibrated(worse, "s", "good", grids=grids).collect()}["en"] is None


# -- op7


@pytest.mark.parametrize("coding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, rows, docs, empty, tmp_path, coding):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer())
    path = str(tmp_path / coding)
    token_files.write(token_files.tokenized(docs, tokenizer()), path, coding, group_bytes=1 << 16, page_rows=10)
    files = token_files.open_files(spark, path)
    start, want = 0, {}
    for key, t in sorted((r[0], r[1]) for r in rows):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        want[key] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert {r.doc_id: tuple(r[1:]) for r in token_files.checksums(files).collect()} == {k: v[:3] for k, v in want.items()}
    key = rows[5][0]
    assert token_files.tokens_of(files, [key]).collect()[0].tokens == want[key][3]
    begin, n = want[key][0], want[key][1]
    got = token_files.token_range(files, begin + 2, begin + n).collect()
    assert [(r.doc_id, r["from"], r.tokens) for r in got] == [(key, begin + 2, want[key][3][2:])]
    if coding == "delta":
        token_files.write(token_files.tokenized(empty, tokenizer()), str(tmp_path / "none"))
        assert token_files.checksums(token_files.open_files(spark, str(tmp_path / "none"))).count() == 0


def test_token_files_of_repeated_and_null_ids(spark, twice, tmp_path):
    token_files.write(token_files.tokenized(twice, tokenizer()), str(tmp_path / "t"))
    got = token_files.checksums(token_files.open_files(spark, str(tmp_path / "t"))).orderBy("start").collect()
    assert len(got) == twice.count() and got[0].doc_id is None
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]


# -- op8


def profile(texts, n=300):
    count = collections.Counter(g for t in texts for g in ngrams(t))
    return {g: i for i, g in enumerate(sorted(count, key=lambda g: (-count[g], packed(g)))[:n])}


def ngrams(t):
    s = " " + "".join(c if c.isalpha() else " " for c in (t or "").lower()) + " "
    for i in range(1, len(s) - 1):
        if s[i] != " ":
            yield s[i]
            yield s[i:i + 2]
            if s[i - 1] == " ":
                yield s[i - 1:i + 1]
            yield s[i - 1:i + 2]


def packed(g):
    value = 0
    for c in g:
        value = value << 21 | (1 if c == " " else ord(c) + 2)
    return value


def test_language_id(docs, rows, empty):
    named = docs.withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[2] is not None]
    models = {lang: profile([r[1] for r in train if r[2] == lang]) for lang in ("en", "fr")}
    got = {r.doc_id: r for r in langid.identified(named.select("doc_id", "held_out", "text"), langid.profiles(named.where("NOT held_out"))).collect()}
    for r in rows:
        own, g = profile([r[1]]), got[r[0]]
        assert g.held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2)
        if not own:
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(i - m[x]) if x in m else 300 for x, i in own.items()) for lang, m in models.items()}
        best = min(sorted(far), key=far.get)
        assert g.lang_pred == best and g.score == pytest.approx(1 - far[best] / (300 * len(own)))
    none = langid.profiles(docs.where("false"))
    assert {r.lang_pred for r in langid.identified(docs.select("doc_id", "text"), none).collect()} == {"und"}
    assert langid.identified(empty.select("doc_id", "text"), none).count() == 0


# -- op9


def test_mixing_meets_the_targets(spark):
    rng = random.Random(2)
    texts = []
    for i in range(900):
        kind = ["clean", "junk", "toxic"][0 if i % 9 < 7 else 1 if i % 9 == 7 else 2]
        own = {"clean": "calm", "junk": "zz##", "toxic": "idiot"}[kind]
        texts.append((i, " ".join([rng.choice(["the", "of", "and", own]) for _ in range(30)]), kind))
    texts += [(10_000, None, None), (10_001, "", None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, domain string")
    out = mixing.mixed(docs.drop("domain"), docs.where("doc_id % 2 = 0"), {"clean": 0.5, "junk": 0.3, "toxic": 0.2})
    total = 900 * 30
    got = out.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[i]) / total for i in range(3)]).first()
    assert got[0] == pytest.approx(0.5, abs=0.02) and got[1] == pytest.approx(0.3, abs=0.02) and got[2] == pytest.approx(0.2, abs=0.02)
    assert out.where("rate < 0 OR rate IS NULL").count() == 0 and out.count() == len(texts)
    p = np.array([r.posterior for r in out.where("n_tokens > 0").collect()])
    t = np.full(len(p), 30.0) / total
    r = np.ones(len(p))  # the same steps in numpy
    rows = out.where("n_tokens > 0").collect()
    second = (t[:, None] * p).T @ p
    weight = 1 / second.sum(1)
    size = 1 / ((second * np.sqrt(np.outer(weight, weight))).sum(1).max() + mixing.PULL)
    for _ in range(mixing.STEPS):
        gap = (t[:, None] * r[:, None] * p).sum(0) - np.array([0.5, 0.3, 0.2])
        if np.abs(gap).max() < 1e-4:
            break
        r = np.maximum(0, r - size * (p @ (weight * gap) + mixing.PULL * (r - 1)))
    assert np.allclose(r, [x.rate for x in rows], atol=1e-6)
    one = mixing.mixed(docs.drop("domain"), docs.where("domain = 'clean'"), {"clean": 0.5, "junk": 0.5})
    assert {x.rate for x in one.select("rate").distinct().collect()} == {1.0}
    assert mixing.mixed(docs.drop("domain").limit(0), docs, {"clean": 0.5, "junk": 0.5}).count() == 0


# -- op10


def test_lm_base_and_model(spark, rows, docs, empty, twice):
    named = docs.withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 1))
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    count = collections.Counter(w for r in train for w in [*BLANK.findall(lower(r[1])), ""])
    total, floor = sum(count.values()), 0.5 * (len(count) + 1)
    for hot in (attention_lm.HOT_WORDS, 20):
        attention_lm.HOT_WORDS = hot
        got = {r.doc_id: r for r in attention_lm.scored(named.select("doc_id", "held_out", "text"), named.where("NOT held_out"), tokenizer()).collect()}
        for r in rows:
            w, g = [*BLANK.findall(lower(r[1])), ""], got[r[0]]
            assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(count[x] > 0 for x in w), total)
            assert g.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (total + floor)) for x in w), rel=1e-9)
            assert g.score < 0
    attention_lm.HOT_WORDS = 262_144
    assert attention_lm.scored(twice.select("doc_id", "text"), twice, tokenizer()).count() == twice.count()
    assert attention_lm.scored(empty.select("doc_id", "text"), empty, tokenizer()).count() == 0
    alone = attention_lm.scored(docs.select("doc_id", "text"), empty, tokenizer()).collect()
    assert {r.train_tokens for r in alone} == {0} and all(r.n_known == 0 for r in alone)


def test_each_id_is_scored_once_with_its_past_only():
    rng = np.random.default_rng(0)
    ids, ends = rng.integers(0, 3000, 100), np.array([37, 37, 100])
    classes = attention_lm.Classes.from_counts(np.bincount(ids, minlength=attention_lm.VOCABULARY))
    fit = attention_lm.Fit(attention_lm.start(np.bincount(ids, minlength=attention_lm.VOCABULARY), classes), classes, [0])
    for _ in range(30):
        fit.read(ids, ends)
    p = fit.p
    score = attention_lm.Scorer(p, classes)
    logs = score(ids, ends)
    # a probability over all ids
    total = sum(math.exp(score(np.append(ids[:20], k), np.array([21]))[-1]) for k in range(0, attention_lm.VOCABULARY, 1) if k % 97 == 0)
    assert 0 < total < 1
    inputs = attention_lm.inputs_of(ids, ends, classes)
    for i in (0, 5, 16, 36, 37, 60, 99):  # plain attention for one position
        begin = 0 if i < 37 else 37
        first = max(begin, begin + (i - begin) // 16 * 16 - 16)
        e = p["e"][inputs[first:i + 1]].astype(float)
        s = (e[-1] @ p["q"]) @ (e @ p["k"]).T / 4 + p["b"][np.arange(i - first, -1, -1)]
        a = np.exp(s - s.max())
        h = e[-1] + (a / a.sum()) @ (e @ p["v"]) @ p["o"]
        z = h @ p["u"] + p["c"]
        want = z[classes.of[ids[i]]] - np.log(np.exp(z).sum()) + classes.inside[ids[i]]
        assert logs[i] == pytest.approx(want, abs=1e-3)
    changed = ids.copy()
    changed[60:] = 1
    assert np.allclose(score(changed, ends)[:60], logs[:60])


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in attention_lm.fresh(rng).items()}
    emb, valid = rng.integers(1, 50, (2, 32)), np.ones((2, 32), bool)
    valid[0, :7] = False
    target, counted = rng.integers(0, attention_lm.CLASSES, (2, 16)), np.ones((2, 16), bool)
    _, g = attention_lm.gradients(p, emb, valid, target, counted)
    for name in ("q", "k", "v", "o", "u", "c", "b", "e"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        near = []
        for step in (1e-4, -1e-4):
            p[name][at] += step
            near.append(attention_lm.gradients(p, emb, valid, target, counted)[0])
            p[name][at] -= step
        assert g[name][at] == pytest.approx((near[0] - near[1]) / 2e-4, rel=2e-2, abs=1e-5)


@pytest.mark.parametrize("large", [1, 30])
def test_gradients_are_sums_over_pieces(monkeypatch, large):
    """Pieces of any size give the batch's gradients; ``large`` values take the way with shifted exponents."""
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) * (large if k in "eu" else 1) for k, v in attention_lm.fresh(rng).items()}
    places, valid, counted = attention_lm.blocks(np.array([1, 70, 71, 150]))
    emb, target = rng.integers(1, 50, valid.shape), rng.integers(0, attention_lm.CLASSES, counted.shape)
    got = []
    for size in (1, 3, 100):
        monkeypatch.setattr(attention_lm, "PIECE", size)
        got.append(attention_lm.gradients(p, emb, valid, target, counted))
    for loss, g in got[:2]:
        assert loss == pytest.approx(got[2][0])
        for name, v in g.items():
            assert np.isfinite(v).all() and np.allclose(v, got[2][1][name], rtol=1e-7, atol=1e-9)


def test_training_helps(spark):
    text = ("the cat sat on the mat and the dog sat on the log " * 40).strip()
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    row = attention_lm.scored(docs, docs, tokenizer()).first()
    assert row.score > row.base_score


def test_training_reads_every_row_and_whole_texts(spark):
    """Pairs of words that only the tail of one long text has are known to the model: a held-out text of such pairs scores better
    than one of the same words in another order."""
    rng = random.Random(4)
    plain = [" ".join(rng.choices(["north", "south", "east", "west"], k=300)) for _ in range(60)]
    tail = " ".join(["river", "bank"] * 6_000)
    docs = spark.createDataFrame([*enumerate(plain), (100, " ".join(rng.choices(["north", "south"], k=6_000)) + " " + tail)], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "river bank " * 50), (2, "river river bank bank " * 25)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in attention_lm.scored(asked, docs, tokenizer()).collect()}
    assert got[1] > got[2] + 5


def test_parameters_are_averaged_in_a_tree(spark):
    fan = attention_lm.FAN
    attention_lm.FAN = 3
    try:
        rows = [(i, float(i + 1), [float((i + 1) * x) for x in (i, 2 * i)]) for i in range(20)]
        got = attention_lm.averaged(spark.createDataFrame(rows, attention_lm.PARTS))
        weight = sum(r[1] for r in rows)
        assert got == pytest.approx([sum(r[2][k] for r in rows) / weight for k in (0, 1)])
        assert attention_lm.averaged(spark.createDataFrame([], attention_lm.PARTS)) is None
    finally:
        attention_lm.FAN = fan


def test_helper_columns_hide_none(spark, rows, docs):
    """Columns with the helpers' names come through all stages that keep rows."""
    named = docs.select("*", (F.col("doc_id") + 1).alias("_mark"), F.lit("m").alias("__mark"), F.lit(3).alias("_MARK_"), F.lit(0.5).alias("rate"), F.lit(7).alias("copy"), F.lit("r").alias("times"))
    labels = spark.createDataFrame([(r[0], int(i % 3 > 0), 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame(items_of(rows), "item_id long, text string")
    domain = docs.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "clean").otherwise("junk").alias("domain"))
    for out in (quality.kept_documents(named, labels), phrase_index.clean_documents(named, items), jaccard.one_per_component(named, n=5, percent=80), mixing.resampled(named, domain, {"clean": 0.5, "junk": 0.5})[0]):
        assert out.columns == named.columns
        got = out.collect()
        assert got and all(r["_mark"] == r["doc_id"] + 1 and (r["__mark"], r["_MARK_"], r["rate"], r["copy"], r["times"]) == ("m", 3, 0.5, 7, "r") for r in got)


def test_resampled_rows_follow_their_own_rates(spark):
    """Copies are the rates' whole parts or one more, their sum meets the rates; rows that are likely of the kept domain stay; rows of
    one id and null ids are told apart by their texts."""
    rng = random.Random(6)
    word = {"clean": "good fine plain clear", "junk": "spam offer click cheap", "toxic": "nasty awful vile mean"}
    rows = []
    for i in range(900):
        domain = rng.choices(["clean", "junk", "toxic"], [5, 3, 2])[0]
        rows.append((None if i % 50 == 0 else i // 2, " ".join(rng.choices(word[domain].split() + ["the", "of", "and"], k=40)), domain))
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    targets = {"clean": 0.9, "junk": 0.06, "toxic": 0.04}
    out, reached = mixing.resampled(docs, docs.where("doc_id % 3 > 0"), targets, keep="clean")
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert all(got[i, t] >= 1 for i, t, d in rows if d == "clean")
    total = collections.Counter()
    for (i, t), n in got.items():
        total[next(d for a, b, d in rows if (a, b) == (i, t))] += 40 * n
    share = {d: total[d] / sum(total.values()) for d in targets}
    assert all(abs(share[d] - targets[d]) < 0.04 for d in targets), share
    assert sum(reached) == pytest.approx(1, abs=0.2)
    free, _ = mixing.resampled(docs, docs.where("doc_id % 3 > 0"), {"clean": 0.1, "junk": 0.8, "toxic": 0.1})
    assert len({(r.doc_id, r.text) for r in free.collect()} & {(i, t) for i, t, d in rows if d == "clean"}) < 300


# -- the pipeline


def test_pipeline_stages(spark, rows, docs, empty, tmp_path):
    folder = str(tmp_path)
    labels = [(r[0], int(len((r[1] or "").split()) > 40), 0) for r in rows]
    docs.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame(items_of(rows), "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    now, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in now.collect()}
        out = corpus_pipeline.written(stage(spark, now, folder), "test-stage")
        after = {r.doc_id for r in out.collect()}
        assert after <= set(before)
        if i == 0:
            assert after == {k for k, t in before.items() for c in [counts_of(t)] if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
        if i == 1:
            assert after == {k for k, (size, c) in similar(list(before.items()), 5, 80).items() if not size or c == k}
        if i == 2:
            found = contamination(list(before.values()), [(str(a), b) for a, b in items_of(rows)])
            assert after == {k for k, f in zip(before, found) if not f[4]}
        if i < 4:
            assert out.columns == docs.columns
            now = out
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert set(TARGETS) == {"clean", "junk", "toxic"}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_schema_types_are_stable(docs):
    assert isinstance(jaccard.joined(docs).schema["component_id"].dataType, T.LongType)
