"""Spelling variants against comparing all words with all words."""

import collections
import random
import re
import zlib

import pytest

from tallyframe.llm import spelling
from tallyframe.llm.q_documents import op12_spelling

SCHEMA = "doc_id long, text string, word int, n string, form double, parts int"


def counts(rows):
    out = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def expected(words):
    form, out = {}, {}
    near = {w: [v for v in words if distance_one(v, w)] for w in words}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def made():
    rng = random.Random(8)
    bases = ["".join(rng.choice("abÀéß÷xyz") for _ in range(rng.randint(7, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab", "straßenbahn", "Étranger", "l" * 3_000, "l" * 2_999]
    texts = []
    for k, base in enumerate(bases):
        texts += [f"{base} " * rng.choice((1, 3, 40, 700))]
        for _ in range(5):
            w, at = list(base), rng.randrange(len(base))
            edit = rng.randrange(3)
            w[at:at + (edit != 0)] = [] if edit == 2 else [rng.choice("abÀéß÷xyz")]
            texts.append((("".join(w) + rng.choice((" ", "1", "Ā", "¿"))) * rng.choice((1, 2, 2, 30, 400))))
    texts += [None, "", "short words only", "Upper UPPERCASE uppercase Uppercase"]
    rng.shuffle(texts)
    return [*enumerate(texts), (None, "null id words, null id words straßenbahn"), (3, texts[3])]


@pytest.fixture(scope="module")
def rows():
    return made()


def asked(spark, rows, block):
    docs = spark.createDataFrame([(*r, 1, "x", 0.5, 2) for r in rows], SCHEMA).repartition(5)
    out = spelling.grouped(spelling.counted(spelling.damaged_words(docs)), block=block)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


@pytest.mark.parametrize("block", [20_000, 5])
def test_variants_equal_all_pairs(spark, rows, block):
    """With blocks of five words most beginnings and endings are split over several indexes."""
    want = expected(counts(rows))
    assert asked(spark, rows, block) == want
    assert sum(1 for w, r in want.items() if r[1] != r[0] and r[1] is not None and r[1] != w) > 5


def test_roots_follow_long_chains(spark):
    chain = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl", "abcdefghijklm", "abcdefghijklmn"]
    words = {w: 2 * 10**i for i, w in enumerate(chain)}
    got = spelling.grouped(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == expected(words)
    assert {r["root"] for r in got} == {chain[-1]}


def test_index_finds_one_error_in_either_half():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(600)})
    index = spelling.Index(words)
    for exact in (1, 3, 4, 6):
        got = collections.defaultdict(set)
        for q, r in zip(*(x.tolist() for x in index.near(words, spelling.np.full(len(words), exact)))):
            got[words[q]].add(index.words[r])
        for w in words:
            assert got[w] == {v for v in words if distance_one(v, w) and v.endswith(w[-exact:]) and distance_one(v[:-exact], w[:-exact])}, w


def test_short_words_are_refused_and_empty_tables_work(spark, tmp_path):
    with pytest.raises(ValueError):
        spelling.near(spark.createDataFrame([("abcde", 3)], "word string, n long"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert op12_spelling(spark, str(tmp_path)).collect() == []
