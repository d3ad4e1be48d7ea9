import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import bpe, corpus, ngram


def make_docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def block_docs(rng):
    pool = ["".join(rng.choice("abcdef ") for _ in range(16)) for _ in range(12)]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) for _ in range(60)]


@pytest.mark.parametrize("length, stride, segment", [(4, 1, 8), (5, 3, 16), (64, 64, 32), (3, 1, 1 << 16)])
def test_stream_windows_cross_texts(spark, length, stride, segment):
    rng = random.Random(length)
    held = {g: [(rng.randint(-2**62, 2**62), [rng.randint(0, 99) for _ in range(rng.choice((0, 1, 2, 9, 150)))]) for _ in range(30)] for g in ("a", "b")} | {"short": [(1, [7] * length)]}
    rows = [(g, k, ids) for g, texts in held.items() for k, ids in texts]
    df = spark.createDataFrame(rows, "g string, k bigint, ids array<int>").repartition(3)
    got = {(r["g"], r["start"]): (r["x"], r["y"]) for r in ngram.stream_windows(df, "k", length, stride, ["g"], segment).collect()}
    want = {}
    for g, texts in held.items():
        stream = [t for _, ids in sorted(texts) for t in ids]
        want |= {(g, p): (stream[p:p + length], stream[p + 1:p + length + 1]) for p in range(0, len(stream) - length, stride)}
    assert got == want


def test_character_ids_by_code_point_pages(spark):
    vocabulary = ngram.char_vocabulary(make_docs(spark, ["az", "é\u07ff漢", "\U0001F600\U0010FFFF\x00 "]), "text")
    ids = {r["ch"]: r["id"] for r in vocabulary.collect()}
    text = "a\U0001F600é漢\U0010FFFF\x00 b\U0001F601\u0100\u07ff"
    assert ngram.encode(make_docs(spark, [text, "", None]), "text", vocabulary).orderBy("doc_id").first()["ids"] == [ids.get(c, 3) for c in text]
    none = ngram.char_vocabulary(make_docs(spark, [""]), "text")
    assert ngram.encode(make_docs(spark, ["ab"]), "text", none).first()["ids"] == [3, 3]


def sequential_dedup(texts, size):
    seen, kept = set(), []
    for i, t in enumerate(texts):
        blocks = {hashlib.md5(t[a:a + size].encode()).hexdigest() for a in range(0, len(t), size)}
        if len(blocks & seen) / max(1, len(blocks)) < 0.5:
            kept.append(i)
            seen |= blocks
    return kept


def test_document_dedup_equals_the_sequential_rule(spark):
    for seed in (1, 2, 3):
        texts = block_docs(random.Random(seed))
        got = corpus.dedup_documents(make_docs(spark, texts), size=16).orderBy("doc_id").collect()
        assert [r["doc_id"] for r in got] == sequential_dedup(texts, 16)


def test_one_pass_compares_with_all_earlier(spark):
    texts = ["aaaabbbb", "aaaacccc", "ccccdddd", "zzzz", ""]
    got = corpus.dedup_documents(make_docs(spark, texts), size=4, one_pass=True).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [0, 3, 4]
    exact = corpus.dedup_documents(make_docs(spark, texts), size=4).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in exact] == sequential_dedup(texts, 4) == [0, 2, 3, 4]


def test_line_dedup_keeps_first(spark):
    lines = corpus.doc_lines(make_docs(spark, ["a\nb\na\n", "B\nc\n\na"]))
    kept = [(r["doc_id"], r["pos"], r["line"]) for r in corpus.distinct_lines(lines).orderBy("doc_id", "pos").collect()]
    assert kept == [(0, 0, "a"), (0, 1, "b"), (0, 3, ""), (1, 0, "B"), (1, 1, "c")]
    folded = [r["line"] for r in corpus.distinct_lines(lines, case_sensitive=False).orderBy("doc_id", "pos").collect()]
    assert folded == ["a", "b", "", "c"]
    assert [r["text"] for r in corpus.rebuilt(corpus.distinct_lines(lines)).orderBy("doc_id").collect()] == ["a\nb\n", "B\nc"]


def test_split_by_offset_equals_slicing(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("xyzé") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    whole = "".join(texts)
    t1, t2 = int(len(whole) * 0.9), int(len(whole) * (0.9 + 0.05))
    got = corpus.split_by_offset(make_docs(spark, texts).withColumn("corpus", F.lit("all"))).orderBy("position").collect()
    parts = {s: "".join(r["piece"] for r in got if r["split"] == s) for s in ("train", "val", "test")}
    assert (parts["train"], parts["val"], parts["test"]) == (whole[:t1], whole[t1:t2], whole[t2:])


def test_shards_rebuild_the_corpus(spark):
    texts = [f"doc {i}" for i in range(20)]
    shards = corpus.concat_shards(make_docs(spark, texts), docs_per_shard=6).orderBy("shard").collect()
    assert "\n\n".join(r["text"] for r in shards) == "\n\n".join(texts)


def test_swap_lines_equals_the_walk(spark):
    texts = ["\n".join(f"l{i}" for i in range(n)) for n in (1, 2, 3, 10, 40)]
    for p in (0.0, 0.3, 0.8, 1.0):
        df = make_docs(spark, texts)
        got = df.selectExpr("doc_id", f"{corpus.swap_lines('text', 9, 'doc_id', p)} as t").orderBy("doc_id").collect()
        coins = df.selectExpr("doc_id", f"transform(sequence(0, 50), x -> {corpus.coin(9, ['doc_id', 'cast(x as int)'])}) as c").orderBy("doc_id").collect()
        for text, g, c in zip(texts, got, coins):
            lines = text.split("\n")
            for i in range(len(lines) - 1):
                if c["c"][i] < p:
                    lines[i], lines[i + 1] = lines[i + 1], lines[i]
            assert g["t"] == "\n".join(lines)


def test_augmentations_have_their_shape(spark):
    text = "".join(chr(97 + i % 26) for i in range(4000))
    df = make_docs(spark, [text, "short"])
    long, short = df.selectExpr(f"{corpus.random_slice('text', 1, 'doc_id')} as s", f"{corpus.char_dropout('text', 1, 'doc_id', 0.1)} as d",
                                f"{corpus.repeat_section('text', 1, 'doc_id')} as r", "doc_id").orderBy("doc_id").collect()
    assert long["s"] in text and 2000 <= len(long["s"]) <= 3800
    assert 3400 < len(long["d"]) < 3800 and 10 <= len(long["r"]) - 4000 <= 500
    assert short["r"] == "short"
    variants = corpus.augment(df, 4).collect()
    assert len(variants) == 8 and {r["text"] for r in variants if r["variant"] == 0} == {text, "short"}


def test_ngram_model_and_distribution(spark):
    df = spark.createDataFrame([("f", " abab "), ("f", "abc"), ("f", "  ")], "field string, t string")
    model = ngram.model(df, "field", "t")
    want = Counter()
    for t in ("abab", "abc"):
        padded = "^^" + t + "$"
        for i in range(len(padded) - 2):
            want[padded[i:i + 2], padded[i + 2]] += 1
    assert {(r["context"], r["next"]): r["n"] for r in model.collect()} == dict(want)
    for r in ngram.distribution(model, 0.5).groupBy("context").agg(F.sum("p").alias("p"), F.max("cumulative").alias("c")).collect():
        assert abs(r["p"] - 1) < 1e-9 and abs(r["c"] - 1) < 1e-9


def plain_walk(row, field, table, letters, length, seed, n):
    context, out = ngram.START * (n - 1), []
    for step in range(length):
        u = int(hashlib.md5(f"{seed}|{row}|step{step}".encode()).hexdigest()[:8], 16) / 4294967296.0
        if found := table.get((field, context)):
            ch = next((c["ch"] for c in found if u <= c["c"]), found[-1]["ch"])
            if ch == ngram.END:
                break
        else:
            ch = letters[field][int(u * len(letters[field]))]
        out.append(ch)
        context = (context + ch)[-(n - 1):]
    return "".join(out).ljust(length)


def test_generated_texts_equal_a_plain_walk(spark):
    df = spark.createDataFrame([("a", t) for t in ("john smith", "jane doe", "jim jones")] + [("b", "xyz")], "field string, t string")
    model = ngram.model(df, "field", "t")
    rows = spark.range(40).selectExpr("id", "if(id % 3 = 0, 'b', 'a') as field")
    got = {r["row"]: r["text"] for r in ngram.generate_text(rows, "id", "field", model, 8, seed=4).collect()}
    table = {(r["field"], r["context"]): r["choices"] for r in ngram._choices(model, 0.8).collect()}
    letters = {f: sorted({r["next"] for r in model.filter(F.col("field") == f).collect()}) for f in "ab"}
    assert got == {i: plain_walk(i, "b" if i % 3 == 0 else "a", table, letters, 8, 4, 3) for i in range(40)}
    assert all(len(t) == 8 for t in got.values()) and len(set(got.values())) > 3


def test_loss(spark):
    train = spark.createDataFrame([("all", "aab")], "field string, t string")
    looked = ngram.lookup(spark.createDataFrame([(1, "aaz")], "id int, t string"), ngram.model(train, "field", "t"), "id", "t")
    row = ngram.loss(looked, ["id"]).first()
    probs = [1.0, 1.0, 1e-6, 1e-6]  # ^^a, ^aa, aaz unseen, az$ unseen
    nll = -sum(math.log(p) for p in probs)
    assert row["n_tokens"] == 4 and abs(row["nll"] - nll) < 1e-6 and abs(row["bpt"] - nll / 4 / math.log(2)) < 1e-6


def test_char_codec_and_windows(spark):
    vocabulary = ngram.char_vocabulary(make_docs(spark, ["hello wörld 😀"]), "text")
    ids = ngram.encode(make_docs(spark, ["hello 😀!", ""]), "text", vocabulary)
    got = ngram.decode(ids, vocabulary).orderBy("doc_id").collect()
    assert got[0]["decoded"] == "hello 😀<UNK>" and got[1]["ids"] == []
    chars = sorted(set("hello wörld 😀"))
    assert got[0]["ids"] == [chars.index(c) + 4 if c in chars else 3 for c in "hello 😀!"]
    wins = ngram.windows(ids, "doc_id", 3).orderBy("start").collect()
    t = got[0]["ids"]
    assert [(r["x"], r["y"]) for r in wins] == [(t[i:i + 3], t[i + 1:i + 4]) for i in range(len(t) - 3)]


def test_ids_and_characters_come_in_batches_of_bounded_size(spark):
    """No lambda per character, and texts of more characters than a batch, next to empty and null ones, come back whole."""
    n = ngram.BATCH_CHARS
    texts = make_docs(spark, ["ab" * (n // 2 + 5), "", None, "a😀b", *["ba" * (n // 8)] * 9, "zz"])
    vocabulary = ngram.char_vocabulary(make_docs(spark, ["ab😀"]), "text")
    got = ngram.decode(ngram.encode(texts, "text", vocabulary).drop("text"), vocabulary)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {r["doc_id"]: r["text"] for r in texts.collect()}
    back = {r["doc_id"]: r for r in got.collect()}
    assert {k: r["decoded"] for k, r in back.items()} == {k: None if v is None else v.replace("z", "<UNK>") for k, v in want.items()}
    assert all((r["ids"] is None) == (want[k] is None) and len(r["ids"] or []) == len(want[k] or "") for k, r in back.items())
    odd = spark.createDataFrame([([0, 1, 2, 4, 3, 6, 7, 99, None, 5],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in ngram.decode(odd, vocabulary).collect()] == ["a<UNK>😀??b", None, ""]
    # the share of known characters needs none either
    covered = ngram.coverage(ngram.encode(texts, "text", vocabulary), "doc_id")
    assert "lambda" not in covered._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["unk_count"], r["n_tokens"]) for r in covered.filter("n_tokens < 10").collect()) == [(0, 0), (0, 3), (2, 2)]


def plain_bpe(text, target):
    words = Counter(text.split())
    seqs = {w: [*w, "</w>"] for w in words}
    vocab = 4 + len({c for s in seqs.values() for c in s})
    merges = []
    while vocab < target:
        pairs = Counter()
        for w, s in seqs.items():
            for a, b in zip(s, s[1:]):
                pairs[a, b] += words[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        vocab += 1
        for w, s in seqs.items():
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == best:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[w] = out
    return merges


def plain_encode(text, merges, vocabulary):
    out, known = [], set(merges)
    for word in text.split():
        s, before = [*word, "</w>"], None
        while s != before:
            before, i, t = s, 0, []
            while i < len(s):
                step = 2 if tuple(s[i:i + 2]) in known else 1
                t.append("".join(s[i:i + step]))
                i += step
            s = t
        out += [vocabulary.get(x, 3) for x in s]
    return out


def test_bpe_rounds_take_independent_merges(spark):
    """Hundreds of merges over texts with runs, ties and words that are equal but for their end, in far fewer rounds."""
    rng = random.Random(11)
    parts = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(60)) for _ in range(40)] + ["aaaa aaaaa aaaaaaa abab ababab", "", "b" * 300]
    whole = " ".join(texts)
    target = 4 + len(set(whole) - {" "}) + 1 + 120
    merges, vocabulary, rounds = bpe.learned(make_docs(spark, texts), "text", vocab_size=target, cut_every=5, top_pairs=100)
    assert merges == plain_bpe(whole, target) and len(merges) == 120
    assert rounds < len(merges) / 3
    assert bpe.learned(make_docs(spark, ["", None]), "text")[0] == []


def test_independent_pairs():
    assert bpe.independent([("a", "b", 9), ("c", "d", 8), ("b", "e", 7)], set("abcde"), True) == [("a", "b"), ("c", "d")]
    assert bpe.independent([("a", "b", 9), ("c", "d", 8), ("x", "a", 8)], set("abcdx"), True) == [("a", "b")]  # (x, ab) may come first
    assert bpe.independent([("a", "b", 9), ("c", "d", 8)], set("abcd"), False) == [("a", "b")]  # what is not in the list may be as frequent
    assert bpe.independent([("a", "b", 9), ("c", "d", 8)], {"a", "b", "ab"}, True) == [("a", "b")]
    assert bpe.independent([], set(), True) == []


def test_bpe(spark):
    text = "low lower lowest new newer newest wide wider aaaa aaa a$b a$b \\E \\E"
    merges, vocabulary = bpe.learn(make_docs(spark, [text]), "text", vocab_size=4 + 20 + 10, cut_every=3)
    assert merges == plain_bpe(text, 4 + 20 + 10)
    enc = bpe.encode(make_docs(spark, [text, "zzz low", ""]), "text", merges, vocabulary)
    got = bpe.decode(enc, vocabulary).orderBy("doc_id").collect()
    assert got[0]["decoded"] == text and got[1]["decoded"].endswith("low") and got[2]["ids"] == []
    assert 3 in got[1]["ids"] and got[0]["ids"] == plain_encode(text, merges, vocabulary)


def test_prepared_corpus(spark):
    same = "x" * 600
    docs = make_docs(spark, [f"{same}\nkeep", f"{same}\nkeep", "\t \n", "other\nkeep\nline"])
    got = corpus.prepared(docs).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [(0, f"{same}\nkeep"), (3, "other\nline")]


def test_whole_preparation(spark, tmp_path):
    body = ["alpha line number %d of the corpus" % i for i in range(12)]
    texts = [f"{body[i]}\n{body[(i + 1) % 12]}\nshort\n{'long ' * 30}{i}" for i in range(12)] + ["", None, "tiny", body[0]]
    path = str(tmp_path / "splits")
    ready = corpus.prepare(make_docs(spark, texts), path, factor=3, min_line_len=8, max_line_len=100)
    rows = sorted(ready.collect(), key=lambda r: (r["doc_id"], r["variant"]))
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines = [x[:100].strip() for x in (t or "").split("\n") if len(x) >= 8]
        new = []
        for line in lines:
            if line not in seen:
                seen.add(line)
                new.append(line)
        if new:
            want[i] = "\n".join(new)
    assert {r["doc_id"]: r["text"] for r in rows if r["variant"] == 0} == want
    assert len(rows) == 3 * len(want) and all(len({r["split"] for r in rows if r["doc_id"] == d}) == 1 for d in want)
    for split in {r["split"] for r in rows}:
        parts = sorted((tmp_path / "splits" / f"split={split}").glob("*.txt"))
        assert "".join(p.read_text() for p in parts) == "".join(r["text"] + "\n\n" for r in rows if r["split"] == split)
    for got in corpus.summary(ready, ["split", "kind"], k=3).collect():
        mine = [r["text"] for r in rows if (r["split"], r["kind"]) == (got["split"], got["kind"])]
        lines = [x for t in mine for x in t.split("\n")]
        chars = Counter("".join(mine))
        assert (got["characters"], got["lines"], got["words"]) == (sum(map(len, mine)), len(lines), sum(len(t.split()) for t in mine))
        assert got["unique_chars"] == len(chars) and got["avg_line_len"] == round(sum(map(len, lines)) / len(lines), 6)
        assert [(c["ch"], c["n"]) for c in got["top_chars"]] == sorted(chars.items(), key=lambda x: (-x[1], x[0]))[:3]


def test_whole_preparation_of_nothing(spark):
    empty = make_docs(spark, [None, ""])
    assert corpus.prepare(empty).count() == 0 and corpus.summary(empty.fillna({"text": ""}), ["doc_id"]).filter("unique_chars = 0").count() == 2
