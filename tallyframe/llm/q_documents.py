"""Queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.llm import attention_lm, jaccard, langid, mixing, packing, phrase_index, quality, spelling, suffix_dedup, token_files
from tallyframe.llm.common import read
from tallyframe.session import scratch_path, written


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_decontamination(spark, sf_dir):
    """For every document: words inside occurrences of benchmark windows, and the items that have one."""
    out = phrase_index.checked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slop=1)
    return out.withColumn("doc_id", F.col("doc").cast("long")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "n_near_items")


def op3_suffix_dedup(spark, sf_dir):
    """Every document without the bytes of 100-byte strings that start earlier."""
    return suffix_dedup.removed(read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark, sf_dir):
    """Every document's component under Jaccard similarity of word trigrams of at least 0.9."""
    return jaccard.joined(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    """Counts, base rules and the risk-controlled rules' verdict for every document."""
    out = quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_files(spark, sf_dir):
    """Every document's ids written to token files in ascending id order and read back."""
    path = scratch_path(spark, "token-files")
    token_files.write(token_files.tokenized(read(spark, sf_dir, "documents"), tokenizer()), path)
    return token_files.checksums(token_files.open_files(spark, path))


def op8_language_id(spark, sf_dir):
    """Every document's language by rank-order profiles learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    model = langid.profiles(docs.where(~F.col("held_out")))
    return langid.identified(docs.select("doc_id", "held_out", "text"), model)


def labelled(docs, labels):
    """Documents with a domain: toxic, or of low quality, or clean; of repeated labels the worst."""
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("_t"), F.min("quality").alias("_q"))
    domain = F.when(F.col("_t") == 1, "toxic").when(F.col("_q") == 0, "junk").when(F.col("_q") == 1, "clean")
    return docs.select("doc_id", "text").join(marks, "doc_id").select("doc_id", "text", domain.alias("domain"))


#: Shares of all tokens that the mix aims at.
TARGETS = {"clean": 0.98, "junk": 0.01, "toxic": 0.01}


def op9_mixing(spark, sf_dir):
    """Every document's posteriors over clean, junk and toxic, and the rate that meets the target weights."""
    docs = read(spark, sf_dir, "documents")
    out = mixing.mixed(docs, labelled(docs, read(spark, sf_dir, "labels")), TARGETS)
    return out.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))], "rate")


def op10_lm_score(spark, sf_dir):
    """Every document's unigram base and self-attention score, learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 1))
    return attention_lm.scored(docs.select("doc_id", "held_out", "text"), docs.where(~F.col("held_out")), tokenizer())


def op12_spelling(spark, sf_dir):
    """Every frequent long word of the damaged texts: its near words, its form and the root of its forms."""
    return spelling.grouped(spelling.counted(spelling.damaged_words(read(spark, sf_dir, "documents"))))


def op13_packing(spark, sf_dir):
    """Every document's pieces, their place in the id stream of the document and in the packed sequences."""
    found = packing.pieces(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    return found.join(packing.packed(found.select("row", "length")), "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op2_decontamination, op3_suffix_dedup, op4_jaccard_join, op5_quality_rules, op7_token_files, op8_language_id, op9_mixing, op10_lm_score, op12_spelling, op13_packing)}
ORACLES = {}
