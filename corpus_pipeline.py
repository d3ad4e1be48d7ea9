"""The training-data pipeline: each stage works on all that its predecessor kept.

Defined cases, for every stage: a null text counts as empty; null ids and repeated ids are decided row by row; rows that are alike
in all columns share a verdict, but one of them stays as its component's row in the n-gram Jaccard join; of equal rows of a component the
smallest id stays, null ids last; texts of any length are read whole; extra columns come through whatever their names; an empty table gives
an empty result, and empty labels or benchmark tables no rejections by them. The last stage returns ids by position, see
``token_files``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import jaccard, mixing, phrase_index, quality, token_files
from tallyframe.llm.common import read
from tallyframe.llm.q_documents import TARGETS, labelled, tokenizer
from tallyframe.session import scratch_path, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the calibrated rules reject go."""
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity of 0.8 or more."""
    return jaccard.one_per_component(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words inside benchmark passages go."""
    return phrase_index.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is taken as often as its own rate says: those of the toxic and junk domains seldom or never, those that are likely
    clean at least once, as a bound in the least squares."""
    return mixing.resampled(docs, labelled(docs, read(spark, sf_dir, "labels")), TARGETS, keep="clean")[0]


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending id order; the result is read back from them."""
    path = scratch_path(spark, "pipeline-tokens")
    token_files.write(token_files.tokenized(docs, tokenizer()), path)
    return token_files.checksums(token_files.open_files(spark, path))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("mixing sources to target weights", mixing_sources), ("token-ID / binary output", token_output)]
#: Learned thresholds, near duplicates, posteriors and token ids have no SQL; the tests recompute them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + "-".join(name.replace("/", " ").split()))
    return docs
