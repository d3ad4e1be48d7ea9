"""Queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.llm import url_filter, warc
from tallyframe.llm.common import read

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_warc(spark, sf_dir):
    """Every page as a WARC record, read back by byte ranges: one row per record."""
    records = warc.archived(spark, read(spark, sf_dir, "pages"))
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        F.expr("try_cast(record_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_url_filter(spark, sf_dir):
    """Every page's url: explicit rules, else the verdict of its path template. A page is good if the document that the
    last number of its path names is labelled of good quality and not toxic."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    marks = labels.groupBy(F.col("doc_id").alias("_doc")).agg((F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))).alias("good"))
    host, path = url_filter.host_and_path(F.col("url"))
    number = F.expr("try_cast(_digits AS bigint)")
    pages = pages.select("page_id", "url", F.regexp_extract(path, r"(\d+)\D*$", 1).alias("_digits")).withColumn("_doc", number)
    return url_filter.judged(pages.join(marks, "_doc", "left"), RULES)


QUERIES = {"op1_warc": op1_warc, "op6_url_filter": op6_url_filter}
ORACLES = {}
