"""URL filter: explicit host/path rules, and for the rest a path-template tree per host. DataFrame expressions only.

Level by level below a host, a path segment with at least ``least`` pages stays a constant branch, however large its host
is, and all others become one wildcard branch. Constant siblings whose share of good labelled pages does not differ
significantly from that of their siblings together are merged into one branch, ``{first|+others}``. A page's leaf is its template; templates whose smoothed share of good labelled pages is
below a threshold are rejected. Segments beyond ``depth`` form one tail wildcard, so that every path has a template.

Defined cases: a null url or one without ``://`` has an empty host and path and is judged like any page of that host;
without any label every template has the prior and is allowed; repeated rows are judged each; empty tables give empty
results; all of the input's columns other than those that are added stay out of the way (only the named ones are read).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.session import written

DEPTH, LEAST, Z, WEIGHT, PURITY = 5, 20, 2.58, 20.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (verdict, "host/path") that fits, as struct (rule, verdict); equal lengths: the longer host, then
    text order. A rule fits its host and all subdomains, if the path starts with the rule's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), len(r[1].split("/")[0]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grown(pages: DataFrame, depth: int, least: int, z: float) -> DataFrame:
    """Adds ``template``. ``pages`` has host, path and good (boolean, null = not labelled)."""
    rows = pages.withColumn("_segs", F.array_remove(F.split("path", "/"), "")).withColumn("template", F.lit(""))
    rows = written(rows, "url-level")
    for level in range(depth):
        rows = rows.withColumn("_seg", F.get("_segs", F.lit(level)))
        node = ["host", "template"]
        constant = rows.where(F.col("_seg").isNotNull()).groupBy(*node, "_seg").agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("good").cast("double")), F.lit(0.0)).alias("g"), F.count("good").cast("double").alias("m")).where(F.col("n") >= least)
        constant = written(constant, "url-constants")
        pooled = constant.groupBy(*node).agg((F.sum("g") / F.greatest(F.lit(1.0), F.sum("m"))).alias("p"))
        spread = F.col("m") * F.col("p") * (1 - F.col("p"))
        alike = F.abs(F.col("g") - F.col("m") * F.col("p")) <= z * F.sqrt(F.greatest(F.lit(0.0), spread)) + 1e-9
        constant = written(constant.join(pooled, node).select(*node, "_seg", alike.alias("alike")), "url-constants")
        merged = constant.where("alike").groupBy(*node).agg(F.min("_seg").alias("_first"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
        name = F.when(F.col("alike") & F.col("_k").isNotNull(), F.concat(F.lit("{"), "_first", F.lit("|+"), (F.col("_k") - 1).cast("string"), F.lit("}")))
        branches = constant.join(merged, node, "left").select(*node, "_seg", F.coalesce(name, "_seg").alias("_branch"))
        rows = rows.join(branches, [*node, "_seg"], "left").withColumn(
            "template", F.when(F.col("_seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("_branch", F.lit("*"))))).drop("_seg", "_branch")
        rows = written(rows, "url-level")
    tail = F.when(F.size("_segs") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return rows.withColumn("template", tail).drop("_segs")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", good: str = "good", depth: int = DEPTH,
           least: int = LEAST, z: float = Z, weight: float = WEIGHT, purity: float = PURITY) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"), F.col(good).cast("boolean").alias("good"))
    rows = grown(rows, depth, least, z)
    g, m = F.sum(F.coalesce(F.col("good").cast("long"), F.lit(0))), F.count("good")
    leaves = rows.groupBy("host", "template").agg(g.alias("g"), m.alias("m"))
    leaves = written(leaves, "url-templates")
    total = leaves.agg(F.sum("g"), F.sum("m")).first()
    prior = (total[0] or 0) / total[1] if total[1] else 1.0
    hosts = leaves.groupBy("host").agg(((F.sum("g") + weight * prior) / (F.sum("m") + weight)).alias("_host"))
    leaves = leaves.join(hosts, "host").select("host", "template", ((F.col("g") + weight * F.col("_host")) / (F.col("m") + weight)).alias("purity"))
    out = rows.join(leaves, ["host", "template"], "left").withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("purity") < purity, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
