"""Mixing to target weights with soft domain membership, in DataFrame expressions only.

A naive Bayes classifier learned from a labelled table gives every document a posterior over domains. Documents get
nonnegative rates so that the expected tokens of each domain - the sum of rate, tokens and posterior - match the target
weights: least squares on the domain totals, with a small pull towards rate 1, by projected gradient steps. All documents see
the same gradient, one number per domain, so a step is one aggregate over the posteriors, and the driver only ever holds a
few numbers per step.

Learning uses a documented bounded sample of labelled rows (about ``SAMPLE`` rows by a hash of their id) and keeps the
``WORDS`` words that tell domains apart best; totals, steps and rates cover all rows.

Defined cases: null and blank texts have no words and the prior as posterior; without labelled rows, or with
one domain only, every rate is 1; a domain without any posterior weight cannot be met and stays at 0; repeated rows are rated
each; a null label leaves its row out of the learning; an empty table gives no rows.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.session import written

SAMPLE, WORDS, SMOOTH, STEPS, PULL, LEAST_ROWS = 20_000, 400, 0.5, 25, 0.002, 8


def words(text: Column) -> Column:
    """Lower-cased words of the whole text, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def learned(labelled: DataFrame, domains: list[str], text: str, domain: str, key: str) -> dict:
    """Selected words with their log probability per domain, and the domains' log shares. At most ``WORDS`` rows and a few
    numbers come to the driver."""
    counts = dict(labelled.where(F.col(domain).isin(domains)).groupBy(domain).count().collect())
    total = sum(counts.values())
    known = [d for d in domains if counts.get(d)]
    if len(known) < 2:
        return {"domains": domains, "words": [], "prior": [0.0] * len(domains), "weight": {}}
    share = min(1.0, SAMPLE / total)
    sample = labelled.where(F.col(domain).isin(known) & (F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < math.ceil(share * 1_000_000)))
    sample = written(sample.select(F.col(domain).alias("d"), F.array_distinct(words(F.col(text))).alias("w")), "mixing-sample")
    sizes = dict(sample.groupBy("d").count().collect())
    present = [F.sum((F.col("d") == d).cast("int")).cast("double").alias(f"n{i}") for i, d in enumerate(known)]
    table = sample.select("d", F.explode("w").alias("word")).groupBy("word").agg(*present)
    table = table.where(sum((F.col(f"n{i}") for i in range(len(known))), F.lit(0.0)) >= LEAST_ROWS)
    rate = [(F.col(f"n{i}") + SMOOTH) / (sizes.get(d, 0) + 2 * SMOOTH) for i, d in enumerate(known)]
    # how well presence tells a domain from the others: the largest gap of log rates, weighted by its rate
    logits = [F.log(r) for r in rate]
    gap = (F.array_max(F.array(*logits)) - F.array_min(F.array(*logits))) * F.sqrt(F.array_max(F.array(*rate)))
    best = table.select("word", gap.alias("gap"), F.array(*rate).alias("rate")).orderBy(F.col("gap").desc(), "word").limit(WORDS).collect()
    # a document's selected words are drawn from its domain's distribution over them; without any, the prior stands
    prior, weight = [], {r["word"]: [] for r in best}
    for d in domains:
        at = known.index(d) if d in known else None
        prior.append(-1e9 if at is None else math.log(counts[d] / total))
        mass = sum(r["rate"][at] for r in best) if at is not None else 1.0
        for r in best:
            weight[r["word"]].append(0.0 if at is None else math.log(r["rate"][at] / mass))
    return {"domains": domains, "words": [r["word"] for r in best], "prior": prior, "weight": weight}


def summed(at: Column, weights: Column, start: float) -> Column:
    return F.aggregate(at, F.lit(start), lambda s, k: s + F.element_at(weights, k))


def posteriors(docs: DataFrame, model: dict, text: str) -> DataFrame:
    """Adds ``n_tokens`` (words of the text) and ``posterior`` (array of doubles, one per domain)."""
    out = docs.withColumn("_w", words(F.col(text)))
    if not model["words"]:
        even = F.array(*[F.lit(1.0 / len(model["domains"])) for _ in model["domains"]])
        return out.withColumn("n_tokens", F.size("_w").cast("long")).withColumn("posterior", even).drop("_w")
    out = out.withColumn("_hit", F.array_intersect("_w", F.array(*[F.lit(w) for w in model["words"]])))
    # a hit's place in the constant word list; then one constant array of weights per domain
    places = F.array(*[F.xxhash64(F.lit(w)) for w in model["words"]])
    out = out.withColumn("_at", F.transform("_hit", lambda w: F.array_position(places, F.xxhash64(w)).cast("int")))
    logs = []
    for i, prior in enumerate(model["prior"]):
        logs.append(summed(F.col("_at"), F.array(*[F.lit(float(model["weight"][w][i])) for w in model["words"]]), float(prior)))
    out = out.withColumn("_log", F.array(*logs)).withColumn("_top", F.array_max("_log"))
    out = out.withColumn("_e", F.transform("_log", lambda x: F.exp(x - F.col("_top"))))
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("n_tokens", F.size("_w").cast("long")).withColumn("posterior", F.transform("_e", lambda x: x / total)).drop("_w", "_hit", "_at", "_log", "_top", "_e")


def rate_after(steps: list[list[float]], pull: float, size: float, least: Column | None = None) -> Column:
    """A row's rate after the steps' gradients: r <- max(least, r - size (p . g + pull (r - 1))), from 1. ``least`` is 0 or a column from 0
    to 1."""
    least = F.lit(0.0) if least is None else least
    if not steps:
        return F.lit(1.0)
    gradients = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    dot = lambda g: F.aggregate(F.zip_with(g, F.col("posterior"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(gradients, F.lit(1.0), lambda r, g: F.greatest(least, r - F.lit(size) * (dot(g) + F.lit(pull) * (r - 1.0))))


def scales(second: list[list[float]], pull: float) -> tuple[list[float], float]:
    """Domain weights and the step size from the second moments sum t p p' / sum t. Weights of one over a domain's share give all
    domains about the same curvature; the step is one over the largest row sum of the weighted moments, a bound of it."""
    weight = [1.0 / max(sum(row), 1e-3) for row in second]
    width = range(len(weight))
    return weight, 1.0 / (max(sum(second[i][k] * math.sqrt(weight[i] * weight[k]) for k in width) for i in width) + pull)


def rated(scored: DataFrame, targets: list[float], steps: int = STEPS, pull: float = PULL, least: Column | None = None) -> tuple[DataFrame, list[float]]:
    """Adds ``rate`` to rows with ``n_tokens`` and ``posterior``, and returns the domains' shares that the rates reach.
    Targets are shares of all tokens. With T the expected domain totals as shares, the objective is
    1/2 sum_d w_d (T_d(r) - target_d)^2 + pull/2 sum t_i (r_i - 1)^2 / sum t_i; a row's gradient is taken per token, see ``scales`` for w."""
    total = scored.agg(F.sum("n_tokens")).first()[0] or 0
    width = len(targets)
    if not total:
        return scored.withColumn("rate", F.lit(1.0)), [0.0] * width

    def shares(history: list[list[float]], size: float) -> list[float]:
        r = rate_after(history, pull, size, least)
        row = scored.select("n_tokens", "posterior", r.alias("r")).agg(*[F.sum(F.col("n_tokens") * F.col("r") * F.col("posterior")[i]) for i in range(width)]).first()
        return [(x or 0.0) / total for x in row]

    cells = scored.agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[i] * F.col("posterior")[k]) for i in range(width) for k in range(width)]).first()
    second = [[(cells[i * width + k] or 0.0) / total for k in range(width)] for i in range(width)]
    weight, size = scales(second, pull)
    history: list[list[float]] = []
    reached = shares(history, size)
    for _ in range(steps):
        gap = [a - b for a, b in zip(reached, targets)]
        if max(map(abs, gap)) < 1e-4:
            break
        history.append([w * g for w, g in zip(weight, gap)])
        reached = shares(history, size)
    if max(abs(a - b) for a, b in zip(reached, targets)) > 0.01:
        logging.getLogger(__name__).warning("targets %s are not met: %s", targets, reached)
    return scored.withColumn("rate", rate_after(history, pull, size, least)), reached


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain") -> DataFrame:
    """(key, n_tokens, posterior, rate) of every row; domains in the order of their names."""
    domains = sorted(targets)
    total = sum(targets.values())
    model = learned(labelled, domains, text, domain, key)
    scored = posteriors(docs.select(F.col(key), F.col(text)), model, text).select(key, "n_tokens", "posterior")
    scored = written(scored, "mixing-posteriors")
    if not model["words"]:
        return scored.withColumn("rate", F.lit(1.0))
    out, _ = rated(scored, [targets[d] / total for d in domains])
    return out


def resampled(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: str | None = None, key: str = "doc_id", text: str = "text", domain: str = "domain") -> tuple[DataFrame, list[float]]:
    """(rows of ``docs`` as often as their own rate says, the domains' expected shares by the rates). ``keep`` names a domain none of whose
    likely rows (posterior of one half or more) may go: their rates are at least 1, as a bound in the least squares, so the other rates
    make up for it. The rates alone decide; they are per row, so unlike texts of one id, and null ids, have their own."""
    domains = sorted(targets)
    total = sum(targets.values())
    model = learned(labelled, domains, text, domain, key)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    scored = written(posteriors(rows, model, "text").drop("text"), "mixing-rows")
    if not model["words"]:
        return docs, [0.0] * len(domains)
    least = F.when(F.col("posterior")[domains.index(keep)] >= 0.5, 1.0).otherwise(0.0) if keep else None
    out, reached = rated(scored, [targets[d] / total for d in domains], least=least)
    times = copies(F.col("rate"), F.xxhash64(F.col("row")[key], F.col("row")[text]))
    return out.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*"), reached


def copies(rate: Column, key: Column) -> Column:
    """How often a row is taken: the rate's whole part, and one more with the probability of the rest, by a hash of the key."""
    draw = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")
