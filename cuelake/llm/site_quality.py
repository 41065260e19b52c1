"""Quality scores that combine a document's own evidence with what its site is like.

A logistic classifier over the statistics of a text gives the evidence of each document. Grouped
sums of it over hosts, and over paths inside hosts, give site means. They are shrunk by empirical
Bayes: a host towards the mean of all documents, a path towards its host, with prior strengths that
the moment method finds in the spread between all sites, weighted by their documents. A site of few
documents thus says little. The shrunk mean of a document's path is the prior that its evidence
updates; its own part is left out of the path and of the host, so a site's only document has the mean
of all documents as prior.

The classifier is trained on a bounded sample of labelled rows (`max_rows`, documented parameter)
that are not held out; everything else covers all rows. Sums are partial before they are shuffled,
so a host with most rows costs one row per task.

Edge cases. Null or empty text: judged by the statistics of an empty text. Null host or path: a site
of its own. No labels, or labels of one kind: no evidence, every score is the prior. Repeated rows
count as often as they come. Other columns are ignored. Empty table: empty result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import held_out, stage_table
from cuelake.llm.quality_rules import FEATURES, document_stats


def _expanded(c: list) -> list:
    """The features and their squares."""
    return [*c, *[x * x for x in c]]


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps; (weights with intercept last, means, scales)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        curve = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(curve, gradient)
        w -= move * min(1.0, 5.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w, mean, scale


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def evidence(stats: DataFrame, labels: DataFrame, max_rows: int) -> tuple[Column, float]:
    """Log likelihood ratio of each row of `stats` as a column, and the share of good labels."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_y_id")).agg(F.max("quality").cast("int").alias("y"))
    share = min(1.0, max_rows / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("_y_id", F.lit(23)), F.lit(1_000_000)) < int(share * 1_000_000))
    # proven bound of both the broadcast and the collected rows: max_rows rows of numbers
    rows = stats.join(F.broadcast(some), F.col("doc_id") == F.col("_y_id")).select(*FEATURES, "y").toPandas()
    y = (rows["y"].to_numpy() > 0).astype(float)
    if len(set(y)) < 2:  # nothing to tell apart: no evidence, and the one label or an even prior
        return F.lit(0.0), min(max(float(y[0]), 0.01), 0.99) if len(y) else 0.5
    base = float(y.mean())
    w, mean, scale = train(np.column_stack(_expanded([rows[f].to_numpy() for f in FEATURES])), y)
    total = F.lit(float(w[-1]) - float(np.log(base / (1 - base))))
    for c, k, m, s in zip(_expanded([F.col(f) for f in FEATURES]), w, mean, scale):
        total = total + (c - F.lit(float(m))) * F.lit(float(k / s))
    return F.least(F.greatest(total, F.lit(-12.0)), F.lit(12.0)), base


def strength(sites: DataFrame, mean: Column) -> DataFrame:
    """Prior strength of a level by the moment method: m (1 - m) / (variance between sites) - 1.
    sites: n, s (rows, summed probabilities) and s2 (summed squares). One row."""
    share = F.col("s") / F.col("n")
    # one variance inside sites for all: that of a site of one document is unknown
    inside = F.sum(F.col("s2") - F.col("s") * share) / F.nullif(F.sum(F.col("n") - 1), F.lit(0))
    around = F.sum(F.col("n") * (share - mean) * (share - mean))
    spread = sites.agg(
        ((around - F.count("*") * inside) / F.sum("n")).alias("v"), (F.sum(F.col("n") * mean) / F.sum("n")).alias("m")
    )
    # between-site variance of a thousandth of the largest possible at least: strength 1 to 1000
    top = F.col("m") * (1 - F.col("m"))
    return spread.select(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.coalesce(top / F.greatest(F.col("v"), top / 1001) - 1, F.lit(1000.0)))).alias("k"))


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_rows: int = 20_000, cut: float = 0.5) -> DataFrame:
    """docs (doc_id, text, host, path) to doc_id, evidence, host_posterior, path_posterior, score, kept."""
    plain = docs.select("doc_id", "text", F.col(path).alias("lang"), F.col(host).alias("source"))
    stats = stage_table(document_stats(plain), "site_stats")
    ratio, base = evidence(stats, labels, max_rows)
    p = 1 / (1 + F.exp(-(ratio + float(np.log(base / (1 - base))))))
    rows = stage_table(stats.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), ratio.alias("evidence"), p.alias("p")), "site_rows")
    paths = stage_table(
        rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2")), "site_paths"
    )
    hosts = stage_table(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")), "site_hosts")
    everything = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()  # one row
    mean = float(everything["s"] or 0.0) / max(1, everything["n"] or 0)
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    row = strength(hosts, F.lit(mean)).first()
    host_k = float(row["k"])
    host_mean = (F.col("s") + host_k * mean) / (F.col("n") + host_k)
    shrunk = hosts.select(F.col("host").alias("h_host"), host_mean.alias("host_posterior"), F.col("n").alias("h_n"), F.col("s").alias("h_s"))
    paths = stage_table(
        paths.join(shrunk, F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host"), "site_posteriors"
    )
    path_k = float(strength(paths, F.col("host_posterior")).first()["k"])
    joined = rows.alias("r").join(
        paths.alias("q"), F.col("r.host").eqNullSafe(F.col("q.host")) & F.col("r.path").eqNullSafe(F.col("q.path"))
    )
    host_others = (F.col("h_s") - F.col("p") + host_k * mean) / (F.col("h_n") - 1 + host_k)
    others = (F.col("s") - F.col("p") + path_k * host_others) / (F.col("n") - 1 + path_k)
    whole = (F.col("s") + path_k * F.col("host_posterior")) / (F.col("n") + path_k)
    final = 1 / (1 + F.exp(-(F.col("evidence") + logit(others))))
    return joined.select(
        "doc_id", "evidence", "host_posterior", whole.alias("path_posterior"), final.alias("score"), (final >= cut).alias("kept")
    )
