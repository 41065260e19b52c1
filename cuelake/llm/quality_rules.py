"""Quality rules: base rules on word statistics, then robust multivariate outliers.

Each document gets exact counts (words, word characters, symbols, repeated lines, words in repeated
five-word windows) and a transformed vector of rates. For every language and source a minimum-
covariance-determinant estimate of centre and scatter is fitted over all rows that pass the base
rules; rows whose Mahalanobis distance exceeds the cutoff are rejected.

The concentration steps run as grouped aggregation. A step bins the rows of a group by their
distance under the last estimate and sums first and second moments per bin; the bins nearest the
centre that together hold `keep_share` of the group (the last one in part) give the next estimate.
A group of any size thus costs one row per bin and task, and no row is sampled.

Languages and sources with fewer than `min_rows` rows are pooled by language, then altogether; a
pool that is still smaller has no estimate and its rows are kept unless a base rule fails.

Edge cases. Null text: no words, so a base rule fails. Null language or source: a group of its own.
Null or repeated ids: every row is judged by itself and returned. Empty table: empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import row_hash, split_words, stage_table, text_batches, wrapped

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

FEATURES = ["f_length", "f_symbol", "f_upper", "f_dup", "f_repeat", "f_variety", "f_mark"]
# Least standard deviation of a feature: the resolution below which a rate says nothing. It keeps
# the scatter regular where most rows of a group share one value.
FLOORS = [0.08, 0.04, 0.04, 0.10, 0.10, 0.04, 0.05]

STATS = (
    "doc_id string, row_key long, lang string, source string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"{c} double" for c in FEATURES)
)

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 1], dtype=np.uint64)


def repeat_words(words: list[str]) -> int:
    """Words inside five-word windows that occur twice or more in the text, the first included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mixed = sum(hashes[i : n - WINDOW + 1 + i] * _MIX[i] for i in range(WINDOW))
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice))  # a superset: equal windows have equal hashes
    seen = Counter(tuple(words[i : i + WINDOW]) for i in at)
    covered = np.zeros(n + 1, np.int32)
    for i in at:
        if seen[tuple(words[i : i + WINDOW])] > 1:
            covered[i] += 1
            covered[min(i + WINDOW, n)] -= 1
    return int((np.cumsum(covered[:n]) > 0).sum())


def text_stats(text: str) -> tuple[float, ...]:
    """The five counts of a text and its transformed vector, in the order of STATS."""
    words = split_words(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line and line.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    upper = int(((points >= 65) & (points <= 90)).sum() + ((points >= 192) & (points <= 222)).sum())
    marks = int(((points > 32) & (points < 65)).sum() + ((points > 90) & (points < 97)).sum() + ((points > 122) & (points < 127)).sum())
    some = max(n, 1)
    features = (
        np.log(max(chars, 1) / some),
        np.sqrt(symbols / (chars + 50.0)),
        np.sqrt(upper / (chars + 50.0)),
        np.sqrt(dup_lines / (len(lines) + 5.0)),
        np.sqrt(repeated / (n + 20.0)),
        np.log(len(set(words)) + 20.0) / np.log(n + 20.0),
        np.sqrt(marks / (chars + 50.0)),
    )
    return (n, chars, symbols, dup_lines, repeated, *features)


def document_stats(docs: DataFrame) -> DataFrame:
    """One row of counts and features for each row of `docs` (doc_id, text, lang, source)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [text_stats(t or "") for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES])
            out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
            for c in ("doc_id", "row_key", "lang", "source"):
                out[c] = batch[c].to_numpy()
            yield out

    text = F.col("text")
    # ids travel as text: pandas has no plain integer column with nulls
    plain = text_batches(docs).select(
        F.col("doc_id").cast("long").cast("string").alias("doc_id"), row_hash(text).alias("row_key"), text,
        F.col("lang").cast("string"), F.col("source").cast("string"),
    )
    return plain.mapInPandas(read, STATS).withColumn("doc_id", F.col("doc_id").cast("long"))


def _pool_key(by: list[str]) -> Column:
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"})


def pooled(stats: DataFrame, min_rows: int) -> DataFrame:
    """Map of (lang, source) to the pool that its rows are judged in: itself, its language's sparse
    sources, or all sparse rows. One row per language and source."""
    counts = stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    sparse = F.col("n") < min_rows
    by_lang = counts.where(sparse).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    rare = sparse & (F.col("n_lang") < min_rows)
    return (
        counts.alias("c")
        .join(by_lang.alias("l"), F.col("c.lang").eqNullSafe(F.col("l.lang")), "left")
        .select("c.lang", "c.source", "n", "n_lang")
        .withColumn(
            "pool",
            F.when(rare, F.lit("*")).when(sparse, _pool_key(["lang"])).otherwise(_pool_key(["lang", "source"])),
        )
        .drop("n", "n_lang")
    )


def _distance(params: str = "p") -> Column:
    """Squared Mahalanobis distance from the pool's centre, with the inverse scatter's upper half."""
    d = len(FEATURES)
    moved = [F.col(f) - F.col(f"{params}.centre")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    at = 0
    for i in range(d):
        for j in range(i, d):
            total = total + F.col(f"{params}.inverse")[at] * moved[i] * moved[j]
            at += 1
    return F.greatest(total, F.lit(0.0))


def _invert(frame: pd.DataFrame) -> pd.DataFrame:
    """Centre and inverse scatter of each pool from its moments (one row per pool)."""
    d = len(FEATURES)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    floors = np.square(FLOORS)
    out = []
    for row in frame.itertuples(index=False):
        m = np.asarray(row.moments, float)
        n, centre = m[0], m[1 : d + 1] / max(m[0], 1e-9)
        scatter = np.zeros((d, d))
        for (i, j), s in zip(upper, m[d + 1 :]):
            scatter[i, j] = scatter[j, i] = s / max(n, 1e-9) - centre[i] * centre[j]
        scatter = scatter * row.factor + np.diag(floors)
        inverse = np.linalg.inv(scatter)
        out.append((row.pool, centre.tolist(), [inverse[i, j] * (1 if i == j else 2) for i, j in upper]))
    return pd.DataFrame(out, columns=["pool", "centre", "inverse"])


PARAMS = "pool string, centre array<double>, inverse array<double>"


def _as_params(moments: DataFrame, label: str) -> DataFrame:
    """moments: pool, moments (count, sums, upper products), factor. Staged: one row per pool."""
    params = moments.mapInPandas(lambda parts: (_invert(p) for p in parts), PARAMS)
    return stage_table(params, label)


def mcd_parameters(rows: DataFrame, keep_share: float = 0.5, steps: int = 4, min_rows: int = 100) -> DataFrame:
    """Centre and inverse scatter per pool of `rows` (pool and features), by concentration steps from
    the median and the median absolute deviation. Pools under `min_rows` are left out."""
    d = len(FEATURES)
    products = [F.col(FEATURES[i]) * F.col(FEATURES[j]) for i in range(d) for j in range(i, d)]
    sums = [F.count("*").cast("double"), *[F.sum(f) for f in FEATURES], *[F.sum(p) for p in products]]
    width = len(sums)

    def medians(of: list[Column]) -> list[Column]:
        return [F.percentile_approx(c, 0.5, 1000).alias(f"q_{f}") for c, f in zip(of, FEATURES)]

    middle = stage_table(
        rows.groupBy("pool").agg(F.count("*").alias("n"), *medians([F.col(f) for f in FEATURES])).where(F.col("n") >= min_rows), "mcd_medians"
    )
    off = medians([F.abs(F.col(f"r.{f}") - F.col(f"m.q_{f}")) for f in FEATURES])
    spreads = rows.alias("r").join(middle.alias("m"), "pool").groupBy("pool").agg(*off)
    # as moments of one pseudo-row: centre at the median, spread from the absolute deviations, no correlation
    centre = [F.col(f"m.q_{f}") for f in FEATURES]
    spread = [F.col(f"d.q_{f}") * 1.4826 for f in FEATURES]
    start = middle.alias("m").join(spreads.alias("d"), "pool").select(
        "pool",
        F.array(
            F.lit(1.0), *centre,
            *[centre[i] * centre[j] + (spread[i] * spread[i] if i == j else F.lit(0.0)) for i in range(d) for j in range(i, d)],
        ).alias("moments"),
        F.lit(1.0).alias("factor"),
    )
    params = _as_params(start, "mcd_start")
    for step in range(steps):
        near = (
            rows.join(params.alias("p"), "pool")
            .withColumn("bin", F.floor(F.log2(_distance() + 0.01) * 6))
            .groupBy("pool", "bin")
            .agg(*[s.alias(f"m{i}") for i, s in enumerate(sums)])
        )
        by_bin = near.select("pool", "bin", F.array(*[f"m{i}" for i in range(width)]).alias("m"))
        # A pool has one row per bin, a few dozen at most, so its bins are ordered inside one array.
        ordered = by_bin.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("bin", "m"))).alias("bins"))
        total = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["m"][0])
        empty = F.array_repeat(F.lit(0.0), width)
        moments = F.aggregate(
            "bins",
            F.struct(F.lit(0.0).alias("seen"), empty.alias("m")),
            lambda a, b: F.struct(
                (a["seen"] + b["m"][0]).alias("seen"),
                F.zip_with(
                    a["m"], b["m"],
                    lambda x, y: x + y * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("total") * keep_share - a["seen"]) / b["m"][0])),
                ).alias("m"),
            ),
            lambda a: a["m"],
        )
        nearest = ordered.withColumn("total", total).select("pool", moments.alias("moments"), F.lit(consistency(keep_share, d)).alias("factor"))
        params = _as_params(nearest, f"mcd_step{step}")
    return params


def chi_square_quantile(p: float, d: int) -> float:
    """Wilson-Hilferty approximation of the chi-square quantile."""
    from statistics import NormalDist

    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def consistency(share: float, d: int) -> float:
    """Factor that makes the scatter of the nearest `share` of normal rows unbiased."""
    q = chi_square_quantile(share, d)
    grid = np.linspace(1e-6, q, 4001)
    density = np.exp(np.log(grid) * (d / 2) - grid / 2)  # of d + 2 degrees, up to a constant
    whole = np.linspace(1e-6, q * 40, 160_001)
    full = np.exp(np.log(whole) * (d / 2) - whole / 2)
    inside = np.trapezoid(density, grid) / np.trapezoid(full, whole)
    return share / inside


def judge(docs: DataFrame, keep_share: float = 0.5, steps: int = 4, min_rows: int = 100, cutoff: float = 45.0) -> DataFrame:
    """docs (doc_id, text, lang, source) to one row of counts, base verdict, distance and `kept`.

    `cutoff` bounds the squared distance. It is one and a half times a normal law's 0.9999 quantile (30 for
    seven features), because rates of short texts have heavy tails and sound rows must stay."""
    stats = stage_table(document_stats(docs), "quality_stats")
    pools = stage_table(pooled(stats, min_rows), "quality_pools")
    keyed = stats.alias("s").join(
        pools.alias("q"), F.col("s.lang").eqNullSafe(F.col("q.lang")) & F.col("s.source").eqNullSafe(F.col("q.source")), "left"
    ).select("s.*", "q.pool")
    fitted = keyed.where(~F.col("base_failed")).select("pool", *FEATURES)
    params = mcd_parameters(fitted, keep_share, steps, min_rows)
    judged = keyed.join(params.alias("p"), "pool", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return judged.select(
        "doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), "distance", "lang", "source",
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with their own columns only."""
    bad = judge(docs, **options).where(~F.col("kept")).select(
        F.col("doc_id").alias("_q_id"), F.col("row_key").alias("_q_key"), F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source")
    )
    same = (
        F.col("doc.doc_id").cast("long").eqNullSafe(F.col("_q_id"))
        & row_hash(F.col("doc.text")).eqNullSafe(F.col("_q_key"))
        & F.col("doc.lang").eqNullSafe(F.col("_q_lang"))
        & F.col("doc.source").eqNullSafe(F.col("_q_source"))
    )
    return wrapped(docs).join(stage_table(bad, "quality_rejected"), same, "left_anti").select("doc.*")
