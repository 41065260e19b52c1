"""Caption tracks, failure classes and the choice between providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T

HARD_FAILURES = ["unavailable", "age_restricted", "members_only", "provider_blocked"]
PREFERRED = ("ko", "en")


def _rank(requested: str, preferred: tuple[str, ...]) -> Column:
    """Smaller is better; null means the track is not acceptable."""
    code, manual = F.col("language_code"), F.col("source_type") == "manual"
    within = F.when(manual, 0).otherwise(1)
    if requested != "auto":
        return F.when(T.lang_matches(code, F.lit(requested)), within)
    rank = F
    for i, want in enumerate(preferred):
        rank = rank.when(T.lang_matches(code, F.lit(want)), within + 2 * i)
    return rank.otherwise(within + 2 * len(preferred))


def pick_track(tracks: DataFrame, requested: str = "auto", preferred: tuple[str, ...] = PREFERRED) -> DataFrame:
    """Best track per recording: the requested language (manual first), or the preferred
    languages in turn, then any manual track, then the first. Partial aggregation, no window."""
    rank = _rank(requested, preferred)
    whole = F.struct(*[c for c in tracks.columns if c != "media_id"])
    best = tracks.where(rank.isNotNull()).groupBy("media_id").agg(
        F.min_by(whole, F.struct(rank.alias("r"), F.col("pos").alias("p"))).alias("t")
    )
    return best.select("media_id", "t.*")


def pick_concrete(tracks: DataFrame, chosen: DataFrame) -> DataFrame:
    """First concrete track of the same kind whose language matches the chosen one."""
    c = chosen.select(
        "media_id", F.col("language_code").alias("want"), F.col("source_type").alias("kind")
    )
    hit = T.lang_matches(F.col("language_code"), F.col("want")) & (F.col("source_type") == F.col("kind"))
    whole = F.struct(*[x for x in tracks.columns if x != "media_id"])
    return tracks.join(c, "media_id").where(hit).groupBy("media_id").agg(
        F.min_by(whole, F.col("pos")).alias("t")
    ).select("media_id", "t.*")


def playability_class(status: Column, reason: Column) -> Column:
    """Failure code of a player status, or null when playable."""
    s, r = F.upper(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(reason, F.lit("")))
    says = lambda *words: F.regexp_like(r, F.lit("|".join(words)))
    return (
        F.when((s == "") & (r == ""), F.lit(None).cast("string"))
        .when(says("age", "inappropriate"), "age_restricted")
        .when(says("members-only", "members only", "join this channel"), "members_only")
        .when((s == "LOGIN_REQUIRED") & says("private"), "unavailable")
        .when(s.isin("UNPLAYABLE", "ERROR") | says("unavailable", "not available"), "unavailable")
    )


def language_missing(tracks: DataFrame, requested: str, preferred: tuple[str, ...] = PREFERRED) -> DataFrame:
    """Recordings without the requested language: available codes and the fallback. The list of
    tracks of one recording is its languages, a bounded set once made distinct."""
    got = pick_track(tracks, requested, preferred).select("media_id")
    miss = tracks.join(got, "media_id", "left_anti")
    name = F.concat("language_code", F.when(F.col("is_auto"), " (auto)").otherwise(""))
    named = miss.groupBy("media_id", name.alias("name")).agg(F.min("pos").alias("pos"))
    listed = named.groupBy("media_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ", ").alias("available")
    )
    fallback = pick_track(miss, "auto", preferred).select("media_id", F.col("language_code").alias("fallback"))
    return listed.join(fallback, "media_id").withColumn("code", F.lit("language_missing"))


def transcription_failure(status: Column) -> Column:
    code = (
        F.when(status.isin(401, 403), "provider_auth_failed").when(status == 429, "provider_rate_limited")
        .when(status == 413, "chunk_too_large").otherwise("transcription_failed")
    )
    return F.struct(code.alias("code"), ((status == 429) | ((status >= 500) & (code == "transcription_failed"))).alias("retryable"))


def extraction_failure(status: Column, error_code: Column, retry_after: Column) -> Column:
    spent = F.coalesce(error_code.isin("insufficient_quota", "billing_hard_limit_reached"), F.lit(False))
    again = (status == 429) & ~spent
    wait = F.coalesce(F.nullif(retry_after.try_cast("double"), F.lit(0.0)), F.lit(2.0))
    return F.struct(
        F.when(spent, "quota_exhausted").when(again, "rate_limited").when(status == 404, "model_unavailable")
        .otherwise("provider_rejected").alias("code"),
        again.alias("retryable"),
        F.least(F.lit(30.0), F.greatest(F.lit(1.0), wait)).alias("retry_after"),
        F.when(status.isin(400, 401, 403, 404, 422, 429), "none").otherwise("unknown").alias("billing"),
    )


def resolve_captures(captures: DataFrame, requested: str) -> DataFrame:
    """captures(media_id, provider 1|2, attempt, ok, language, error): the first acceptable capture,
    else the more specific error.

    The first provider's attempts stop at a hard failure; with ``auto`` a first attempt for a
    preferred language must be in that language (``wanted``)."""
    want = F.lit(requested) if requested != "auto" else F.col("wanted")
    fits = want.isNull() | T.lang_matches(F.coalesce("language", F.lit("")), F.coalesce(want, F.lit("")))
    acceptable = F.col("ok") & (fits if requested != "auto" else F.coalesce(fits, F.lit(True)))
    hard = ~F.col("ok") & F.col("error").isin(HARD_FAILURES)
    rows = captures.withColumns({"__good": acceptable, "__hard": F.coalesce(hard, F.lit(False))})
    per = rows.groupBy("media_id", "provider").agg(
        F.min(F.when(F.col("__good"), F.col("attempt"))).alias("good"),
        F.min(F.when(F.col("__hard"), F.col("attempt"))).alias("hard"),
        F.min_by("error", F.when(F.col("__hard"), F.col("attempt"))).alias("hard_error"),
        F.max_by(F.struct("ok", "error"), F.col("attempt")).alias("last"),
    )
    works = F.col("good").isNotNull() & (F.col("hard").isNull() | (F.col("good") < F.col("hard")))
    error = F.when(F.col("hard").isNotNull(), F.col("hard_error")).when(
        F.col("last.ok"), F.lit("language_missing")
    ).otherwise(F.col("last.error"))
    sides = per.groupBy("media_id").agg(
        F.min(F.when(works, F.struct("provider", F.col("good").alias("attempt")))).alias("win"),
        F.max(F.when(F.col("provider") == 1, F.when(~works, error))).alias("first"),
        F.max(F.when(F.col("provider") == 2, F.when(~works, error))).alias("second"),
    )
    second_better = F.col("second").isin("no_captions", "language_missing")
    return sides.select(
        "media_id", F.col("win.provider").alias("provider"), F.col("win.attempt").alias("attempt"),
        F.when(F.col("win").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("first").isNull() | (F.col("first") == "network"), F.coalesce("second", "first"))
        .when(F.coalesce(second_better, F.lit(False)), F.col("second"))
        .otherwise(F.col("first")).alias("error"),
    )
