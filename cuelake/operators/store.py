"""Job collections: identity, validation, upserts, deletion and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.checks import finite_nonnegative, one_of, whole, within
from cuelake.operators.paragraphs import extent
from cuelake.session import stage_table
from cuelake.sources.links import WATCH_URL

# Enumerations and ranges of stored rows.
REQUESTED = ["auto", "ko", "en"]
SOURCE_TYPES = ["manual", "asr", "transcription", "visual"]
QUALITIES = ["source", "provider", "chunk-estimated", "none"]
MODES = ["captions", "audio", "slides"]
STATE_STATUSES = ["pending", "completed", "failed", "incomplete", "unknown-billing", "excluded"]
SETTING_RANGES = {
    "sample_rate": (0.5, 4, False), "detection_width": (192, 1024, True), "sensitivity": (0.5, 3, False),
    "refine_step": (0.1, 0.25, False), "stable_samples": (2, 4, True), "max_candidates": (2, 1000, True),
    "max_requests": (1, 2000, True), "budget_usd": (0.01, 1000, False), "allowance": (0, 2, False),
    "input_tokens_per_megapixel": (100, 100_000, False), "output_allowance": (512, 8192, True), "retry_allowance": (0, 2, True),
}
RESERVED_PREFIX = "__internal:"


def job_identity() -> Column:
    """Explicit id, else video and language, else file fingerprint (or name, size, time) and age."""
    c = F.col
    video = F.nullif(c("video_id"), F.lit(""))
    print_ = F.coalesce(
        F.nullif(c("fingerprint"), F.lit("")), F.concat_ws(":", "file_name", "size_bytes", "last_modified")
    )
    return (
        F.when(T.trim(F.coalesce("id", F.lit(""))) != "", c("id"))
        .when(video.isNotNull() & ~F.coalesce(c("kind") == "upload", F.lit(False)), F.concat(F.lit("youtube:"), video, F.lit(":"), "language"))
        .when(c("kind") == "upload", F.concat(F.lit("upload:"), print_, F.lit(":"), c("created_at").cast("string")))
    )


def capture_jobs(captures: DataFrame, segments: DataFrame, requested_lang: str, created_at: Column) -> DataFrame:
    """Captures with their cleaned segments as jobs: the title falls back to the video, the duration
    to the end of the last segment, and the summary is still empty.

    captures: media_id, video_id, title, language, source_type, provider, provider_label,
    duration_sec."""
    known = extent(segments).select("media_id", F.col("duration_ms").alias("__end"), F.col("segment_count").alias("__n"))
    told = F.nullif(F.col("duration_sec"), F.lit(0.0))
    return captures.join(known, "media_id", "left").select(
        "media_id", "video_id", F.concat(F.lit(WATCH_URL), "video_id").alias("url"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("video_id")).alias("title"),
        "language", F.lit(requested_lang).alias("requested_lang"), "source_type", "provider", "provider_label",
        F.coalesce("__n", F.lit(0)).cast("bigint").alias("segment_count"),
        F.coalesce(told, F.col("__end") / 1000, F.lit(0.0)).alias("duration_sec"),
        created_at.alias("created_at"), F.lit("general").alias("summary_kind"), F.lit("").alias("summary"),
    )


def normalize_jobs(jobs: DataFrame) -> DataFrame:
    """Identity, source kind and defaults; jobs without any identity have a null id."""
    kind = F.coalesce("kind", F.when(F.col("video_id").isNotNull() & F.col("url").isNotNull(), "youtube"))
    known = F.col("summary_kind").isin(list(T.SUMMARY_KINDS))
    return jobs.withColumn("kind", kind).withColumns({
        "id": job_identity(),
        "summary_kind": F.when(F.coalesce(known, F.lit(False)), F.col("summary_kind")).otherwise("general"),
        "summary": F.coalesce("summary", F.lit("")),
        "timestamp_quality": F.coalesce("timestamp_quality", F.when(F.col("kind") == "youtube", "source").otherwise("none")),
    })


def job_checks() -> dict[str, Column]:
    c = F.col
    maybe = lambda col, ok: col.isNull() | ok
    upload, video = c("kind") == "upload", c("kind") == "youtube"
    slides = F.coalesce(c("processing_mode") == "slides", F.lit(False))
    visual = F.coalesce(c("source_type") == "visual", F.lit(False))
    return {
        "metadata": c("title").isNotNull() & c("language").isNotNull() & c("provider").isNotNull() & c("provider_label").isNotNull(),
        "requested_lang": one_of(c("requested_lang"), REQUESTED),
        "source_type": one_of(c("source_type"), SOURCE_TYPES),
        "segment_count": finite_nonnegative(c("segment_count")),
        "duration_sec": finite_nonnegative(c("duration_sec")),
        "created_at": finite_nonnegative(c("created_at")),
        "id": maybe(c("id"), T.trim(c("id")) != ""),
        "source": F.when(upload, c("file_name").isNotNull() & c("mime_type").isNotNull() & finite_nonnegative(c("size_bytes"))
                         & maybe(c("last_modified"), finite_nonnegative(c("last_modified"))))
        .when(video | c("kind").isNull(), T.present(c("video_id")) & c("url").isNotNull()).otherwise(False),
        "timestamp_quality": maybe(c("timestamp_quality"), c("timestamp_quality").isin(QUALITIES)),
        "processing_mode": maybe(c("processing_mode"), c("processing_mode").isin(MODES)),
        "visual": F.when(slides, visual & F.coalesce(upload, F.lit(False)) & (F.coalesce("summary", F.lit("")) == "") & (c("segment_count") == 0))
        .otherwise(~visual),
    }


def settings_checks() -> dict[str, Column]:
    out = {}
    for name, (low, high, integral) in SETTING_RANGES.items():
        ok = within(F.col(name), low, high)
        out[name] = ok & whole(F.col(name)) if integral else ok
    out["profile"] = one_of(F.col("profile"), ["standard", "economy"])
    return out


def state_checks() -> dict[str, Column]:
    c = F.col
    return {
        "id": F.length("state_id").between(1, 128),
        "interval": finite_nonnegative(c("start_ms")) & (c("end_ms") >= c("start_ms")),
        "boundary": finite_nonnegative(c("low_ms")) & (c("high_ms") >= c("low_ms")),
        "status": one_of(c("status"), STATE_STATUSES),
    }


def crop_checks() -> dict[str, Column]:
    c = F.col
    return {
        "size": within(c("width"), 1, 8192) & within(c("height"), 1, 8192) & (c("width") * c("height") <= 16_777_216),
        "inside": (c("x") + c("width") <= c("full_width")) & (c("y") + c("height") <= c("full_height")),
        "hash": F.regexp_like("hash", F.lit("^[a-f0-9]{64}$")),
    }


def setting_key_ok(key: Column) -> Column:
    return F.coalesce((key != "") & ~F.startswith(key, F.lit(RESERVED_PREFIX)), F.lit(False))


def upsert(existing: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """A new row replaces the old one with its key, the last listed (``ord``) first. The rows of
    one key meet in partial maxima, so copies of a key are never gathered."""
    e = existing.withColumns({"__new": F.lit(0), "__ord": F.lit(0).cast("bigint")})
    f = fresh.withColumn("__new", F.lit(1)).withColumnRenamed("ord", "__ord")
    rest = F.struct(*[c for c in existing.columns if c != key])
    return e.unionByName(f).groupBy(key).agg(F.max_by(rest, F.struct("__new", "__ord")).alias("r")).select(key, "r.*")


def duplicate_identities(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def import_legacy(
    existing: DataFrame, old: DataFrame, new: DataFrame, receipts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(jobs, receipts): both legacy lists, the newer wins per id; never over an existing job; an
    id with a receipt is not imported again, so deleted jobs stay deleted."""
    both = old.withColumn("__v", F.lit(1)).unionByName(new.withColumn("__v", F.lit(2)))
    rest = F.struct(*[c for c in existing.columns if c != "id"])
    best = both.groupBy("id").agg(F.max_by(rest, F.struct("__v", "ord")).alias("r")).select("id", "r.*")
    fresh = best.join(receipts.select("id"), "id", "left_anti").join(existing.select("id"), "id", "left_anti")
    return existing.unionByName(fresh), receipts.select("id").unionByName(both.select("id")).distinct()


def delete_jobs(ids: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Remove the jobs and their dependent rows (each table has job_id)."""
    return tuple(t.join(ids.select("job_id"), "job_id", "left_anti") for t in tables)


def save_jobs(path: str, jobs: DataFrame) -> None:
    """The collection as a plain table. It is written aside first, so that jobs read from the same
    path can be saved there."""
    stage_table(jobs, "jobs").write.mode("overwrite").parquet(path)


def load_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Newest job first."""
    return spark.read.parquet(path).orderBy(F.col("created_at").desc())
