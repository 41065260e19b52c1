"""Resume uploads: is the offered file the job's, what is still to transcribe, with what context, and
what the transcript is so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators.chunks import merge_chunks, plan_chunks
from cuelake.operators.joins import overlay_edits, pending_chunks, previous_context
from cuelake.sources.media import MAX_DURATION_SEC, resume_gate


def resume_requests(plan: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Pending chunks of the plan with the tail of the latest finished text before each."""
    return previous_context(pending_chunks(plan, checkpoints), checkpoints)


def finish_upload(checkpoints: DataFrame, edits: DataFrame, content_mode: str = "speech"):
    """(paragraphs, audit): merged text with manual edits on top, also from partial progress."""
    segments, audit = merge_chunks(checkpoints, content_mode)
    return overlay_edits(segments, edits), audit


def admitted(jobs: DataFrame, picked: DataFrame) -> DataFrame:
    """jobs with a problem column, null where the job may go on: no_file, resume_file_mismatch (with
    the reason in mismatch), media_decode_failed (no duration), duration_too_long."""
    gate = resume_gate(picked, jobs).withColumn("offered", F.lit(True))
    seconds = F.col("duration_sec")
    problem = (
        F.when(F.col("offered").isNull(), "no_file")
        .when(F.col("mismatch").isNotNull(), "resume_file_mismatch")
        .when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), "media_decode_failed")
        .when(seconds > MAX_DURATION_SEC, "duration_too_long")
    )
    return jobs.join(gate, "job_id", "left").withColumn("problem", problem).drop("offered")


def resume_uploads(
    jobs: DataFrame, picked: DataFrame, plan: DataFrame, silences: DataFrame, checkpoints: DataFrame, edits: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(status, requests, paragraphs, audit) of all uploads at once.

    jobs: job_id, media_id (unique), duration_sec, content_mode, and what resume_gate compares; picked
    files; plan (as of plan_chunks); checkpoints; edits. A job that may go on and has no plan yet gets
    one from the silences. requests: pending chunks of jobs that may go on. paragraphs: text merged from
    the checkpoints of every job, edits on top, also where a job may not go on. status: failed with the
    problem, transcribing, or completed, and how many chunks of the plan are done."""
    known = admitted(jobs, picked)
    able = known.where(F.col("problem").isNull()).select("media_id", "duration_sec")
    unplanned = able.join(plan.select("media_id").distinct(), "media_id", "left_anti")
    lengths = unplanned.select("media_id", (F.col("duration_sec") * 1000).cast("bigint").alias("duration_ms"))
    whole = plan.unionByName(plan_chunks(lengths, silences.join(lengths.select("media_id"), "media_id", "left_semi")).select(*plan.columns))
    requests = resume_requests(whole.join(able.select("media_id"), "media_id", "left_semi"), checkpoints)

    sung = jobs.where(F.col("content_mode") == "lyrics").select("media_id")
    parts = [
        finish_upload(checkpoints.join(sung, "media_id", how), edits, mode)
        for how, mode in (("left_semi", "lyrics"), ("left_anti", "speech"))
    ]
    (paragraphs, audit), (more, more_audit) = parts

    done = checkpoints.groupBy("media_id").agg(F.count(F.lit(1)).alias("completed"))
    total = whole.groupBy("media_id").agg(F.count(F.lit(1)).alias("total"))
    open_ones = requests.groupBy("media_id").agg(F.count(F.lit(1)).alias("open"))
    zero = F.lit(0).cast("bigint")
    status = known.join(done, "media_id", "left").join(total, "media_id", "left").join(open_ones, "media_id", "left").select(
        "job_id", "media_id",
        F.when(F.col("problem").isNotNull(), "failed").when(F.col("open") > 0, "transcribing").otherwise("completed").alias("status"),
        "problem", "mismatch", F.coalesce("completed", zero).alias("completed"), F.coalesce("total", zero).alias("total"),
    )
    return status, requests, paragraphs.unionByName(more), audit.unionByName(more_audit)
