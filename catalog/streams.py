"""Streams run to their end, and the upload jobs that go on from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import query
from catalog.chunking import _DONE_SQL, PLAN_SQL, chunk_plan, finished, halves, media, silences
from catalog.framing import DECIDED, DECISIONS_SQL, GRID, frames
from cuelake.plans.resume import resume_uploads
from cuelake.session import ensure_checkpoint_dir
from cuelake.streaming.detect import detect_stream, read_decisions
from cuelake.streaming.ingest import ingest_checkpoints, segment_table


def _folder(t, name):
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def run_to_end(writer):
    """All that has arrived, then stop."""
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


@query("st08_ingest_stream", """WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[\\n\\t]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, len(w) // 2 AS half FROM w WHERE len(w) > 1),
s AS (SELECT doc_id, 0 AS k, array_to_string(w[1:greatest(1, half)], ' ') AS text FROM h UNION ALL SELECT doc_id, 1, array_to_string(w[greatest(1, half - 11):n], ' ') FROM h),
x AS (SELECT doc_id, k, regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g') AS text FROM s)
SELECT doc_id AS media_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS seq, k * 300000.0::DOUBLE AS start_ms, 300000.0::DOUBLE AS dur_ms, text FROM x WHERE text <> ''""")
def _(t):
    """First halves arrive; a new run of the stream gets second halves and the first ones again."""
    chunks = halves(t).withColumn("completed_at", F.lit(1).cast("bigint"))
    landing, path, checkpoint = (_folder(t, n) for n in ("landing", "ingested", "progress"))
    early, late = chunks.where("idx = 0"), chunks.where("idx = 1")
    for arrived in (early, late.unionByName(early)):
        arrived.write.mode("append").parquet(landing)
        stream = t.spark.readStream.schema(chunks.schema).parquet(landing)
        run_to_end(ingest_checkpoints(stream, path, checkpoint, "lyrics", 16))
    return segment_table(t.spark, path, 16).read().select("media_id", "seq", "start_ms", "dur_ms", "text")


@query("st01_detect_stream", f"WITH RECURSIVE {DECISIONS_SQL} {DECIDED}")
def _(t):
    """Frames arrive in two runs of the stream; a recording is cut at a time of its own."""
    f = frames(t).select("media_id", "t_ms", "width", "height", "pixels")
    landing, path, checkpoint = (_folder(t, n) for n in ("landing", "detected", "progress"))
    cut = F.col("media_id") * 6_151 % 100_000
    for arrived in (f.where(F.col("t_ms") < cut), f.where(F.col("t_ms") >= cut)):
        arrived.write.mode("append").parquet(landing)
        run_to_end(detect_stream(t.spark.readStream.schema(f.schema).parquet(landing), path, checkpoint, GRID, buckets=16))
    return read_decisions(t.spark, path)


# -- uploads: one job per recording of the chunk plan; every fifth is offered another file --------


def resumed(t):
    m = media(t)
    seconds = F.when(F.col("media_id") % 7 == 3, None).otherwise(F.col("duration_ms") / 1000)
    jobs = m.select(
        F.concat(F.lit("job-"), "media_id").alias("job_id"), "media_id", F.concat(F.lit("print-"), "media_id").alias("fingerprint"),
        seconds.alias("duration_sec"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit("lyrics").alias("content_mode"))
    other = F.when(F.col("media_id") % 5 == 0, "other").otherwise(F.col("fingerprint"))
    picked = jobs.where(F.col("media_id") % 11 != 0).withColumn("fingerprint", other).drop("media_id", "content_mode")
    planned = F.col("media_id") % 2 == 0  # the others get their plan from the silences
    done = finished(t).where(planned)
    edits = done.where("idx = 0").select("media_id", F.col("core_start").alias("start_ms"), F.lit("edited").alias("text"), F.lit("A").alias("speaker"))
    return resume_uploads(jobs, picked, chunk_plan(t).where(planned), silences(t), done, edits)


RESUMED_SQL = PLAN_SQL + f""",
j AS (SELECT media_id, CASE WHEN media_id % 7 = 3 THEN NULL ELSE duration_ms / 1000 END AS sec,
  CASE WHEN media_id % 11 = 0 THEN 'no_file' WHEN media_id % 5 = 0 OR media_id % 7 = 3 THEN 'resume_file_mismatch'
    WHEN duration_ms <= 0 THEN 'media_decode_failed' WHEN duration_ms > 7200000 THEN 'duration_too_long' END AS problem,
  CASE WHEN media_id % 11 = 0 THEN NULL WHEN media_id % 5 = 0 THEN 'fingerprint' WHEN media_id % 7 = 3 THEN 'duration' END AS mismatch FROM med),
c AS (SELECT * FROM plan WHERE media_id % 2 = 0 AND {_DONE_SQL}),
known AS (SELECT plan.* FROM plan JOIN j USING (media_id) WHERE media_id % 2 = 0 OR problem IS NULL),
q AS (SELECT k.* FROM known k JOIN j USING (media_id) WHERE problem IS NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.media_id = k.media_id AND c.id = k.id))"""


@query("pipe06_resume_status", f"""WITH {RESUMED_SQL} SELECT concat('job-', media_id) AS job_id, media_id,
  CASE WHEN problem IS NOT NULL THEN 'failed' WHEN media_id IN (SELECT media_id FROM q) THEN 'transcribing' ELSE 'completed' END AS status, problem, mismatch,
  (SELECT count(*) FROM c WHERE c.media_id = j.media_id)::BIGINT AS completed, (SELECT count(*) FROM known WHERE known.media_id = j.media_id)::BIGINT AS total FROM j""")
def _(t):
    return resumed(t)[0]


@query("pipe06_resume_requests", f"""WITH {RESUMED_SQL} SELECT p.media_id, p.id, p.idx, coalesce('said in ' || c.id, '') AS context
FROM q p ASOF LEFT JOIN c ON p.media_id = c.media_id AND p.core_start + 50 >= c.core_end""")
def _(t):
    return resumed(t)[1].select("media_id", "id", "idx", "context")


@query("pipe06_resume_paragraphs", f"""WITH {RESUMED_SQL} SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1)::BIGINT AS seq, core_start AS start_ms,
  core_end - core_start AS dur_ms, CASE WHEN idx = 0 THEN 'edited' ELSE 'said in ' || id END AS text, CASE WHEN idx = 0 THEN 'A' END AS speaker FROM c""")
def _(t):
    return resumed(t)[2]
