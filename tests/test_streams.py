"""Ingestion as a stream equals one merge of all chunks, over restarts and repeated batches; uploads
resumed as one job."""

import os

from pyspark.sql import functions as F

from cuelake.operators.chunks import merge_chunks
from cuelake.plans.resume import resume_uploads
from cuelake.streaming.ingest import ingest_checkpoints, segment_table

CHUNK = "media_id BIGINT, id STRING, idx BIGINT, core_start DOUBLE, core_end DOUBLE, start DOUBLE, end DOUBLE, text STRING, completed_at BIGINT"
SAID = "the committee looked at the plan for the new harbour and asked for more time"


def chunk(media, k, text, at=1):
    return (media, f"c{k}", k, k * 300_000.0, (k + 1) * 300_000.0, max(0.0, k * 300_000.0 - 3000), (k + 1) * 300_000.0 + 3000, text, at)


def run(spark, folder, buckets=8):
    stream = spark.readStream.schema(CHUNK).parquet(f"{folder}/in")
    q = ingest_checkpoints(stream, f"{folder}/out", f"{folder}/cp", buckets=buckets).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def land(spark, folder, rows):
    spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def found(spark, folder):
    rows = segment_table(spark, f"{folder}/out", 8).read()
    return sorted(map(str, rows.select("media_id", "seq", "start_ms", "dur_ms", "text").collect()))


def merged(spark, rows):
    latest = {}
    for r in sorted(rows, key=lambda r: r[-1]):
        latest[r[0], r[1]] = r
    out = merge_chunks(spark.createDataFrame(list(latest.values()), CHUNK))[0]
    return sorted(map(str, out.select("media_id", "seq", "start_ms", "dur_ms", "text").collect()))


def test_stream_equals_one_merge(spark, tmp_path):
    folder = str(tmp_path)
    first = [chunk(m, 0, f"opening words {SAID}") for m in range(12)]
    second = [chunk(m, 1, f"{SAID}. what follows in {m}") for m in range(5)]
    corrected = [chunk(3, 0, f"better opening {SAID}", at=2)]
    land(spark, folder, first)
    run(spark, folder)
    assert found(spark, folder) == merged(spark, first)

    def files():
        return {os.path.join(d, p) for d, _, ps in os.walk(f"{folder}/out/segments") for p in ps if p.endswith(".parquet")}

    had = files()
    land(spark, folder, second[:1])
    run(spark, folder)
    # only the bucket of the touched recording was written again
    assert len({os.path.dirname(p) for p in had - files()}) == 1

    land(spark, folder, second[1:] + first)  # repeated rows beside new ones
    land(spark, folder, corrected)
    run(spark, folder)
    want = merged(spark, first + second + corrected)
    assert found(spark, folder) == want
    run(spark, folder)  # nothing new
    assert found(spark, folder) == want


def test_a_batch_repeated_after_a_failure(spark, tmp_path):
    folder = str(tmp_path)
    rows = [chunk(m, k, f"part {k} of {m}") for m in range(6) for k in range(2)]
    land(spark, folder, rows)
    run(spark, folder)
    want = found(spark, folder)
    # the batch ran but its commit was lost: the restarted stream runs it again
    commits = sorted(p for p in os.listdir(f"{folder}/cp/commits") if p.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):
        path = f"{folder}/cp/commits/{name}"
        if os.path.exists(path):
            os.remove(path)
    run(spark, folder)
    assert found(spark, folder) == want == merged(spark, rows)


def test_uploads_resume_as_one_job(spark):
    jobs = spark.createDataFrame(
        [("a", 1, "p1", 700.0, "speech"), ("b", 2, "p2", 700.0, "lyrics"), ("c", 3, "p3", None, "speech"), ("d", 4, "p4", 7300.0, "speech"), ("e", 5, "p5", 400.0, "speech"), ("f", 6, "p6", 10.0, "speech")],
        "job_id STRING, media_id BIGINT, fingerprint STRING, duration_sec DOUBLE, content_mode STRING",
    ).withColumns({"width": F.lit(1), "height": F.lit(1)})
    picked = jobs.where("job_id <> 'f'").drop("media_id", "content_mode").withColumn("fingerprint", F.when(F.col("job_id") == "e", "x").otherwise(F.col("fingerprint")))
    plan_rows = [(m, f"c{k}", k, k * 300_000.0, min(700_000.0, (k + 1) * 300_000.0), max(0.0, k * 300_000.0 - 3000), (k + 1) * 300_000.0 + 3000, 700_000) for m in (1, 2) for k in range(3)]
    plan = spark.createDataFrame(plan_rows, "media_id BIGINT, id STRING, idx BIGINT, core_start DOUBLE, core_end DOUBLE, start DOUBLE, end DOUBLE, duration_ms BIGINT")
    silences = spark.createDataFrame([], "media_id BIGINT, pos BIGINT, start_ms BIGINT, end_ms BIGINT")
    done = [chunk(1, 0, f"intro {SAID}"), chunk(1, 1, f"{SAID}. more"), *[chunk(2, k, SAID) for k in range(3)], chunk(5, 0, "kept")]
    edits = spark.createDataFrame([(2, 0.0, "sung", None)], "media_id BIGINT, start_ms DOUBLE, text STRING, speaker STRING")
    status, requests, paragraphs, audit = resume_uploads(jobs, picked, plan, silences, spark.createDataFrame(done, CHUNK), edits)
    got = {r.job_id: (r.status, r.problem or r.mismatch, r.completed, r.total) for r in status.collect()}
    assert got == {
        "a": ("transcribing", None, 2, 3), "b": ("completed", None, 3, 3), "c": ("failed", "resume_file_mismatch", 0, 0),
        "d": ("failed", "duration_too_long", 0, 0), "e": ("failed", "resume_file_mismatch", 1, 0), "f": ("failed", "no_file", 0, 0),
    }
    assert [(r.media_id, r.id) for r in requests.collect()] == [(1, "c2")]
    assert requests.first().context.endswith("more")
    text = {(r.media_id, r.seq): r.text for r in paragraphs.collect()}
    assert text[2, 0] == "sung" and text[2, 1] == text[2, 2] == SAID and text[5, 0] == "kept"
    assert text[1, 1] == "more" and audit.where("media_id = 1").first().removed > 0


def test_new_jobs_get_a_plan(spark):
    jobs = spark.createDataFrame([("a", 1, "p", 700.0, "speech", 1, 1)], "job_id STRING, media_id BIGINT, fingerprint STRING, duration_sec DOUBLE, content_mode STRING, width INT, height INT")
    none = lambda ddl: spark.createDataFrame([], ddl)
    plan = none("media_id BIGINT, id STRING, idx BIGINT, core_start DOUBLE, core_end DOUBLE, start DOUBLE, end DOUBLE, duration_ms BIGINT")
    status, requests, _, _ = resume_uploads(
        jobs, jobs.drop("media_id", "content_mode"), plan, none("media_id BIGINT, pos BIGINT, start_ms BIGINT, end_ms BIGINT"), none(CHUNK),
        none("media_id BIGINT, start_ms DOUBLE, text STRING, speaker STRING"))
    assert [(r.core_start, r.core_end) for r in requests.orderBy("idx").collect()] == [(0.0, 300_000.0), (300_000.0, 600_000.0), (600_000.0, 700_000.0)]
    assert [(r.status, r.completed, r.total) for r in status.collect()] == [("transcribing", 0, 3)]


def test_lyrics_are_numbered_like_compared_chunks(spark):
    """F16, F21: the scan that compares nothing gives what the comparing one gives for chunks that share nothing."""
    rows = [chunk(m, k, ["one", "  two\n", " ", None, "five"][(m + k) % 5]) for m in range(4) for k in range(5)]
    df = spark.createDataFrame(rows, CHUNK)
    got, want = merge_chunks(df, "lyrics"), merge_chunks(df.withColumns({"start": F.col("core_start"), "end": F.col("core_end")}), "speech")
    for a, b in zip(got, want):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    plan = got[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_a_bucket_is_written_without_a_copy_aside(spark, tmp_path):
    """F16: rows that stem from the folders they replace are swapped in; recordings of other batches stay."""
    folder = str(tmp_path / "f")
    spark.createDataFrame([chunk(m, 0, f"old {m}") for m in range(6)], CHUNK).write.parquet(f"{folder}/in")
    run(spark, folder, 2)
    staged = f"{spark.sparkContext.getCheckpointDir() or ''}"
    spark.createDataFrame([chunk(1, 0, "new 1", 2), chunk(1, 1, "more", 2), chunk(2, 0, "stale", 0)], CHUNK).write.mode("append").parquet(f"{folder}/in")
    run(spark, folder, 2)
    got = {(r.media_id, r.seq): r.text for r in segment_table(spark, f"{folder}/out", 2).read().collect()}
    assert got == {**{(m, 0): f"old {m}" for m in range(6)}, (1, 0): "new 1", (1, 1): "more"}
    assert not [d for path, dirs, _ in os.walk(staged or folder) for d in dirs if d.startswith("bucket_rows")]
