"""Frame detection as a stream: each trigger goes on from where the recording's scan stopped.

What a scan leaves open is a row of a table under the job's folder, cut into buckets by recording. A
micro-batch is folded like a batch job, so a busy recording is split into blocks and no task holds the
frames of a recording; its decisions are written under the number of the batch. A state row keeps the
state before its last batch as well: a batch that is repeated after a failure starts from there and
writes the same decisions. States of recordings that have been idle for `ttl_ms` are dropped when
their bucket is written next; later frames of such a recording start a scan of their own.

A frame that is not later than the last one of an earlier batch cannot be decided any more, because the
machine cannot go back: it is returned with the kind "late" instead of being lost. Of frames of equal
time in one batch one is decided and the others are late."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from cuelake.operators.frames import FRAME_ROWS, Grid, feature_of, scan_on
from cuelake.session import stage_table
from cuelake.streaming.ingest import BUCKETS, BucketTable, bucket_of

DECISIONS = "media_id BIGINT, t_ms DOUBLE, kind STRING, since DOUBLE, motion BOOLEAN"
STATES = "media_id BIGINT, cursor_ms DOUBLE, state STRING, was_cursor_ms DOUBLE, was_state STRING, batch BIGINT, updated_ms BIGINT"


def state_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketTable:
    return BucketTable(spark, f"{path}/states", StructType.fromDDL(STATES), buckets)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{DECISIONS}, batch BIGINT").parquet(f"{path}/decisions").drop("batch")


def detect_stream(
    frames: DataFrame, path: str, checkpoint: str, grid: Grid = Grid(), feature: Callable = feature_of, frame_rows: int = FRAME_ROWS,
    ttl_ms: int | None = None, buckets: int = BUCKETS, now_ms: Callable[[], int] = lambda: int(time.time() * 1000),
) -> DataStreamWriter:
    """Streaming frames(media_id, t_ms, width, height, pixels) to ``path``/decisions and ``path``/states.
    Start the writer it returns."""
    states = state_table(frames.sparkSession, path, buckets)

    def step(batch: DataFrame, number: int) -> None:
        rows = stage_table(batch, "arrived_frames")
        # numbers of buckets: at most `buckets`
        touched = [r.bucket for r in rows.select(bucket_of(F.col("media_id"), buckets).alias("bucket")).distinct().collect()]
        if not touched:
            return
        held = stage_table(states.read(touched).drop("bucket"), "held_states")
        again = F.col("batch") >= number  # this batch has been here before
        start = held.select(
            "media_id", F.when(again, F.col("was_cursor_ms")).otherwise(F.col("cursor_ms")).alias("cursor_ms"),
            F.when(again, F.col("was_state")).otherwise(F.col("state")).alias("state"), "updated_ms",
        ).where("state is not null")
        now = now_ms()
        if ttl_ms is not None:
            start = start.where(F.col("updated_ms") >= now - ttl_ms)
        start = stage_table(start, "start_states")

        copies = rows.groupBy("media_id", "t_ms").agg(F.count("*").alias("n"))
        known = copies.join(start.select("media_id", "cursor_ms"), "media_id", "left")
        old = F.coalesce(F.col("t_ms") <= F.col("cursor_ms"), F.lit(False))
        spare = known.select("media_id", "t_ms", F.when(old, F.col("n")).otherwise(F.col("n") - 1).alias("n")).where("n > 0")
        late = spare.select(
            "media_id", F.col("t_ms").cast("double").alias("t_ms"), F.lit("late").alias("kind"), F.lit(None).cast("double").alias("since"),
            F.lit(False).alias("motion"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"),
        ).drop("k")

        found, ends = scan_on(rows.dropDuplicates(["media_id", "t_ms"]), start.drop("updated_ms"), grid, feature, frame_rows)
        every = found.unionByName(late)
        every.write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")

        arrived = rows.select("media_id").distinct()
        before = start.select("media_id", F.col("cursor_ms").alias("was_cursor_ms"), F.col("state").alias("was_state"))
        moved = ends.join(arrived, "media_id", "left_semi").join(before, "media_id", "left").select(
            "media_id", "cursor_ms", "state", "was_cursor_ms", "was_state",
            F.lit(number).cast("bigint").alias("batch"), F.lit(now).cast("bigint").alias("updated_ms"),
        )
        idle = held.join(arrived, "media_id", "left_anti")
        if ttl_ms is not None:
            idle = idle.where(F.col("updated_ms") >= now - ttl_ms)
        states.replace(moved.unionByName(idle.select(*moved.columns)))

    return frames.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
