"""Checkpoint ingestion as a running stream.

Checkpoints and merged segments are two tables under one folder, cut into buckets by recording. A
micro-batch reads the buckets that its recordings fall into, puts its chunks in (the latest of a chunk
id wins), merges the recordings it touched again, and replaces these buckets and no others. All of it
depends on the tables and the batch alone, so a batch that is repeated after a failure or a restart
leaves the tables as they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, StructType

from cuelake import schemas
from cuelake.operators.chunks import merge_chunks

BUCKETS = 64


def bucket_of(media_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(media_id), F.lit(buckets)).cast("int")


def upsert_checkpoints(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Latest row per (media, chunk id); chunks of a busy recording are spread by their ids."""
    rows = batch if existing is None else existing.unionByName(batch)
    rest = F.struct(*[c for c in rows.columns if c not in ("media_id", "id")])
    return rows.groupBy("media_id", "id").agg(F.max_by(rest, "completed_at").alias("r")).select("media_id", "id", "r.*")


class BucketTable:
    """A Parquet table of rows with a media_id, partitioned by the recording's bucket."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, buckets: int) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.schema = StructType(list(schema.fields)).add("bucket", IntegerType())
        # an empty write makes the folder and leaves what is there alone
        spark.createDataFrame([], self.schema).write.mode("append").partitionBy("bucket").parquet(folder)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.folder)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def replace(self, rows: DataFrame) -> None:
        """Buckets that the rows fall into hold these rows from now on. The rows may stem from the folders
        they replace: a dynamic overwrite puts files aside and swaps folders when all are written."""
        # a bucket is one file, or several where it is large
        self._swap(rows.drop("bucket").withColumn("bucket", bucket_of(F.col("media_id"), self.buckets)).hint("rebalance", "bucket"))

    def upsert(self, batch: DataFrame, touched: list[int]) -> None:
        """Latest row per (media, chunk id) of the touched buckets and the batch. Rows meet by bucket and a
        part of it, as they are written, so that they are shuffled once."""
        rows = self.read(touched).unionByName(batch.withColumn("bucket", bucket_of(F.col("media_id"), self.buckets)))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64("id", "media_id"), F.lit(-(-tasks // self.buckets)))
        met = rows.withColumn("__part", part).repartition("bucket", "__part")
        rest = F.struct(*[c for c in rows.columns if c not in ("media_id", "id", "bucket")])
        last = met.groupBy("bucket", "__part", "media_id", "id").agg(F.max_by(rest, "completed_at").alias("r"))
        self._swap(last.select("media_id", "id", "r.*", "bucket"))

    def _swap(self, rows: DataFrame) -> None:
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        out.partitionBy("bucket").parquet(self.folder)


def segment_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketTable:
    return BucketTable(spark, f"{path}/segments", StructType.fromDDL(schemas.CUES), buckets)


def ingest_checkpoints(
    stream: DataFrame, path: str, checkpoint: str, content_mode: str = "speech", buckets: int = BUCKETS
) -> DataStreamWriter:
    """Finished chunks (as for merge_chunks, with completed_at) into ``path``/checkpoints as they
    arrive, and the merged segments of all recordings into ``path``/segments. Start the writer it returns."""
    spark = stream.sparkSession
    chunks = BucketTable(spark, f"{path}/checkpoints", stream.schema, buckets)
    segments = segment_table(spark, path, buckets)

    def step(batch: DataFrame, number: int) -> None:
        arrived = batch.withColumn("bucket", bucket_of(F.col("media_id"), buckets))
        # numbers of buckets: at most `buckets`
        touched = [r.bucket for r in arrived.select("bucket").distinct().collect()]
        if not touched:
            return
        chunks.upsert(batch, touched)
        known = chunks.read(touched).drop("bucket")
        media = batch.select("media_id").distinct()
        if known.select("media_id").distinct().join(media, "media_id", "left_anti").isEmpty():
            # the batch names every recording of these buckets: there is nothing to tell apart
            segments.replace(merge_chunks(known, content_mode)[0])
            return
        merged, _ = merge_chunks(known.join(media, "media_id", "left_semi"), content_mode)
        others = segments.read(touched).drop("bucket").join(media, "media_id", "left_anti")
        segments.replace(others.unionByName(merged.select(*others.columns)))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
