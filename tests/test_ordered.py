"""Block-wise scans equal plain windows, whatever the block size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.operators import ordered
from cuelake.operators.joins import asof_join, nearest_silence
from cuelake.operators.ordered import Scan, ordered_scan, row_block


@pytest.mark.parametrize("rows", [3, 1000])
def test_scans(spark, rows):
    df = spark.range(0, 211).select(
        F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("seq"),
        F.when(F.col("id") % 5 == 2, F.col("id") * 7 % 31).alias("v"),
    )
    v = F.col("v")
    got = ordered_scan(
        df, ["k"], ["seq"], row_block("seq", rows),
        [Scan(n, n, None if n == "position" else v) for n in
         ("position", "sum", "sum_before", "last", "last_before", "lag", "max", "max_before", "next", "lead")],
    )
    w = Window.partitionBy("k").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "k", "seq", "v", (F.row_number().over(w) - 1).alias("position"), F.coalesce(F.sum(v).over(upto), F.lit(0)).alias("sum"),
        F.coalesce(F.sum(v).over(before), F.lit(0)).alias("sum_before"), F.last(v, True).over(upto).alias("last"),
        F.last(v, True).over(before).alias("last_before"), F.lag(v).over(w).alias("lag"), F.max(v).over(upto).alias("max"),
        F.max(v).over(before).alias("max_before"), F.first(v, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next"),
        F.lead(v).over(w).alias("lead"),
    )
    cols = want.columns
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.collect()))


def test_asof_over_many_blocks(spark):
    left = spark.range(0, 60).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.col("id") * 100).alias("t"))
    right = spark.createDataFrame([(1, 0, 450), (1, 1, 450), (1, 2, 4000)], "k INT, pos INT, at INT")
    rows = asof_join(left, right, ["k"], F.col("t"), F.col("at"), ["pos"], "both", "r", 300).collect()
    for r in rows:
        want = None if r.t < 450 else 1 if r.t < 4000 else 2
        assert (r.r.pos if r.r else None) == want
        assert (r.r_next.pos if r.r_next else None) == (0 if r.t < 450 else 2 if r.t < 4000 else None)


def test_nearest_silence_ties_by_input_order(spark):
    silences = spark.createDataFrame(
        [(1, 0, 309_000, 311_000), (1, 1, 289_000, 291_000), (2, 0, 297_800, 298_100), (2, 1, 270_000, 272_000)],
        "media_id BIGINT, pos BIGINT, start_ms BIGINT, end_ms BIGINT")
    targets = spark.createDataFrame([(1, 300_000, 620_000), (2, 300_000, 620_000)], "media_id BIGINT, target_ms BIGINT, duration_ms BIGINT")
    got = {r.media_id: r.cut_ms for r in nearest_silence(targets, silences).collect()}
    assert got == {1: 310_000.0, 2: 300_000.0}


SCANS = ("position", "sum", "sum_before", "total", "last", "last_before", "lag", "max", "max_before", "next", "lead")


@pytest.mark.parametrize("mode", ["named", "told", "few_busy"])
@pytest.mark.parametrize("rows", [7, 1000])
def test_scans_with_carries_of_busy_keys_only(spark, monkeypatch, rows, mode):
    """the same values whether few, many or no keys go beyond a block."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", rows)
    df = spark.range(0, 120).select(
        F.when(F.col("id") < 60, 0).otherwise(1 + F.col("id") % 12).alias("k"), F.col("id").alias("at"),
        F.when(F.col("id") % 5 == 2, F.col("id") * 7 % 31).alias("v"),
    )
    w = Window.partitionBy("k").orderBy("at")
    df = df.withColumn("seq", F.row_number().over(w).cast("bigint") - 1)
    v = F.col("v")
    block = F.floor(F.col("at") / 5) if mode == "few_busy" else "seq"
    got = ordered_scan(
        df, ["k"], ["seq"], block, [Scan(n, n, None if n == "position" else v) for n in SCANS], few_busy=mode == "few_busy",
        busy=ordered.busy_keys(df, "k", "seq") if mode == "told" else None,
    )
    want = ordered_scan(df, ["k"], ["seq"], row_block("seq", 3), [Scan(n, n, None if n == "position" else v) for n in SCANS])
    whole = Window.partitionBy("k")
    for r in want.withColumn("all", F.coalesce(F.sum(v).over(whole), F.lit(0))).collect():
        assert r["total"] == r["all"]
    cols = want.columns
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.collect()))


def test_numbering_of_small_keys_shuffles_rows_once(spark):
    """a key whose order column is wide spread got a summary row per row."""
    df = spark.range(0, 1000, 1, 2).select((F.col("id") % 250).alias("k"), (F.col("id") * 7919).alias("at"), F.lit("x").alias("t"))
    out = ordered.numbered(df, ["k"], ["at"], F.floor(F.col("at") / 1000).cast("bigint"), "n", few_busy=True)
    assert out.where("n > 3").isEmpty() and out.count() == 1000
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and plan.count("Window") == 1
