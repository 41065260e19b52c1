"""Ordered scans that do not put a whole key into one task.

A plain window over ``partitionBy(key)`` sends every row of a key to one task. Here a
key is cut into blocks by a monotone function of its order columns: windows run inside
``(key, block)``, one summary row per block is scanned over the key, and the carried
value is joined back. Summaries are pre-aggregated on the map side, the wide side is
shuffled once, and the join reuses its ``(key, block)`` partitioning.

Only keys of several blocks have anything to carry. Where these are known to be few (keys of more
than BLOCK_ROWS rows are at most one in BLOCK_ROWS), their names are broadcast and no other
key gets summary rows: such a scan costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key handled by one window group when the order column is a dense ordinal.
BLOCK_ROWS = 65_536
# Width of a block when the order column is a time in milliseconds.
BLOCK_MS = 600_000

FORWARD = {"position", "sum", "sum_before", "total", "last", "last_before", "lag", "max", "max_before"}
BACKWARD = {"next", "lead"}


@dataclass(frozen=True)
class Scan:
    """One output column of an ordered scan.

    kind: position (0-based), sum, sum_before, total (of the whole key), last (non-null at or before),
    last_before, lag, max, max_before, next (non-null at or after), lead.
    """

    name: str
    kind: str
    value: Column | None = None


def row_block(column: str = "seq", rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(column) / F.lit(rows)).cast("bigint")


def time_block(column: str = "start_ms", width_ms: int = BLOCK_MS) -> Column:
    return F.floor(F.col(column) / F.lit(width_ms)).cast("bigint")


def busy_keys(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Values of ``key`` whose rows, numbered from zero, go beyond a block."""
    return df.where(F.col(ordinal) >= BLOCK_ROWS).select(key).distinct()


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | str,
    scans: Sequence[Scan],
    spread: bool = False,
    few_busy: bool = False,
    busy: DataFrame | None = None,
) -> DataFrame:
    """Add the scan columns to ``df``. Keys must not be null; order must be unique in a key.

    ``block`` may name a column that numbers the rows of the first key from zero: a block is BLOCK_ROWS
    numbers then. ``busy`` holds the values of that key with numbers of a later block, where they are
    told from an input with less work than from ``df``; it is read at once, and if it is empty nothing is
    carried. With ``few_busy`` the rows of a key are counted first, and only a key of more than
    BLOCK_ROWS rows is cut into its blocks.

    ``spread`` fixes the number of tasks after the shuffle, for callers whose next step is heavy
    per byte and would suffer from small partitions being merged."""
    for scan in scans:
        if scan.kind not in FORWARD | BACKWARD:
            raise ValueError(f"unknown scan kind {scan.kind}")
    keys = list(keys)
    order = list(order)
    values: dict[str, str] = {}
    for s in scans:  # a value that several scans share is shuffled once
        if s.value is not None:
            values[s.name] = next((values[o.name] for o in scans if o.value is s.value and o.name in values), f"__v_{s.name}")
    alone = busy is not None and busy.isEmpty()
    given = {values[s.name]: s.value for s in scans if s.value is not None}
    if isinstance(block, str):
        base = df.withColumns({"__blk": row_block(block, BLOCK_ROWS)} | given)
        later_rows = busy_keys(df, keys[0], block) if busy is None else busy
        several = base.join(F.broadcast(later_rows), keys[0], "left_semi")
    elif few_busy:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        known = F.broadcast(counts.where(F.col("__n") > BLOCK_ROWS).select(*keys, F.lit(True).alias("__busy")))
        base = df.join(known, keys, "left").withColumns({"__blk": F.when(F.col("__busy"), block).otherwise(0)} | given)
        several = base.where("__busy")
    else:
        base = several = df.withColumns({"__blk": block} | given)
    ordinal = F.struct(*[F.col(c) for c in order])
    inside = Window.partitionBy(*keys, "__blk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    after = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    local: dict[str, Column] = {}
    summary: list[Column] = []
    carried: dict[str, Column] = {}
    merged: dict[str, Column] = {}
    earlier = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    step = Window.partitionBy(*keys).orderBy("__blk")
    later = Window.partitionBy(*keys).orderBy(F.col("__blk").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    for s in scans:
        v = F.col(values[s.name]) if s.name in values else None
        here, agg, carry = f"__h_{s.name}", f"__a_{s.name}", f"__c_{s.name}"
        h, a, c = F.col(here), F.col(agg), F.lit(None) if alone else F.col(carry)
        if s.kind == "position":
            local[here] = F.row_number().over(inside).cast("bigint") - 1
            summary.append(F.count(F.lit(1)).alias(agg))
            carried[carry] = F.sum(a).over(earlier)
            merged[s.name] = h + F.coalesce(c, F.lit(0))
        elif s.kind in ("sum", "sum_before"):
            local[here] = F.sum(v).over(upto if s.kind == "sum" else before)
            summary.append(F.sum(v).alias(agg))
            carried[carry] = F.sum(a).over(earlier)
            merged[s.name] = F.coalesce(h, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif s.kind == "total":
            local[here] = F.sum(v).over(Window.partitionBy(*keys, "__blk"))
            summary.append(F.sum(v).alias(agg))
            carried[carry] = F.sum(a).over(Window.partitionBy(*keys))
            merged[s.name] = F.coalesce(c, h, F.lit(0))
        elif s.kind in ("max", "max_before"):
            local[here] = F.max(v).over(upto if s.kind == "max" else before)
            summary.append(F.max(v).alias(agg))
            carried[carry] = F.max(a).over(earlier)
            merged[s.name] = F.greatest(h, c)
        elif s.kind in ("last", "last_before"):
            local[here] = F.last(v, ignorenulls=True).over(upto if s.kind == "last" else before)
            summary.append(F.max_by(v, F.when(v.isNotNull(), ordinal)).alias(agg))
            carried[carry] = F.last(a, ignorenulls=True).over(earlier)
            merged[s.name] = F.coalesce(h, c)
        elif s.kind == "next":
            local[here] = F.first(v, ignorenulls=True).over(after)
            summary.append(F.min_by(v, F.when(v.isNotNull(), ordinal)).alias(agg))
            carried[carry] = F.last(a, ignorenulls=True).over(later)
            merged[s.name] = F.coalesce(h, c)
        elif s.kind == "lag":
            local[here] = F.lag(F.struct(v.alias("v"))).over(inside)
            summary.append(F.max_by(F.struct(v.alias("v")), ordinal).alias(agg))
            carried[carry] = F.lag(a).over(step)
            merged[s.name] = F.coalesce(h, c)["v"]
        else:  # lead
            local[here] = F.lead(F.struct(v.alias("v"))).over(inside)
            summary.append(F.min_by(F.struct(v.alias("v")), ordinal).alias(agg))
            carried[carry] = F.lead(a).over(step)
            merged[s.name] = F.coalesce(h, c)["v"]

    if spread:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        wide = base.repartition(tasks, *keys, "__blk").withColumns(local)
    else:
        wide = base.withColumns(local)
    if alone:
        return wide.select(*[F.col(c) for c in df.columns], *[c.alias(n) for n, c in merged.items()])
    blocks = several.groupBy(*keys, "__blk").agg(*summary)
    carry_rows = blocks.select(*keys, "__blk", *[col.alias(n) for n, col in carried.items()])
    joined = wide.join(carry_rows, [*keys, "__blk"], "left")
    return joined.select(*[F.col(c) for c in df.columns], *[c.alias(n) for n, c in merged.items()])


def fill_forward_then_back(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, column: str, name: str
) -> DataFrame:
    """Forward fill, then the leading gap takes the first value that follows."""
    v = F.col(column)
    out = ordered_scan(
        df, keys, order, block, [Scan("__fwd", "last", v), Scan("__bwd", "next", v)]
    )
    return out.withColumn(name, F.coalesce("__fwd", "__bwd")).drop("__fwd", "__bwd")


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | str, name: str = "seq",
    few_busy: bool = False,
) -> DataFrame:
    """Dense 0-based ordinal inside a key."""
    return ordered_scan(df, keys, order, block, [Scan(name, "position")], few_busy=few_busy)
