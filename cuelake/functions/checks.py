"""Named row checks: a table is split into accepted rows and rejects with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed(checks: dict[str, Column]) -> Column:
    """Names of the checks that are not true, in the order given. Null counts as failed."""
    marks = [
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()
    ]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def with_reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    return df.withColumn("reasons", failed(checks))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") == 0).drop("reasons")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") > 0)


def finite_nonnegative(c: Column) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < F.lit(float("inf")))


def within(c: Column, low: float, high: float) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & d.between(low, high)


def whole(c: Column) -> Column:
    return c.cast("double") == F.floor(c.cast("double"))


def one_of(c: Column, values: list[str]) -> Column:
    return c.isNotNull() & c.isin(values)


def valid_corners(corners: Column) -> Column:
    """Four finite points inside the unit square, convex and clockwise (cross products > 0.0001)."""
    inside = F.forall(
        corners,
        lambda p: within(p["x"], 0, 1) & within(p["y"], 0, 1),
    )

    def cross(i: int) -> Column:
        p, q, r = (F.get(corners, F.lit(k % 4)) for k in (i, i + 1, i + 2))
        return (q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])

    turns = cross(0) > 0.0001
    for i in (1, 2, 3):
        turns = turns & (cross(i) > 0.0001)
    return F.coalesce((F.size(corners) == 4) & inside & turns, F.lit(False))
