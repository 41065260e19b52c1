"""Array helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posexplode_rows(
    df: DataFrame, keep: Sequence[str], array: Column, pos: str, item: str
) -> DataFrame:
    """One row per array item. The outer form with a later filter keeps the optimizer from
    evaluating a costly array expression again in an inferred filter below the generator."""
    out = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return out.where(F.col(pos).isNotNull())


def overlay_map(base: Column, over: Column) -> Column:
    """Both maps in one; where both have a key, the value of the second."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
