"""Token cost arithmetic. Rates are US dollars per million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default rates and output limits of the two extraction profiles.
DEFAULT_RATES = [
    ("standard", 2.0, 10.0, 0.1, 2.5, 8192),
    ("economy", 0.1, 0.5, 0.01, 0.125, 8192),
]
BASE_INPUT_TOKENS = 1500


def default_pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DEFAULT_RATES,
        "profile STRING, input DOUBLE, output DOUBLE, cached_input DOUBLE, cache_write DOUBLE, "
        "max_output_tokens INT",
    )


def usage_cost(
    tokens_in: Column, tokens_out: Column, cached: Column, writes: Column,
    rate_in: Column, rate_out: Column, rate_cached: Column, rate_write: Column,
) -> Column:
    hit = F.least(tokens_in, cached)
    written = F.least(tokens_in - hit, writes)
    return (
        (tokens_in - hit - written) * rate_in + hit * rate_cached + written * rate_write
        + tokens_out * rate_out
    ) / F.lit(1_000_000)


def hypothetical_cost(
    calls: Column, tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column,
    allowance: Column,
) -> Column:
    return calls * (tokens_in * rate_in + tokens_out * rate_out) / F.lit(1_000_000) * (1 + allowance)


def operation_estimate(
    width: Column, height: Column, tokens_per_megapixel: Column, output_tokens: Column,
    max_output: Column, rate_in: Column, rate_out: Column, allowance: Column,
) -> Column:
    tokens_in = BASE_INPUT_TOKENS + F.ceil(width * height / F.lit(1_000_000) * tokens_per_megapixel)
    return hypothetical_cost(
        F.lit(1), tokens_in, F.least(output_tokens, max_output), rate_in, rate_out, allowance
    )
