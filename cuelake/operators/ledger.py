"""The cost ledger of paid extraction: known cost, reserves, content-keyed reuse and budget cuts.

attempts: job_id, ord, op_key, crop_id, outcome, billing, cost_usd, reserved_usd, reused_from.
ops (planned operations): job_id, ord, op_key, estimate. ``ord`` is a dense ordinal in the job.
Money is summed as DECIMAL(18, 9), so partial sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.joins import attach_key_values
from cuelake.operators.ordered import Scan, busy_keys, ordered_scan, row_block

MONEY = "decimal(28,9)"
ASSET_LIMIT, IMAGE_LIMIT = 128_000_000, 32_000_000


def money(c: Column) -> Column:
    return F.coalesce(c.cast(MONEY), F.lit(0).cast(MONEY))


def _paid() -> Column:
    return F.col("reused_from").isNull()


def _open_reserve() -> Column:
    waits = (F.coalesce(F.col("billing"), F.lit("none")) == "unknown") | (F.col("outcome") == "completed")
    return _paid() & waits & F.col("cost_usd").isNull()


def ledger_totals(attempts: DataFrame) -> DataFrame:
    """Per job: known cost, reserve held for unknown bills, unknown bills, paid requests."""
    return attempts.groupBy("job_id").agg(
        F.sum(F.when(_paid(), money(F.col("cost_usd"))).otherwise(F.lit(0).cast(MONEY))).alias("known"),
        F.sum(F.when(_open_reserve(), money(F.col("reserved_usd"))).otherwise(F.lit(0).cast(MONEY))).alias("reserve"),
        F.count_if(F.coalesce(F.col("billing") == "unknown", F.lit(False))).alias("unknown_billing"),
        F.count_if(_paid()).alias("requests"),
    )


def current_attempts(log: DataFrame) -> DataFrame:
    """Append-only log to one row per attempt: the latest entry is the truth."""
    rest = F.struct(*[c for c in log.columns if c != "attempt_id"])
    return log.groupBy("attempt_id").agg(F.max_by(rest, "log_ord").alias("r")).select("attempt_id", "r.*")


def reusable(attempts: DataFrame) -> DataFrame:
    """Content key to the latest completed attempt, per job."""
    return attempts.where((F.col("outcome") == "completed") & F.col("has_extraction")).groupBy("job_id", "op_key").agg(
        F.max_by("attempt_id", "ord").alias("reuse_of")
    )


def first_payers(ops: DataFrame) -> DataFrame:
    """Flag the first operation of each content key in a job; later ones reuse its result."""
    out = ordered_scan(ops, ["job_id", "op_key"], ["ord"], "ord", [Scan("__n", "position")])
    return out.withColumn("pays", F.col("__n") == 0).drop("__n")


def _stacked(*sides: DataFrame) -> DataFrame:
    """Rows of several tables in one, with the number of their table; columns a table lacks are null."""
    out = sides[0].withColumn("side", F.lit(0))
    for number, rows in enumerate(sides[1:], 1):
        out = out.unionByName(rows.withColumn("side", F.lit(number)), allowMissingColumns=True)
    return out


def _busy_jobs(ops: DataFrame, attempts: DataFrame) -> DataFrame:
    return busy_keys(ops.select("job_id", "ord").unionByName(attempts.select("job_id", "ord")), "job_id", "ord")


def keyed_operations(ops: DataFrame, attempts: DataFrame) -> DataFrame:
    """Operations with ``pays`` (the first of its content key, of which no attempt has a result) and
    ``unsettled`` (an attempt of the key waits for its bill). Both sides are read in one scan."""
    has = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    told = attempts.select(
        "job_id", "op_key", "ord", has((F.col("outcome") == "completed") & F.col("has_extraction")).alias("done"),
        has(F.col("billing") == "unknown").alias("open"),
    ).where((F.col("done") > 0) | (F.col("open") > 0))
    rows = ordered_scan(
        _stacked(ops, told), ["job_id", "op_key"], ["ord", "side"], "ord",
        [
            Scan("nth", "sum", has(F.col("side") == 0)), Scan("results", "total", F.col("done")),
            Scan("waits", "total", F.col("open")),
        ],
        busy=_busy_jobs(ops, attempts),
    ).where("side = 0")
    return rows.select(
        *ops.columns, ((F.col("nth") == 1) & (F.col("results") == 0)).alias("pays"), (F.col("waits") > 0).alias("unsettled")
    )


def pending_estimate(ops: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per job: the estimates of the operations that pay."""
    paying = keyed_operations(ops, attempts).where("pays")
    return paying.groupBy("job_id").agg(F.sum(money(F.col("estimate"))).alias("pending"))


def plan_extraction(
    ops: DataFrame, attempts: DataFrame, budgets: DataFrame, approved: DataFrame | None = None
) -> DataFrame:
    """Decision per operation: reuse, pay, needs_approval, unknown_billing or paused.

    budgets(job_id, budget_usd, max_requests), one row per job. A job whose whole remaining plan exceeds
    the budget pays nothing. Work stops at the first operation that may not run; later ones are
    paused, never skipped over. Operations, approvals and the job's state are stacked, so that one scan
    brings them together."""
    busy = _busy_jobs(ops, attempts)
    cost = F.when(F.col("pays"), money(F.col("estimate"))).otherwise(F.lit(0).cast(MONEY))
    rows = keyed_operations(ops, attempts).select("job_id", "ord", "op_key", "pays", "unsettled", cost.alias("cost"))
    state = budgets.join(ledger_totals(attempts), "job_id", "left").select(
        "job_id", F.lit(0).cast("bigint").alias("ord"),
        F.struct(
            F.col("budget_usd").cast(MONEY).alias("budget"), "max_requests",
            *[money(F.col(c)).alias(c) for c in ("known", "reserve")], F.coalesce("requests", F.lit(0)).alias("requests"),
        ).alias("state"),
    )
    told = [] if approved is None else [approved.select("job_id", "ord")]
    cost = F.col("cost")
    run = ordered_scan(
        _stacked(state, *told, rows), ["job_id"], ["ord", "side"], "ord",
        [
            Scan("held", "last", F.col("state")), Scan("ok_ord", "last", F.when((F.col("side") == 1) & F.lit(bool(told)), F.col("ord"))),
            Scan("spent", "sum", cost), Scan("pending", "total", cost),
            Scan("sent", "sum", F.when(F.col("pays"), 1).otherwise(0).cast("bigint")),
        ],
        busy=busy,
    ).where(F.col("side") == len(told) + 1)
    ok = F.lit(True) if approved is None else F.coalesce(F.col("ok_ord") == F.col("ord"), F.lit(False))
    owed, budget = F.col("held.known") + F.col("held.reserve"), F.col("held.budget")
    stop = (
        F.when(owed + F.col("pending") > budget, "over_budget_plan").when(~ok, "needs_approval")
        .when(F.col("pays") & F.col("unsettled"), "unknown_billing")
        .when(F.col("pays") & (owed + F.col("spent") > budget), "over_budget")
        .when(F.col("pays") & (F.col("held.requests") + F.col("sent") > F.col("held.max_requests")), "request_limit")
    )
    marked = run.select("job_id", "ord", "op_key", "pays", stop.alias("stop"))
    out = ordered_scan(
        marked, ["job_id"], ["ord"], "ord", [Scan("stops", "sum", F.when(F.col("stop").isNotNull(), 1).otherwise(0).cast("bigint"))],
        busy=busy,
    )
    before = F.col("stops") == 0
    return out.select(
        "job_id", "ord", "op_key",
        F.when(before & F.col("pays"), "pay").when(before, "reuse")
        .when((F.col("stops") == 1) & F.col("stop").isNotNull(), F.col("stop")).otherwise("paused").alias("decision"),
    )


def budget_prefix(ops: DataFrame, budgets: DataFrame) -> DataFrame:
    """Operations in order until the first that would exceed the budget."""
    rows = attach_key_values(ops, ["job_id"], row_block("ord"), budgets.select("job_id", "budget_usd"))
    run = ordered_scan(rows, ["job_id"], ["ord"], "ord", [Scan("spent", "sum", money(F.col("estimate")))])
    return run.where(F.col("spent") <= F.col("budget_usd").cast(MONEY)).drop("budget_usd")


def retry_audit(attempts: DataFrame, allowance: int = 1) -> DataFrame:
    """Attempts of a crop and key beyond the retry allowance, or retried after a billed failure."""
    seen = ordered_scan(
        attempts.where(_paid()), ["job_id", "crop_id", "op_key"], ["ord"], "ord",
        [Scan("n", "position"), Scan("prev", "lag", F.struct("retryable", "billing"))],
    )
    fair = F.col("prev.retryable") & (F.col("prev.billing") == "none")
    return seen.select(
        "job_id", "crop_id", "op_key", "ord", (F.col("n") + 1).cast("bigint").alias("try"),
        ((F.col("n") == 0) | (F.coalesce(fair, F.lit(False)) & (F.col("n") <= allowance))).alias("allowed"),
    )


def completion_status(states: DataFrame, scans: DataFrame) -> DataFrame:
    done = states.groupBy("media_id").agg(F.bool_and(F.col("status").isin("completed", "excluded")).alias("done"))
    ready = F.col("scan_complete") & F.coalesce("done", F.lit(True))
    return scans.join(done, "media_id", "left").select("media_id", F.when(ready, "completed").otherwise("review").alias("status"))


def asset_admission(assets: DataFrame) -> DataFrame:
    """assets(store_id, ord, size_bytes): which images fit the store when admitted in order."""
    fits = F.col("size_bytes").between(1, IMAGE_LIMIT)
    seen = ordered_scan(
        assets, ["store_id"], ["ord"], row_block("ord"),
        [Scan("total", "sum", F.when(fits, F.col("size_bytes")).otherwise(0).cast("bigint"))],
    )
    return seen.select(
        "store_id", "ord", "total",
        F.when(~fits, "bad_size").when(F.col("total") > ASSET_LIMIT, "storage_quota").otherwise("ok").alias("admission"),
    )


def operation_key(crop: list[str], region: list[str], profile: list[str], versions: tuple[str, str]) -> Column:
    """Content key: equal when image, rectangle, region, model settings and versions are equal."""
    return F.sha2(
        F.to_json(F.struct(*crop, *region, *profile, F.lit(versions[0]).alias("v1"), F.lit(versions[1]).alias("v2"))), 256
    )
