"""The ledger's scans give the same results whatever the block size."""

import pytest

from catalog import evidence as E
from catalog.base import Tables
from cuelake.operators import ledger as L
from cuelake.operators import ordered

SF = "/root/testdata/sf0.001"


def _decided(spark):
    t = Tables(spark, SF)
    a, ops = E.attempts(t), E.operations(t)
    ok = a.where("q <= 45").select("job_id", "ord")
    out = [L.plan_extraction(ops, a, E.budgets(t), ok), L.plan_extraction(ops, a, E.budgets(t)), L.pending_estimate(ops, a), L.first_payers(a), L.retry_audit(a)]
    return [sorted(map(str, df.collect())) for df in out]


@pytest.mark.parametrize("rows", [1, 2])
def test_jobs_beyond_a_block(spark, monkeypatch, rows):
    """what a job's later blocks hold counts in its first one, and the other way round."""
    whole = _decided(spark)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", rows)
    assert _decided(spark) == whole


def test_a_later_block_holds_the_result(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 2)
    ops = spark.createDataFrame([(1, i, i % 2, 1.0) for i in range(6)], "job_id BIGINT, ord BIGINT, op_key BIGINT, estimate DOUBLE")
    told = spark.createDataFrame(
        [(1, 9, 1, "completed", "known", 0.5, 1.0, None, True)],
        "job_id BIGINT, ord BIGINT, op_key BIGINT, outcome STRING, billing STRING, cost_usd DOUBLE, reserved_usd DOUBLE, reused_from STRING, has_extraction BOOLEAN")
    budgets = spark.createDataFrame([(1, 9.0, 4)], "job_id BIGINT, budget_usd DOUBLE, max_requests INT")
    assert [(r.ord, r.decision) for r in L.plan_extraction(ops, told, budgets).orderBy("ord").collect()] == [(0, "pay"), *[(i, "reuse") for i in range(1, 6)]]
    assert [r.pending for r in L.pending_estimate(ops, told).collect()] == [1]
