from collections import Counter

import pytest

from cuelake.llm import sharding as s
from tests.llm.helpers import odd_documents


def turns(shards, size):
    """Every shard's whole order of preference, claimed turn by turn."""
    orders = []
    for name in shards:
        offset, skip = s._digest(f"{name}/offset") % size, s._digest(f"{name}/skip") % (size - 1) + 1
        orders.append([(offset + k * skip) % size for k in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    held, k = {}, 0
    while len(held) < size:
        slot = next(x for x in orders[k % len(shards)] if x not in held)
        held[slot] = k % len(shards)
        k += 1
    return [held[x] for x in range(size)]


def test_table_equals_brute_force():
    for shards, size in ((["a"], 7), (["a", "b", "c"], 31), ([f"n{k}" for k in range(9)], 101)):
        assert s.fill_table(shards, size) == turns(shards, size)


def test_balance_weights_and_change():
    names = [f"n{k}" for k in range(20)]
    table = s.fill_table(names, 2003)
    count = Counter(table)
    assert max(count.values()) - min(count.values()) <= 1
    fewer = s.fill_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.25 * 2003
    heavy = Counter(s.fill_table(names, 2003, {"n3": 3}))
    assert 2.5 < heavy[3] / heavy[0] < 3.5
    for bad in ((names, 2000), (names, 19), (["a", "a"], 7), ([], 7)):
        with pytest.raises(ValueError):
            s.fill_table(*bad)


def test_placement(spark, tmp_path):
    docs = odd_documents(spark)
    placed = s.assign_shards(docs, "doc_id", ["a", "b", "c"], 31)
    rows = placed.collect()
    table = s.fill_table(["a", "b", "c"], 31)
    assert len(rows) == docs.count() and all(table[r.slot] == r.shard for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert s.assign_shards(docs.limit(0), "doc_id", ["a"], 7).collect() == []
    again = s.assign_shards(placed, "doc_id", ["a", "b", "c"], 31)
    assert again.columns == placed.columns and sorted(map(str, again.collect())) == sorted(map(str, rows))
    named = s.assign_shards(placed, "doc_id", ["a"], 7, slot="s", shard="p")
    assert named.columns == [*placed.columns, "s", "p"] and {r.p for r in named.collect()} == {0}
    s.write_shards(placed, str(tmp_path / "out"), rows_per_file=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
