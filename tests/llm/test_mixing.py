import random
import re

from cuelake.llm import mixing as m
from tests.llm.helpers import documents, odd_documents, prose, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, share, most):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(docs, got, weights=(5.0, 2.0, 1.0)):
    texts = {}
    sizes: dict = {}
    for r in docs.collect():
        n = len(WORD.findall(r.text or ""))
        texts.setdefault(r.doc_id, []).append(n)
        sizes[r.source] = sizes.get(r.source, 0) + n
    target = water(sizes, weights, 1.5, 2.0)
    taken: dict = {}
    biggest: dict = {}
    for r in got:
        assert r.size in texts[r.doc_id] and r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        biggest[r.source] = max(biggest.get(r.source, 0), r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= biggest[s] + 1e-6, s


def test_targets_and_taken(spark):
    rng = random.Random(7)
    for trial in range(3):
        rows = [(k, prose(rng, rng.randint(1, 200)), "en", rng.choice(["a", "b", "c", "é", "Z", None, "b"])) for k in range(400)]
        rows += [(1000 + k, prose(rng, 20), "en", "hot") for k in range(300 * trial)]
        docs = documents(spark, rows)
        got = m.mix(docs.repartition(5)).collect()
        assert len(got) == len(rows)
        check(docs, got)
        again = m.mix(docs.coalesce(1)).collect()
        assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = m.mix(with_clashes(docs)).collect()
    assert len(got) == docs.count()
    assert {r.taken for r in got if r.size == 0} == {0}
    assert m.mix(docs.limit(0)).collect() == []
    assert m.mix(documents(spark, [(1, None, "en", "a"), (2, "", "en", None)])).where("taken <> 0 or target <> 0").collect() == []


def test_repeats_follow_the_mix(spark):
    rng = random.Random(9)
    docs = with_clashes(documents(spark, [(k, prose(rng, 30), "en", f"s{k % 4}") for k in range(200)]))
    copies = {r.doc_id: r.copies for r in m.mix(docs).collect()}
    repeated = m.repeat_mixed(docs)
    assert repeated.columns == docs.columns
    count: dict = {}
    for r in repeated.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {d: n for d, n in copies.items() if n}


def test_equal_rows_are_split_at_the_target(spark):
    """A budget that ends among equal rows takes as many of them as it needs."""
    rng = random.Random(10)
    for copies in (300, 7):
        rows = [(5, "the same ten words again and again in each row", "en", "b")] * copies
        rows += [(100 + k, prose(rng, rng.randint(5, 40)), "en", rng.choice(["a", "c", None])) for k in range(150)]
        docs = with_clashes(documents(spark, rows)).repartition(7)
        got = m.mix(docs).collect()
        check(docs, got)
        again = m.mix(docs.coalesce(2)).collect()
        assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
        assert copies < 300 or len({r.copies for r in got if r.doc_id == 5}) == 2
        repeated = m.repeat_mixed(docs)
        assert repeated.columns == docs.columns
        assert repeated.where("doc_id = 5").count() == sum(r.copies for r in got if r.doc_id == 5)
