import random

import corpus_pipeline
from cuelake.llm import near_texts as n
from cuelake.llm import simhash
from tests.llm.helpers import documents, odd_documents, prose, with_clashes


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def similar(a, b):
    return len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))


def edited(rng, text, swaps):
    words = text.split()
    for _ in range(swaps):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


def brute_firsts(rows):
    """Least row of each group of linked rows; rows are (id, text)."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(rows[i][1], rows[j][1]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[k] for k in range(len(rows)) if find(k) == k}


def test_edited_copies_equal_brute_force(spark):
    rng = random.Random(21)
    rows = [(k, prose(rng, 150)) for k in range(40)]
    rows += [(100 + k, edited(rng, rows[k % 40][1], k // 40 * 2 + 1)) for k in range(160)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    want = brute_firsts(rows)
    assert 40 < len(want) < 150
    for most in (1024, 2):
        got = {(r.doc_id, r.text) for r in n.keep_first(docs, most=most).collect()}
        assert got == want, most
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    assert {(r.doc_id, r.text) for r in stage(spark, docs, "").collect()} == want


def test_one_row_of_each_group_of_odd_ids(spark):
    rng = random.Random(22)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (3, c), (5, c), (5, d), (9, d), (None, d), (4, e), (4, e)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted(((r.doc_id or 0), r.text) for r in n.keep_first(with_clashes(docs)).collect())
    assert got == sorted([(0, a), (0, b), (3, c), (5, d), (4, e)])


def test_odd_rows(spark):
    docs = with_clashes(odd_documents(spark))
    out = n.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "4", "5", "7", "8", "9007199254740993", "None"])
    assert n.keep_first(docs.limit(0)).collect() == []


def test_links_of_fingerprints_and_sets_join_into_groups(spark):
    rng = random.Random(17)
    cycle = " ".join(prose(rng, 6).split()[:5])
    often = " ".join([cycle] * 200)
    first, second = f"{often} plum quartz rivet", f"{often} sable tunic umber"
    assert not similar(first, second)
    assert bin(simhash.fingerprint(first) ^ simhash.fingerprint(second)).count("1") <= 3
    long = prose(rng, 300)
    rows = [(1, first), (2, second), (3, long), (4, edited(rng, long, 4)), (5, prose(rng, 300)), (6, None), (7, "")]
    docs = documents(spark, [(k, t, "en", "s") for k, t in rows])
    assert {r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()} == {1, 3, 5, 6}
