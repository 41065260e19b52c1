import random
import re

import numpy as np
import xxhash

from cuelake.llm import simhash as s
from cuelake.llm.components import components
from tests.llm.helpers import documents, odd_documents, prose, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(fps, radius=3):
    """Smallest member index of each item's group."""
    first = list(range(len(fps)))

    def find(x):
        while first[x] != x:
            first[x] = first[first[x]]
            x = first[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                first[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \n", "A", "a b", "É é A", "a b c", "a b\x1cc d", "x y z"] + [prose(rng, n) for n in (3, 4, 50, 400)]
    assert [s.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def near(rng, count):
    """Fingerprints with many pairs at the radius and just beyond it, and chains."""
    out = []
    for _ in range(count):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                x ^= 1 << b
    return list(dict.fromkeys(out))


def groups_of(spark, fps, **options):
    frame = spark.createDataFrame([(s._signed(f),) for f in fps], "fp long")
    found = components(s.link_fingerprints(frame, **options)).collect()
    roots = {r.node & s.FULL: r.root & s.FULL for r in found}
    by: dict = {}
    for k, f in enumerate(fps):
        by.setdefault(roots.get(f, f), []).append(k)
    return {k: min(members) for members in by.values() for k in members}


def test_links_equal_brute_force(spark):
    fps = near(random.Random(2), 120)
    want = brute_groups(fps)
    assert len(set(want)) < len(fps)
    for options in ({}, {"bands": 2, "points": 3}, {"bands": 1, "points": 4}, {"most": 4}, {"most": 4, "depth": 1}):
        got = groups_of(spark, fps, **options)
        assert [got[k] for k in range(len(fps))] == want, options


def test_a_crowded_ball(spark):
    """Many fingerprints that share most bits, so that cells are hot at every depth."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(20), 5)) for _ in range(400)})
    want = brute_groups(fps)
    for options in ({"most": 16}, {"most": 16, "depth": 1}):
        got = groups_of(spark, fps, **options)
        assert [got[k] for k in range(len(fps))] == want, options


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    pairs = [(5000 + 2 * k, 5001 + 2 * k) for k in range(20)] + [(7, 7)]
    got = components(spark.createDataFrame(chain + star + pairs, "a long, b long")).collect()
    root = {r.node: r.root for r in got}
    assert len(root) == 301 + 300 + 40
    assert len({root[k] for k in range(301)}) == 1 and len({root[1000 + k] for k in range(300)}) == 1
    assert len(set(root.values())) == 22
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents(spark):
    rng = random.Random(4)
    base = prose(rng, 4000).split()
    rows = [(10 + k, prose(rng, 60), "en", "a") for k in range(30)]
    rows += [(100 + k, " ".join(base[:k * 37] + ["swapped"] + base[k * 37 + 1 :]), "en", "a") for k in range(12)]
    rows += [(200 + k, rows[3][1], "en", "b") for k in range(20)]
    docs = documents(spark, rows).unionByName(odd_documents(spark))
    got = {}
    for r in s.group_documents(with_clashes(docs)).collect():
        got.setdefault(r.doc_id, (r.fp & s.FULL, r.component_id))
    text = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in text]
    first = brute_groups(fps)
    least: dict = {}
    for k, (d, _) in enumerate(text):
        least[first[k]] = min(x for x in (least.get(first[k]), d) if x is not None) if d is not None or first[k] in least else None
    assert got == {d: (fps[k], least[first[k]]) for k, (d, _) in enumerate(text)}
    assert sum(got[100 + k][1] == 100 for k in range(12)) >= 10
    kept = s.keep_first(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted(
        {(d is None, d) for d, (_, c) in got.items() if d == c}, key=lambda x: (x[0], x[1] or 0)
    )
    assert s.group_documents(docs.limit(0)).collect() == []


def test_one_row_of_each_group_of_odd_ids(spark):
    rng = random.Random(6)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (3, c), (5, c), (5, d), (9, d), (None, d), (4, e), (4, e)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted((r.doc_id or 0, r.text) for r in s.keep_first(with_clashes(docs)).collect())
    assert got == sorted([(0, a), (0, b), (3, c), (5, d), (4, e)])
