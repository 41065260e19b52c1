"""Merkle manifest against plain loops, for several fan-outs and numbers of levels a pass."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cuelake.llm import merkle as m
from tests.llm.helpers import documents, odd_documents, prose, with_clashes


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    n = None if r.n_chars is None else r.n_chars + more
    values = [r.doc_id, r.source, r.lang, n, r.text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """Root, and the siblings (before, after) of every node level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for p, k in zip(paths, at):
            p.append((runs[k // fanout][: k % fanout], runs[k // fanout][k % fanout + 1 :]))
        at = [k // fanout for k in at]
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def slow(rows, fanout):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], fanout)
    root, tops = tree([trees[g][0] for g in langs], fanout)
    out = []
    for g, top in zip(langs, tops):
        for r, path in zip(groups[g], trees[g][1]):
            whole = path + top
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            own = leaf(r, 1) if bad else leaf(r)
            for before, after in whole:
                own = h(*before, own, *after)
            proof = h(*[s for before, after in whole for s in before + after])
            out.append((r.doc_id, leaf(r), trees[g][0], root, proof, own, own == root))
    return out


def bad(docs):
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, docs["n_chars"] + 1)


@pytest.mark.parametrize("fanout,levels", [(2, 3), (2, 1), (4, 2)])
def test_manifest(spark, fanout, levels):
    rng = random.Random(4)
    langs = ["en"] * 6 + ["de", "fr", "Ünï", "z"]
    more = documents(spark, [(rng.choice([100 + k, 100]), prose(rng, 5), rng.choice(langs), "s") for k in range(150)] + [(900, "one", "solo", None)])
    docs = odd_documents(spark).unionByName(more)
    got = m.verified(m.manifest(with_clashes(docs).repartition(5), bad(docs), fanout, levels)).collect()
    want = slow(docs.collect(), fanout)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 0 < sum(not r.verified for r in got) < len(got) / 3


@pytest.mark.parametrize("n", [0, 1, 9])
def test_sizes(spark, n):
    docs = documents(spark, [(k, f"text {k}", "en", "s") for k in range(n)])
    got = m.verified(m.manifest(docs, bad(docs))).collect()
    assert sorted(map(tuple, got)) == (sorted(slow(docs.collect(), 2)) if n else [])
