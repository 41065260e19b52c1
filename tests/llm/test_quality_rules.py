import random
import re
from collections import Counter

import numpy as np

from cuelake.llm import quality_rules as q
from tests.llm.helpers import documents, odd_documents, prose, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeated = sum(line in lines[:k] for k, line in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a b c d e", "a b c d e a b c d e", "x\nx\n \n \nx", "a b\x1cc　d e\x85f", "# * $ % & | < > !"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += ["\n".join(rng.choice(["p q", "", "r", " "]) for _ in range(12)) for _ in range(50)]
    for text in texts:
        assert tuple(int(v) for v in q.text_stats(text or "")[:5]) == brute(text)[:5], text


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = q.judge(with_clashes(docs)).collect()
    assert len(rows) == docs.count()
    texts = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == texts
    assert all(not r.kept for r in rows if r.base_failed)


def test_empty_table(spark):
    assert q.judge(odd_documents(spark).limit(0)).collect() == []


def test_outliers_go_and_sound_rows_stay(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.randint(20, 300)), "en", "big" if k % 3 else f"s{k % 40}") for k in range(900)]
    junk = [(1000 + k, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "big") for k in range(60)]
    junk += [(2000 + k, prose(rng, 60).upper().replace(" ", "!! "), "en", "s3") for k in range(20)]
    docs = documents(spark, rows + junk)
    kept = {r.doc_id for r in q.judge(docs).where("kept").collect()}
    assert not {k for k in kept if k >= 1000}
    assert len(kept) >= 0.97 * len(rows)
    left = q.keep_good(with_clashes(docs))
    assert left.columns == with_clashes(docs).columns
    assert {r.doc_id for r in left.collect()} == kept


def test_a_pool_of_which_a_third_is_junk(spark):
    rng = random.Random(7)
    for kind, spoil in enumerate((
        lambda t: " ".join(w + "###" for w in t.split()), lambda t: t.upper(), lambda t: t.replace(" ", "!! ")
    )):
        rows = [(k, prose(rng, rng.randint(30, 300)), "en", "s") for k in range(400)]
        junk = [(1000 + k, spoil(prose(rng, rng.randint(30, 300))), "en", "s") for k in range(200)]
        kept = {r.doc_id for r in q.judge(documents(spark, rows + junk)).where("kept").collect()}
        assert not {k for k in kept if k >= 1000}, kind
        assert len(kept) >= 0.97 * len(rows), kind


def test_parameters_equal_a_local_estimate(spark):
    """The grouped concentration steps against the same steps on arrays, up to the width of a bin."""
    rng = np.random.default_rng(5)
    d = len(q.FEATURES)
    x = rng.normal(size=(3000, d)) * np.array([0.2, 0.1, 0.1, 0.3, 0.3, 0.1, 0.2]) + 1
    x[:300] += 2.0
    frame = spark.createDataFrame([("p", *map(float, r)) for r in x], "pool string, " + ", ".join(f"{f} double" for f in q.FEATURES))
    got = q.mcd_parameters(frame).first()
    assert np.allclose(got.centre, 1, atol=0.05)  # a tenth of the rows far off does not move it
    inverse = np.zeros((d, d))
    at = 0
    for i in range(d):
        for j in range(i, d):
            inverse[i, j] = inverse[j, i] = got.inverse[at] / (1 if i == j else 2)
            at += 1
    sd = np.sqrt(np.diag(np.linalg.inv(inverse)))
    want = np.sqrt(np.array([0.2, 0.1, 0.1, 0.3, 0.3, 0.1, 0.2]) ** 2 + np.square(q.FLOORS))
    assert np.allclose(sd, want, rtol=0.25)


def test_sparse_groups_are_pooled(spark):
    rows = [("en", "a", 150), ("en", "b", 5), ("en", "c", 120), ("fr", "a", 3), (None, None, 2), ("de", "x", 60), ("de", "y", 60)]
    stats = spark.createDataFrame([(lang, s, False) for lang, s, n in rows for _ in range(n)], "lang string, source string, base_failed boolean")
    pools = {(r.lang, r.source): r.pool for r in q.pooled(stats, 100).collect()}
    assert pools["en", "a"] != pools["en", "c"] and pools["de", "x"] == pools["de", "y"]
    assert pools["en", "b"] == pools["fr", "a"] == pools[None, None] == "*"
