import random

from cuelake.llm import site_quality as s
from tests.llm.helpers import documents, odd_documents, prose, with_clashes


def corpus(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        host = "bad" if k % 5 == 0 else "good" if k % 5 < 4 else f"tiny{k}"
        good = rng.random() < {"bad": 0.2, "good": 0.95}.get(host, 0.8)
        text = prose(rng, rng.randint(20, 120))
        rows.append((k, text if good else text.upper().replace(" ", "!! "), "en" if k % 2 else "de", host))
        labels.append((k, int(good), 0))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_and_posteriors(spark):
    docs, labels = corpus(spark)
    rows = s.score_quality(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == 900
    assert sum(r.kept == (r.quality == 1) for r in rows) > 890
    host = {r.source: r.host_posterior for r in rows}
    assert host["bad"] < 0.4 < 0.85 < host["good"]
    mean = sum(r.quality for r in rows) / 900
    tiny = [p for h, p in host.items() if h.startswith("tiny")]
    assert all(min(host["bad"], mean) < p < 1 for p in tiny)  # one document does not decide a site


def test_posteriors_equal_brute_force(spark):
    docs, labels = corpus(spark)
    got = s.score_quality(docs, labels).collect()
    by = {r.doc_id: r for r in docs.collect()}
    from math import exp, log

    base = [r.quality for r in labels.where(~s.held_out(labels.doc_id)).collect()]
    prior = sum(base) / len(base)
    p = {r.doc_id: 1 / (1 + exp(-(r.evidence + log(prior / (1 - prior))))) for r in got}
    # a path's posterior is (sum + k * host) / (n + k) with one k for all paths
    sums: dict = {}
    for r in got:
        n, t = sums.get((by[r.doc_id].source, by[r.doc_id].lang), (0, 0.0))
        sums[by[r.doc_id].source, by[r.doc_id].lang] = (n + 1, t + p[r.doc_id])
    strengths = set()
    for r in got:
        n, t = sums[by[r.doc_id].source, by[r.doc_id].lang]
        if abs(r.host_posterior - r.path_posterior) > 1e-3:
            strengths.add(round((n * r.path_posterior - t) / (r.host_posterior - r.path_posterior), 3))
    assert len(strengths) == 1


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    odd = with_clashes(odd_documents(spark))
    assert s.score_quality(odd, labels).count() == odd.count()
    assert s.score_quality(odd, labels.limit(0)).count() == odd.count()
    assert s.score_quality(odd.limit(0), labels).collect() == []


def test_a_site_of_one_document_has_the_mean_as_prior(spark):
    from math import exp, log

    docs, labels = corpus(spark)
    alone = docs.selectExpr("doc_id", "text", "lang", "concat('site', doc_id) as source", "n_chars")
    rows = s.score_quality(alone, labels).collect()
    back = [log(r.score / (1 - r.score)) - r.evidence for r in rows if abs(r.evidence) < 11]
    assert max(back) - min(back) < 1e-6
    mean = 1 / (1 + exp(-back[0]))
    assert 0.6 < mean < 0.9


def test_sparse_sites_count_in_the_spread(spark):
    """Sites of three documents that are good or bad throughout: their mean says much."""
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(900):
        good = k // 3 % 2 == 0
        text = prose(rng, rng.randint(20, 120))
        rows.append((k, text if good else text.upper().replace(" ", "!! "), "en", f"site{k // 3}"))
        labels.append((k, int(good), 0))
    got = s.score_quality(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    host = {(r.doc_id // 3 % 2 == 0): r.host_posterior for r in got}
    assert host[True] > 0.75 and host[False] < 0.25
