"""The pipeline against the operators' own results, and its stages on odd rows."""

import random

import corpus_pipeline
from cuelake.llm import mixing, quality_rules, simhash, toxicity
from tests.llm.helpers import documents, odd_documents, prose, with_clashes


def corpus(spark, folder):
    rng = random.Random(11)
    rows = [(k, prose(rng, rng.randint(12, 200)), "en", f"s{k % 3}") for k in range(300)]
    rows += [(400 + k, rows[k][1], "en", "s0") for k in range(40)]
    rows += [(500 + k, " ".join(w + "###" for w in prose(rng, 60).split()), "en", "s1") for k in range(20)]
    labels = [(r[0], 1, 0) for r in rows]
    for k in range(80):
        words = prose(rng, 60).split()
        for _ in range(4):
            words.insert(rng.randrange(60), "grumbfool")
        rows.append((600 + k, " ".join(words), "en", "s2"))
        labels.append((600 + k, 1, 1))
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r for r in rows}


def test_run(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    good = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert not {d for d in good if 500 <= d < 520} and len(good) > 400
    kept = docs.where(docs.doc_id.isin(list(good)))
    model = toxicity.learn(kept, labels)
    civil = {r.doc_id for r in toxicity.score(kept, model).where("predicted = 0").collect()}
    assert civil == {d for d in good if d < 600}
    kept = docs.where(docs.doc_id.isin(list(civil)))
    first = {r.doc_id for r in simhash.group_documents(kept).collect() if r.doc_id == r.component_id}
    assert first == {d for d in civil if d < 400}
    kept = docs.where(docs.doc_id.isin(list(first)))
    copies = {r.doc_id: r.copies for r in mixing.mix(kept).collect() if r.copies}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    starts: dict = {}
    for r in pieces:
        if r.start == 0:
            starts[r.doc_id] = starts.get(r.doc_id, 0) + 1
    assert starts == copies
    assert set(starts) <= set(rows)


def test_stages_take_odd_rows(spark, tmp_path):
    corpus(spark, tmp_path)
    odd = with_clashes(odd_documents(spark))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= 3 * docs.count() + 200
            if (name, stage) != corpus_pipeline.STAGES[-1]:
                assert out.columns == odd.columns
