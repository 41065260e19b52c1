import random

from pyspark.sql import functions as F

from cuelake.llm import toxicity as t
from tests.llm.helpers import documents, odd_documents, prose, with_clashes


def test_fold():
    assert t.fold("M0r0n!") == t.fold("moron") == " moron "
    assert t.fold("іdіоt") == t.fold("IDIOT") == t.fold("1d!ot") == t.fold("i​diot")
    assert t.fold("１２ 34") == " 12 34 "
    assert t.fold("") == "  "


def test_exceptions_and_repeated_hits():
    model = t.Model({" rat ": 4.0, " ra": 3.0}, [" iab rat "])
    assert list(model.hits(t.fold("rat rat rats")).values()) == [4.0, 4.0, 3.0]
    assert model.hits(t.fold("a lab rat")) == {}
    assert model.density(None) == model.density("") == model.score("") == 0.0
    assert model.density("rat " + "word " * 10) > model.density("rat " + "word " * 1000)


def labelled(spark, n=1200, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = prose(rng, rng.randint(10, 120)).split()
        toxic = k % 8 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumbfool", "snarkwit", "dreadloaf"]))
        rows.append((k, " ".join(words), "en", f"s{k % 3}"))
        labels.append((k, 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = t.learn(docs, labels)
    got = t.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 200
    assert all(r.predicted == r.toxic for r in got)
    assert all(0 <= r.score <= 1 and (r.score >= 0.3) == (r.predicted == 1) for r in got)
    hidden = [(1, "you gгumbf00l, what a SNARKW1T you are", "en", None), (2, prose(random.Random(8), 90), "en", None)]
    assert [r.predicted for r in t.score(documents(spark, hidden), model).orderBy("doc_id").collect()] == [1, 0]


def test_held_out_labels_do_not_matter(spark):
    docs, labels = labelled(spark, 400)
    flipped = labels.withColumn("toxic", F.when(t.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = t.learn(docs, labels), t.learn(docs, flipped)
    assert (a.weights, a.exceptions, a.boundary) == (b.weights, b.exceptions, b.boundary)


def test_odd_rows(spark):
    docs, labels = labelled(spark, 300)
    model = t.learn(docs, labels)
    odd = with_clashes(odd_documents(spark))
    got = t.score(odd, model).collect()
    assert len(got) == odd.count() and all(r.predicted == 0 for r in got)
    assert t.keep_civil(odd, model).columns == odd.columns
    assert t.keep_civil(odd, model).count() == odd.count()
    assert t.score(odd.limit(0), model).collect() == []
    nothing = t.learn(odd.limit(0), labels)
    assert nothing.weights == {} and nothing.score("anything") == 0.0
    null_labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert t.learn(odd, null_labels) is not None
