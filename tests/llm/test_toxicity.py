import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_gradient_descent_reaches_the_optimum():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 3))
    w, theta = np.array([1.5, -1.0, 0.0]), np.array([0.0, 1.0, 2.5])
    y = (x @ w + r.logistic(size=4000))[:, None] > theta[None, :]
    got_w, got_theta = toxicity.fit_ordinal(x, y.sum(1), 3)
    assert np.abs(got_w - w).max() < 0.15 and np.abs(got_theta - theta).max() < 0.2
    assert (np.diff(got_theta) > 0).all()


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    true = labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("label"))
    held = toxicity.score(docs, model).join(true, "doc_id").toPandas()
    hit, label = held.toxic.astype(bool), held.label == 1
    assert (hit & label).sum() >= 0.95 * hit.sum()
    assert (hit & label).sum() >= 0.9 * label.sum()
    order = model.scores(["the of and", "idiot the of and to in a is that on", "idiot moron scum loser trash stupid"])[0]
    assert order[0] < order[1] < order[2] and order[2] <= toxicity.GRADES


def test_like_brute_force(tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, rows=400)
    rows = docs.limit(50).collect()
    got = {r.doc_id: r for r in toxicity.score(docs.limit(50), model).collect()}
    for r in rows:
        words = toxicity._WORD.findall((r.text or "").lower())
        eta = model.weights[-1] * np.log1p(len(words)) / 10
        named = [f for w in words for f in toxicity.features_of(w)]
        eta += sum(model.weights[k] * np.log1p(named.count(w)) for w, k in model.words.items())
        at_most = [0] + [1 / (1 + np.exp(eta - t)) for t in model.thresholds] + [1]
        severity = sum(k * (at_most[k + 1] - at_most[k]) for k in range(toxicity.GRADES + 1))
        assert abs(severity - got[r.doc_id].severity) < 1e-9


def test_odd_tables(spark, tables):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (1, "idiot " * 90_000, None)],
                                 "doc_id long, text string, toxic string")
    model = toxicity.train(*tables, rows=300)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 3 and sum(r.toxic for r in got) == 1
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    none = toxicity.train(docs, labels)
    assert {r.severity for r in toxicity.score(docs, none).collect()} == {0.0}
    both = spark.createDataFrame([(77, 1), (78, 0)], "doc_id long, toxic int")
    assert {r.severity for r in toxicity.score(docs, toxicity.train(docs, both)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
