"""The score of documents: its fit, and what it finds among documents held out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import toxicity


def test_logistic():
    """The gradient is flat, also where the classes can be told apart and where plain Newton steps go back and forth."""
    rng = np.random.default_rng(2)
    for n, rare in ((40, 3), (500, 20), (3000, 1500)):
        y = (np.arange(n) < rare).astype(float)
        x = np.stack([np.ones(n), np.where(y > 0, 6, -9) + rng.normal(0, 1, n), np.where(y > 0, rng.random(n), 0)], 1)
        ridge = np.full(3, 1e-4) * n
        w = toxicity.logistic(x, y, ridge)
        assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + ridge * w).max() < 1e-5 * n
        assert w[1] > 0


def test_spans_raise_the_score(spark):
    rng = np.random.default_rng(7)
    plain = [" ".join(f"{chr(97 + w % 26)}ord{w}" for w in rng.integers(0, 200, 30)) for _ in range(200)]
    docs = spark.createDataFrame([(i, f"{t} {'vile' if i % 3 == 0 else 'good'} {t[::-1]}") for i, t in enumerate(plain)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert min(found[i].score for i in range(0, 200, 3)) > max(found[i].score for i in range(200) if i % 3)
    assert model.link[1] >= 0 and all(bool(r.spans) == (i % 3 == 0) for i, r in found.items())


@pytest.mark.parametrize(("size", "right", "wrong"), [("sf0.01", 9, 0), ("sf0.1", 102, 20)])
def test_held_out(spark, size, right, wrong):
    d = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.op8_toxicity(spark, d).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.sum("predicted").alias("n")).collect()
    found = {r.toxic: r.n for r in found}
    assert found[1] >= right and found[0] <= wrong
