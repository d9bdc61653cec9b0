"""Softmax boosting: against a brute-force version, penalties, quality, persistence."""

import json
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pondlake.operators import learn as L
from pondlake.operators.boosting import SoftmaxBoosting, SoftmaxBoostingModel


def _three(spark, n=1500, seed=3):
    """Three classes by the sector of a point, a noise column beside them."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = ((np.arctan2(x[:, 1], x[:, 0]) + np.pi) // (2 * np.pi / 3)).clip(0, 2)
    return spark.createDataFrame([(*map(float, r), float(c)) for r, c in zip(x, y)], "a double, b double, c double, label double") \
        .repartition(4).select("label", array_to_vector(F.array("a", "b", "c")).alias("features"))


def _plain_loss_tree(x, g, h, edges, depth, alpha, lam, gamma):
    """Values by row of a tree grown greedily in plain loops."""
    def shrunk(v):
        return math.copysign(max(abs(v) - alpha, 0.0), v)

    def score(rows):
        return shrunk(g[rows].sum()) ** 2 / (h[rows].sum() + lam)
    out = np.zeros(len(x))

    def grow(rows, d):
        best = (0.0, None, None)
        for f, es in enumerate(edges):
            for e in es:
                lo, hi = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                if h[lo].sum() < 1 or h[hi].sum() < 1:
                    continue
                gain = 0.5 * (score(lo) + score(hi) - score(rows)) - gamma
                if gain > best[0] + 1e-12:
                    best = (gain, f, e)
        if d == 0 or best[1] is None:
            out[rows] = -shrunk(g[rows].sum()) / (h[rows].sum() + lam)
            return
        grow(rows[x[rows, best[1]] <= best[2]], d - 1)
        grow(rows[x[rows, best[1]] > best[2]], d - 1)
    grow(np.arange(len(x)), depth)
    return out


@pytest.mark.parametrize("alpha, lam, gamma", [(0.0, 1.0, 0.0), (3.0, 5.0, 2.0)])
def test_equals_brute_force(spark, alpha, lam, gamma):
    df = _three(spark, 300)
    est = SoftmaxBoosting(maxIter=2, maxDepth=2, stepSize=0.5, maxBins=8, regAlpha=alpha, regLambda=lam, gamma=gamma)
    pred = est.fit(df).transform(df).collect()
    x = np.array([r.features.toArray() for r in pred])
    y = np.array([int(r.label) for r in pred])
    edges = [sorted(set(v)) for v in df.select(F.col("features").alias("v")).select(
        *[F.percentile_approx(L.vector_to_array("v")[i], [k / 8 for k in range(1, 8)], 10_000) for i in range(3)]).first()]
    m = np.zeros((len(x), 3))
    for _ in range(2):
        p = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        m = m + 0.5 * np.stack([_plain_loss_tree(x, p[:, k] - (y == k), p[:, k] * (1 - p[:, k]), edges, 2, alpha, lam, gamma)
                                for k in range(3)], axis=1)
    assert np.allclose(m, np.array([r.rawPrediction.toArray() for r in pred]), atol=1e-9)


def test_beats_one_vs_rest_and_penalties_act(spark, tmp_path):
    df, held = _three(spark), _three(spark, 500, seed=4)
    model = SoftmaxBoosting(maxIter=12, maxDepth=3, stepSize=0.3).fit(df)
    loss = lambda m: L.softmax_log_loss(m.transform(held)).first().log_loss
    own = loss(model)
    rest = L.make_model("boosted", {"maxIter": 12, "maxDepth": 3, "stepSize": 0.3}, weight_col=None).fit(df)
    assert own < loss(rest)
    assert L.BalancedAccuracyEvaluator().evaluate(model.transform(held)) > 0.9
    sampled = lambda seed: SoftmaxBoosting(maxIter=4, maxDepth=3, subsamplingRate=0.7, colsampleByTree=0.7, seed=seed).fit(df)
    assert loss(sampled(5)) == loss(sampled(5)) != loss(sampled(6))
    nodes = lambda m: sum(len(t["left"]) for r in json.loads(m.getOrDefault(m.trees))["rounds"] for t in r)
    size = lambda m: sum(abs(v) for r in json.loads(m.getOrDefault(m.trees))["rounds"] for t in r for v in t["value"])
    short = dict(maxIter=3, maxDepth=3, stepSize=0.3)
    plain = SoftmaxBoosting(**short).fit(df)
    assert nodes(SoftmaxBoosting(gamma=20.0, **short).fit(df)) < nodes(plain)
    assert size(SoftmaxBoosting(regLambda=100.0, **short).fit(df)) < size(plain)
    assert size(SoftmaxBoosting(regAlpha=1e9, **short).fit(df)) == 0
    model.write().overwrite().save(str(tmp_path / "m"))
    assert loss(SoftmaxBoostingModel.load(str(tmp_path / "m"))) == own


def test_nulls_weights_and_empty_tables(spark):
    rows = [(0.0, 1.0, 1.0), (1.0, 5.0, None), (None, 2.0, 1.0), (1.0, float("nan"), 2.0), (0.0, 1.0, 1.0), (1.0, None, 1.0)] * 20
    df = spark.createDataFrame(rows, "label double, x double, w double").withColumn(
        "features", F.when(F.col("x").isNotNull(), array_to_vector(F.array("x"))))
    got = SoftmaxBoosting(maxIter=3, maxDepth=2, weightCol="w", stepSize=1.0).fit(df).transform(df)
    assert {(r.x is None, r.prediction is None) for r in got.collect()} == {(True, True), (False, False)}
    assert got.filter("x = 5 or isnan(x)").filter("prediction = 1").count() == 40
    with pytest.raises(ValueError):
        SoftmaxBoosting().fit(df.filter("false"))


def test_in_a_pipeline_with_reference_names(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i % 3), float(i % 3)) for i in range(240)],
                               "id long, a double, b double, label double")
    params = L.map_params("softmax", {"learning_rate": 0.5, "max_depth": 2, "n_estimators": 3, "subsample": 0.8, "colsample_bytree": 1.0,
                                      "reg_alpha": 0.1, "reg_lambda": 2.0, "gamma": 0.1})
    stages = L.preprocessor(df, exclude=["id"])
    model = Pipeline(stages=[*stages, L.make_model("softmax", params, weight_col=None)]).fit(df)
    assert L.evaluate(model, df) > 0.6
