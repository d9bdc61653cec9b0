"""Boosted trees for two classes: against MLlib's, in one task and by Spark jobs, and the
query that searches them over the whole space."""

import time
import warnings
from multiprocessing.pool import ThreadPool
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from pondlake.operators import learn as L
from pondlake.operators import logistic as G
from pondlake.plans import queries_learn as Q
from pondlake.schema import BOOSTED_SPACE, CV_SPLITS, SEARCH_TRIALS
from pondlake.session import ship_package


def _rows(spark, n=240, seed=5, values=24, classes=2, parts=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, size=(n, 3)) / 7.0
    score = x[:, 0] - x[:, 1] + 0.4 * x[:, 2] + rng.normal(size=n) * 0.5
    y = np.digitize(score, np.quantile(score, np.arange(1, classes) / classes))
    return spark.createDataFrame([(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, label double") \
        .coalesce(parts).select("id", "label", array_to_vector(F.array("a", "b", "c")).alias("features"))


def _margins(model, df):
    return np.array([r.m for r in model.transform(df).select("id", vector_to_array("rawPrediction")[1].alias("m")).orderBy("id").collect()])


@pytest.mark.parametrize("least, info", [(1, 0.0), (9, 0.0), (1, 0.15)])
def test_equals_mllib_where_nothing_is_drawn(spark, least, info):
    df = _rows(spark)
    given = dict(maxIter=6, maxDepth=4, stepSize=0.3, minInstancesPerNode=least, minInfoGain=info)
    mine, theirs = G.LogisticBoosting(**given).fit(df), GBTClassifier(**given).fit(df)
    assert np.allclose(_margins(mine, df), _margins(theirs, df), atol=1e-9)
    assert [t.depth for t in mine.trees] == [t.depth for t in theirs.trees] and mine.getNumTrees == theirs.getNumTrees
    predicted = lambda m: [r.prediction for r in m.transform(df).orderBy("id").collect()]
    assert predicted(mine) == predicted(theirs)


@pytest.mark.parametrize("given", [{}, {"subsamplingRate": 0.6, "featureSubsetStrategy": "0.6", "gamma": 0.4}, {"maxDepth": 0}, {"maxDepth": 9, "minInfoGain": 0.01}])
def test_spark_jobs_and_one_task_give_the_same_model(spark, monkeypatch, given):
    df = _rows(spark, values=10_000)
    est = G.LogisticBoosting(**{"maxIter": 4, "maxDepth": 3, "stepSize": 0.5, "seed": 7, "maxBins": 8, **given})
    here = est.fit(df)
    monkeypatch.setattr(G, "TASK_VALUES", 0)
    monkeypatch.setattr(G, "CUT_ROUNDS", 2)
    monkeypatch.setattr(G, "NODES", 2)
    apart = est.fit(df)
    assert np.allclose(_margins(here, df), _margins(apart, df), atol=1e-9)
    assert [(t.numNodes, t.depth) for t in here.trees] == [(t.numNodes, t.depth) for t in apart.trees]


def test_nodes_in_pieces_give_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 5)), np.sign(rng.normal(size=400))
    params = {"rounds": 3, "depth": 12, "bins": 32, "step": 0.3, "rate": 0.8, "size": 4, "least": 1, "info": 0.0, "gamma": 0.0, "seed": 1}
    whole = G._boost_here(x, y, np.arange(400), params)
    monkeypatch.setattr(G, "NODES", 3)
    pieces = G._boost_here(x, y, np.arange(400), params)
    assert max(len(t["left"]) for t in whole) > 50
    assert np.allclose(G._margin(whole, x, np.zeros(400)), G._margin(pieces, x, np.zeros(400)), atol=1e-9)


def test_rare_values_are_cut_off(spark, monkeypatch):
    """One row of a hundred has its own value; quantiles alone would not see it."""
    df = spark.createDataFrame([(i, float(i % 100 > 0), float(i % 100 == 0)) for i in range(300)], "id long, a double, label double") \
        .select("id", "label", array_to_vector(F.array("a")).alias("features"))
    for limit in (G.TASK_VALUES, 0):
        monkeypatch.setattr(G, "TASK_VALUES", limit)
        model = G.LogisticBoosting(maxIter=1, maxDepth=1).fit(df)
        assert model.transform(df).filter("prediction <> label").count() == 0


def test_gamma_is_a_sum_over_rows(spark):
    """The reference's values cut some branches; as a mean a row they would stop every cut."""
    df = _rows(spark)
    nodes = lambda **p: sum(t.numNodes for t in G.LogisticBoosting(maxIter=5, maxDepth=6, stepSize=0.3, **p).fit(df).trees)
    assert 5 < nodes(gamma=2.0) < nodes(gamma=0.5) < nodes()
    assert nodes(gamma=1e9) == nodes(minInfoGain=2.0) == 5


def test_nulls_nan_and_odd_tables(spark):
    rows = [(0.0, 1.0), (1.0, 5.0), (None, 2.0), (1.0, float("nan")), (0.0, 1.0), (1.0, None)] * 20
    df = spark.createDataFrame(rows, "label double, x double").withColumn(
        "features", F.when(F.col("x").isNotNull(), array_to_vector(F.array("x"))))
    est = G.LogisticBoosting(maxIter=3, maxDepth=2)
    got = est.fit(df).transform(df)
    assert {(r.x is None, r.prediction is None, r.rawPrediction is None) for r in got.collect()} == {(True, True, True), (False, False, False)}
    assert got.filter("(x = 5 or isnan(x)) and prediction = 1").count() == 40
    for bad in ("false", "label = 7"):
        with pytest.raises(ValueError):
            est.fit(df.withColumn("label", F.lit(7.0)).filter(bad))
    one = est.fit(df.filter("label = 1"))  # a single class: constant trees
    assert {t.depth for t in one.trees} == {0} and one.transform(df.filter("x = 1")).first().prediction == 1.0
    with pytest.raises(ValueError):
        G.LogisticBoosting(featureSubsetStrategy="1.5").fit(df)


def test_one_vs_rest_of_it_learns_and_persists(spark, tmp_path):
    df, held = _rows(spark, 600, classes=3, parts=3), _rows(spark, 300, seed=6, classes=3)
    model = L.make_model("boosted", L.map_params("boosted", {"n_estimators": 40, "max_depth": 4, "learning_rate": 0.2, "gamma": 0.5, "subsample": 0.8,
                                                             "colsample_bytree": 0.7}), weight_col=None).fit(df)
    assert L.BalancedAccuracyEvaluator().evaluate(model.transform(held)) > 0.7
    model.write().overwrite().save(str(tmp_path / "m"))
    again = OneVsRestModel.load(str(tmp_path / "m"))
    told = lambda m: [tuple(r.rawPrediction) for r in m.transform(held).orderBy("id").collect()]
    assert told(again) == told(model)


def test_train_boosted_searches_the_whole_space(spark, tmp_path, monkeypatch):
    """All rows, trials, folds and rounds of the reference's space. The search itself is made short here."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=64)], i % 10) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    asked, real = [], L.tune

    def short(train, stages, name, space, n_iter, folds):
        asked.append((train.count(), name, space, n_iter, folds))
        return real(train, stages, name, {"n_estimators": {"type": "Integer", "low": 3, "high": 3}}, n_iter=1, folds=2)
    monkeypatch.setattr(L, "tune", short)
    out = Q.q_train_boosted(spark, str(tmp_path)).collect()
    assert asked == [(73, "boosted", BOOSTED_SPACE, SEARCH_TRIALS, CV_SPLITS)]
    assert len(out) == 17 and all(r.valid for r in out)


def test_every_trial_of_the_space_grows_its_rounds_and_cuts():
    """With the least gains of 0.5 to 4.6 that are drawn, trees still have cuts."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(320, 64)), np.where(rng.random(320) < 1 / 3, 1.0, -1.0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        trials = [L.map_params("boosted", d) for d in L.sample_space(BOOSTED_SPACE, SEARCH_TRIALS)]
    for t in trials:
        size = G._subset(t["featureSubsetStrategy"], 64)
        trees = G._boost_here(x, y, np.arange(320), {"rounds": t["maxIter"], "depth": t["maxDepth"], "bins": 32, "step": t["stepSize"], "rate": t["subsamplingRate"],
                                                     "size": size, "least": 1, "info": 0.0, "gamma": t["gamma"], "seed": 42})
        assert 500 <= len(trees) == t["maxIter"] and sum(len(tree["left"]) > 1 for tree in trees) > 0


def test_fits_side_by_side_ship_the_package_once():
    sent = []
    sc = SimpleNamespace(applicationId="side-by-side", addPyFile=lambda p: (time.sleep(0.1), sent.append(p)))
    with ThreadPool(6) as pool:
        pool.map(lambda _: ship_package(SimpleNamespace(sparkContext=sc)), range(6))
    assert len(sent) == 1
