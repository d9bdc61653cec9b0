"""Split/fold properties, fitted stages, persistence, tree models."""

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from pondlake.fixtures import labelled_documents, table
from pondlake.operators import learn as L
from pondlake.sources.sinks import save_model
from tests.conftest import SF_MID, SF_SMALL


def test_split_partitions_ids_and_folds_are_balanced(spark):
    df = labelled_documents(spark, SF_MID)
    s = L.stratified_split(df, "quality", "doc_id").cache()
    assert s.count() == df.count()
    assert s.select("doc_id").distinct().count() == df.count()
    per = s.groupBy("quality", "split").count().collect()
    n = {r.quality: 0 for r in per}
    for r in per:
        n[r.quality] += r["count"]
    for r in per:
        if r.split == "test":
            assert r["count"] == math.floor(0.2 * n[r.quality] + 0.5)
    folds = s.filter("split = 'train'").groupBy("quality", "fold").count().collect()
    by_class = {}
    for r in folds:
        by_class.setdefault(r.quality, []).append(r["count"])
    for counts in by_class.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert s.filter("split = 'test' AND fold IS NOT NULL").count() == 0


def test_same_seed_same_split(spark):
    df = labelled_documents(spark, SF_SMALL)
    a = L.stratified_split(df, "quality", "doc_id", seed=7).select("doc_id", "split").collect()
    b = L.stratified_split(df, "quality", "doc_id", seed=7).select("doc_id", "split").collect()
    c = L.stratified_split(df, "quality", "doc_id", seed=8).select("doc_id", "split").collect()
    assert sorted(a) == sorted(b) and sorted(a) != sorted(c)


def test_label_encode_unseen_is_minus_one(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "t string")
    df = spark.createDataFrame([("a",), ("z",), (None,), ("c",)], "t string")
    got = {r.t: r.t_idx for r in L.label_encode(train, df, ["t"]).collect()}
    assert got == {"a": 0.0, "z": -1.0, None: -1.0, "c": 2.0}
    oh = {r.t: list(r.t_vec) for r in L.one_hot(train, df, ["t"]).collect()}
    assert oh["a"] == [1.0, 0.0, 0.0] and oh["z"] == [0.0, 0.0, 0.0]


def test_scaler_and_imputer_fit_and_persist(spark, tmp_path):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (3.0, 7.0), (None, 9.0)], "a double, b double")
    imp = L.MedianImputer(inputCols=["a", "b"], outputCols=["a_i", "b_i"])
    sc = L.PopulationScaler(inputCols=["a_i", "b_i"], outputCols=["a_s", "b_s"])
    model = Pipeline(stages=[imp, sc]).fit(df)
    out = model.transform(df).collect()
    assert [r.a_i for r in out] == [1.0, 2.0, 3.0, 2.0]
    assert [r.b_i for r in out] == [7.0, 5.0, 7.0, 9.0]
    assert abs(sum(r.a_s for r in out)) < 1e-9
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert [r.a_s for r in again.transform(df).collect()] == [r.a_s for r in out]


def test_approx_imputer_close_to_exact(spark):
    df = spark.range(0, 1001).select((F.col("id") * 1.0).alias("a"))
    exact = L.MedianImputer(inputCols=["a"], outputCols=["b"]).fit(df)
    approx = L.MedianImputer(inputCols=["a"], outputCols=["b"], accuracy=1000).fit(df)
    assert exact.getOrDefault(exact.values) == [500.0]
    assert abs(approx.getOrDefault(approx.values)[0] - 500.0) <= 2.0


def test_sample_space_is_seeded_and_in_range(spark):
    from pondlake.plans.queries_learn import FOREST_SPACE
    a = L.sample_space(FOREST_SPACE, 5, seed=42)
    assert a == L.sample_space(FOREST_SPACE, 5, seed=42)
    for d in a:
        assert 2 <= d["min_samples_split"] <= 25 and 0.5 <= d["max_samples"] <= 1.0
        assert d["max_features"] in ("sqrt", "log2", None)
    lr = L.sample_space({"lr": {"type": "Real", "low": 0.01, "high": 0.3, "prior": "log-uniform"}}, 50)
    assert all(0.01 <= d["lr"] <= 0.3 for d in lr)
    m = L.map_params("random_forest", {"max_depth": 100, "max_features": None, "n_estimators": 9})
    assert m == {"maxDepth": 30, "featureSubsetStrategy": "all", "numTrees": 9}


def test_train_table_random_forest_and_save(spark, tmp_path):
    from pondlake.plans.queries_learn import FOREST_SPACE
    df = labelled_documents(spark, SF_MID)
    model, params, score = L.train_table(df, "quality", "doc_id", "random_forest", FOREST_SPACE,
                                         encoding="ohe", scaling=True, n_iter=2, folds=3)
    assert 0.0 <= score <= 1.0 and set(params) == set(FOREST_SPACE)
    base = save_model(spark, model, params, str(tmp_path / "out"), "documents", "random_forest")
    assert PipelineModel.load(f"{base}/model") is not None
    assert spark.read.text(f"{base}/params").count() == 1


def test_boosted_three_classes_log_loss(spark):
    emb = table(spark, SF_SMALL, "embeddings").filter("label < 3")
    n = 8
    df = emb.select("vec_id", F.col("label").cast("double").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(n)])
    stages = L.preprocessor(df, "none", False, exclude=["vec_id"])
    est = L.make_model("boosted", {"maxIter": 3, "maxDepth": 2}, weight_col=None)
    model = Pipeline(stages=[*stages, est]).fit(df)
    pred = model.transform(df)
    ll = L.softmax_log_loss(pred).first().log_loss
    assert ll > 0 and math.isfinite(ll)
    assert 0 <= L.BalancedAccuracyEvaluator().evaluate(pred) <= 1


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=80))
def test_exact_median_matches_numpy(spark, xs):
    import numpy as np
    df = spark.createDataFrame([(float(x),) for x in xs], "a double")
    got = L.exact_medians(df, ["a"]).first().median
    assert abs(got - float(np.median(xs))) < 1e-12


def test_codes_in_the_pipeline_are_those_of_the_encoder(spark):
    """Unseen and missing are -1, and 40 categories are ordinary numbers to a forest."""
    train = spark.createDataFrame([(i, f"c{i % 40:02d}", float(i % 2)) for i in range(400)], "i long, t string, label double")
    stages = L.preprocessor(train, "label", False, exclude=["i"])
    model = Pipeline(stages=[*stages, L.make_model("random_forest", {"numTrees": 3, "maxDepth": 3}, weight_col=None)]).fit(train)
    test = spark.createDataFrame([(1, "c05", 0.0), (2, "unseen", 0.0), (3, None, 0.0)], "i long, t string, label double")
    rows = model.transform(test).collect()
    assert [r.t_code for r in rows] == [5.0, -1.0, -1.0]
    assert all(r.prediction in (0.0, 1.0) for r in rows)


def test_ordinal_encoder_persists(spark, tmp_path):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    model = L.OrdinalEncoder(inputCols=["t"], outputCols=["c"]).fit(train)
    model.save(str(tmp_path / "enc"))
    again = L.OrdinalEncoderModel.load(str(tmp_path / "enc"))
    assert [r.c for r in again.transform(train).collect()] == [1.0, 0.0, -1.0]


def test_text_without_encoding_raises(spark):
    import pytest
    df = spark.createDataFrame([("a", 1.0, 0.0)], "t string, x double, label double")
    with pytest.raises(ValueError, match="need an encoding"):
        L.preprocessor(df, "none")


def test_parameters_that_change_are_reported():
    import pytest
    with pytest.warns(UserWarning, match="max_depth 100 is cut to 30"):
        assert L.map_params("random_forest", {"max_depth": 100}) == {"maxDepth": 30}
    with pytest.warns(UserWarning, match="reg_alpha has no MLlib counterpart"):
        assert L.map_params("boosted", {"reg_alpha": 1.0}) == {}
    with pytest.raises(ValueError):
        L.map_params("boosted", {"nonsense": 1})
    assert set(L.SPACES["random_forest"]) == {"max_features", "min_samples_split", "max_samples", "max_depth", "n_estimators"}
    draw = L.sample_space(L.SPACES["boosted"], 5)
    assert all(500 <= d["n_estimators"] <= 1500 and 3 <= d["max_depth"] <= 100 for d in draw)


def test_preprocessing_is_fitted_once_a_fold(spark, monkeypatch):
    fits = []
    real = L.MedianImputer._fit
    monkeypatch.setattr(L.MedianImputer, "_fit", lambda self, d: fits.append(1) or real(self, d))
    df = spark.createDataFrame([(i, float(i % 7), float(i % 2)) for i in range(60)], "i long, x double, label double")
    train = L.stratified_split(df, "label", "i", test_size=0.0, folds=3).drop("split")
    space = {"max_depth": {"type": "Integer", "low": 2, "high": 3}, "n_estimators": {"type": "Integer", "low": 2, "high": 3}}
    L.tune(train, L.preprocessor(train, exclude=["i"]), "random_forest", space, n_iter=3, folds=3)
    assert len(fits) == 3 + 1


def test_trials_of_one_vs_rest_have_their_parameters(spark):
    """The classifiers are grown with the drawn parameters, not with MLlib's defaults, in the trials and the refit."""
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(60)], "i long, x double, label double")
    train = L.stratified_split(df, "label", "i", test_size=0.0, folds=2).drop("split")
    space = {"max_depth": {"type": "Integer", "low": 1, "high": 1}, "n_estimators": {"type": "Integer", "low": 2, "high": 2}}
    model, params, _ = L.tune(train, L.preprocessor(train, exclude=["i"]), "boosted", space, n_iter=1, folds=2)
    assert params == {"max_depth": 1, "n_estimators": 2}
    assert [(m.getNumTrees, max(t.depth for t in m.trees)) for m in model.stages[-1].models] == [(2, 1)] * 3
    est = L.make_model("boosted", weight_col=None)
    own = L._with_params(est, {est.getClassifier().maxIter: 3}).getClassifier()
    assert own.getMaxIter() == 3 and est.getClassifier().getMaxIter() == 20
