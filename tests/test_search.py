"""Bayesian search: against random search on seeded objectives, in ``tune``, odd scores."""

import math

import pytest
from pyspark.sql import functions as F

from pondlake.fixtures import labelled_documents
from pondlake.operators import learn as L
from pondlake.operators.search import propose
from tests.conftest import SF_SMALL

SPACE = {"rate": {"type": "Real", "low": 1e-3, "high": 1.0, "prior": "log-uniform"},
         "share": {"type": "Real", "low": 0.0, "high": 1.0},
         "depth": {"type": "Integer", "low": 1, "high": 20},
         "kind": {"type": "Categorical", "categories": ["a", "b", None]}}


def _objective(p):
    return (-(math.log10(p["rate"]) + 1.5) ** 2 - 4 * (p["share"] - 0.3) ** 2 - ((p["depth"] - 13) / 10) ** 2
            + (0.5 if p["kind"] is None else 0.0))


def _search(seed, n=25):
    points, scores = [], []
    for _ in range(n):
        points.append(propose(SPACE, points, scores, seed))
        scores.append(_objective(points[-1]))
    return points, scores


def test_beats_random_search():
    """On every one of ten seeds' means and most seeds; all points lie in the space."""
    ours, random_ = [], []
    for seed in range(10):
        points, scores = _search(seed)
        ours.append(max(scores))
        random_.append(max(map(_objective, L.sample_space(SPACE, 25, seed))))
        for p in points:
            assert 1e-3 <= p["rate"] <= 1 and 0 <= p["share"] <= 1 and p["depth"] in range(1, 21) and p["kind"] in ("a", "b", None)
    assert sum(ours) > sum(random_) and sum(a > b for a, b in zip(ours, random_)) >= 8
    assert sum(ours) / 10 > 0.4  # the best there is: 0.5


def test_same_trials_same_point_and_odd_scores():
    assert _search(3, 8) == _search(3, 8)
    points = L.sample_space(SPACE, 6, 1)
    for scores in ([math.nan] * 6, [1.0] * 6, [0.1, math.nan, 0.2, -math.inf, 0.2, 0.2]):
        assert set(propose(SPACE, points, scores, 1)) == set(SPACE)
    same = points[:1] * 8  # the same trial again and again
    assert set(propose(SPACE, same, [0.5] * 8, 1)) == set(SPACE)
    with pytest.raises(ValueError):
        propose({"x": {"type": "Odd", "low": 0, "high": 1}}, [], [], 1)


def test_tune_by_bayes(spark):
    df = labelled_documents(spark, SF_SMALL).withColumn("label", F.col("quality").cast("double")).drop("quality")
    split = L.stratified_split(df, "label", "doc_id", folds=2)
    train = L.class_weights(split.filter("split = 'train'"), "label")
    space = {"max_depth": {"type": "Integer", "low": 1, "high": 4}, "n_estimators": {"type": "Integer", "low": 2, "high": 5}}
    model, params, trials = L.tune(train, L.preprocessor(train, "label", exclude=["doc_id"]), "random_forest", space, n_iter=5, folds=2,
                                   search="bayes")
    assert len(trials) == 5 and params in [d for d, _ in trials] and max(s for _, s in trials) == dict(
        (str(d), s) for d, s in trials)[str(params)]
    assert model.transform(train).filter("prediction is null").count() == 0
    with pytest.raises(ValueError):
        L.tune(train, [], "random_forest", space, search="grid")
