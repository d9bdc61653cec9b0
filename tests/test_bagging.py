"""Out-of-bag votes: weights, agreement with the hold-out score, odd tables."""

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pondlake.operators import learn as L
from pondlake.operators.bagging import out_of_bag, sample_weight
from tests.test_boosting import _three


def test_weights_are_poisson_and_repeatable(spark):
    df = spark.range(20_000).select(*[sample_weight(F.col("id"), t, 0.7, 5).alias(f"t{t}") for t in (0, 1)])
    m = df.agg(F.avg("t0"), F.var_pop("t0"), F.avg((F.col("t0") == 0).cast("int")), F.corr("t0", "t1")).first()
    assert abs(m[0] - 0.7) < 0.03 and abs(m[1] - 0.7) < 0.05 and abs(m[2] - math.exp(-0.7)) < 0.015 and abs(m[3]) < 0.03


def test_near_the_hold_out_score(spark):
    """Labels flipped at random in a tenth of the rows: out-of-bag sees the true error, the fitted rows do not."""
    noisy = lambda df, key: df.withColumn("label", F.when(
        F.pmod(F.xxhash64(F.col("features").cast("string"), F.lit(key)), F.lit(10)) == 0, (F.col("label") + 1) % 3).otherwise(F.col("label")))
    df, held = noisy(_three(spark), 1), noisy(_three(spark, 800, seed=4), 2)
    params = {"numTrees": 25, "maxDepth": 12}
    got = out_of_bag(df, params, seed=3).cache()
    assert got.count() == df.count() and abs(got.agg(F.avg("oob_trees")).first()[0] / 25 - math.exp(-1)) < 0.03
    score = L.balanced_accuracy(got.filter("oob_prediction is not null"), prediction="oob_prediction").first()[0]
    forest = L.make_model("random_forest", params, weight_col=None).fit(df)
    assert abs(score - L.evaluate(forest, held)) < 0.05
    assert L.evaluate(forest, df) > score + 0.02


def test_nulls_ties_clashing_names_and_empty_tables(spark):
    rows = [(0.0, 1.0, 1.0), (1.0, 9.0, None), (None, 2.0, 1.0), (1.0, None, 1.0)] * 30
    df = spark.createDataFrame(rows, "label double, x double, _Row double").withColumn(
        "features", F.when(F.col("x").isNotNull(), array_to_vector(F.array("x")))).withColumn("_votes", F.lit("own"))
    got = out_of_bag(df, {"numTrees": 6, "maxDepth": 2}, weight_col="_Row").collect()
    assert len(got) == 60 and all(r.oob_prediction in (None, r.label) and r._votes == "own" for r in got)
    assert {r.oob_prediction is None for r in got if r.oob_trees == 0} <= {True}
    assert out_of_bag(df.filter("false"), {"numTrees": 2}).count() == 0
