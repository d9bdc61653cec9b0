"""Learning queries (PRJ-11, AGG-3 weights, ML-1..4, ML-6, ML-8, ML-9, ML-14)
over fixture D (documents joined to labels) and X."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pondlake.fixtures import E_SENSORS, dirty_readings, labelled_documents, table
from pondlake.functions.columns import target_split
from pondlake.functions.parse import lenient_numeric
from pondlake.operators import learn as L
from pondlake.operators.bagging import out_of_bag
from pondlake.plans.catalog import register
from pondlake.plans.queries_ingest import LENIENT_NUM, X
from pondlake.schema import BOOSTED_SPACE, CV_SPLITS, FOREST_SPACE, RANDOM_STATE, SEARCH_TRIALS, TEST_SIZE

D = f"""d AS (
  SELECT dd.doc_id, dd.n_chars, dd.lang, dd.source, l.quality
  FROM documents dd JOIN labels l ON dd.doc_id = l.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY quality
                               ORDER BY md5('{RANDOM_STATE}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos,
         count(*) OVER (PARTITION BY quality) AS n
  FROM d),
counted AS (SELECT *, CAST(floor(CAST({TEST_SIZE} AS DOUBLE) * n + 0.5) AS BIGINT) AS n_test FROM ranked),
labelled AS (
  SELECT doc_id, n_chars, lang, source, quality,
         CASE WHEN pos < n_test THEN 'test' ELSE 'train' END AS split,
         CASE WHEN pos >= n_test THEN CAST((pos - n_test) % {CV_SPLITS} AS INTEGER) END AS fold
  FROM counted),
train AS (SELECT * FROM labelled WHERE split = 'train')"""


def _split(spark, sf):
    return L.stratified_split(labelled_documents(spark, sf), "quality", "doc_id")


def _train(split):
    return split.filter(F.col(L.SPLIT_COL) == "train")


@register("target_split", "WITH " + D + "\nSELECT doc_id, n_chars, lang, source FROM d")
def q_target_split(spark, sf):
    features, _ = target_split(labelled_documents(spark, sf), "quality")
    return features


@register("stratified_split", "WITH " + D + "\nSELECT doc_id, quality, split FROM labelled")
def q_stratified_split(spark, sf):
    return _split(spark, sf).select("doc_id", "quality", "split")


@register("stratified_folds", "WITH " + D + "\nSELECT doc_id, quality, fold FROM train")
def q_stratified_folds(spark, sf):
    return _train(_split(spark, sf)).select("doc_id", "quality", "fold")


def _cats(col: str) -> str:
    return f"""cats_{col} AS (
  SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS idx
  FROM (SELECT DISTINCT {col} FROM train WHERE {col} IS NOT NULL))"""


@register("label_encode", "WITH " + D + ",\n" + _cats("lang") + ",\n" + _cats("source") + """
SELECT l.*, coalesce(CAST(a.idx AS DOUBLE), -1.0) AS lang_idx,
       coalesce(CAST(b.idx AS DOUBLE), -1.0) AS source_idx
FROM labelled l LEFT JOIN cats_lang a ON l.lang = a.v LEFT JOIN cats_source b ON l.source = b.v""")
def q_label_encode(spark, sf):
    split = _split(spark, sf)
    return L.label_encode(_train(split), split, ["lang", "source"])


@register("one_hot", "WITH " + D + ",\n" + _cats("lang") + """
SELECT l.doc_id, l.lang,
       list_transform(range((SELECT count(*) FROM cats_lang)),
                      lambda i: CAST(CASE WHEN i = a.idx THEN 1 ELSE 0 END AS DOUBLE)) AS lang_vec
FROM labelled l LEFT JOIN cats_lang a ON l.lang = a.v""")
def q_one_hot(spark, sf):
    split = _split(spark, sf)
    return L.one_hot(_train(split), split.select("doc_id", "lang"), ["lang"])


@register("standard_scale", "WITH " + D + """,
st AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM train)
SELECT l.doc_id, l.n_chars,
       round((CAST(l.n_chars AS DOUBLE) - st.m) / CASE WHEN st.s = 0 THEN 1.0 ELSE st.s END, 9)
         AS n_chars_scaled
FROM labelled l, st""")
def q_standard_scale(spark, sf):
    split = _split(spark, sf)
    return L.standard_scale(_train(split), split.select("doc_id", "n_chars"), ["n_chars"])


@register("impute", "WITH " + X + f""",
typed AS ({LENIENT_NUM}),
med AS (SELECT median(value) AS mv, median(k) AS mk FROM typed)
SELECT pond_id, created_at, entry_id, coalesce(value, med.mv) AS value, coalesce(k, med.mk) AS k,
       event_id
FROM typed, med""")
def q_impute(spark, sf):
    typed = lenient_numeric(dirty_readings(spark, sf), E_SENSORS)
    return L.impute(typed, typed, E_SENSORS)


@register("class_weights", "WITH " + D + """,
c AS (SELECT quality, count(*) AS nc FROM d GROUP BY quality),
tot AS (SELECT sum(nc) AS n, count(*) AS k FROM c)
SELECT d.*, tot.n / (tot.k * c.nc) AS weight FROM d JOIN c USING (quality), tot""")
def q_class_weights(spark, sf):
    return L.class_weights(labelled_documents(spark, sf), "quality")


@register("balanced_accuracy", """
SELECT round(avg(r), 9) AS balanced_accuracy FROM (
  SELECT l.quality, avg(CASE WHEN 1 - l.toxic = l.quality THEN 1.0 ELSE 0.0 END) AS r
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality)""")
def q_balanced_accuracy(spark, sf):
    # a rule read from the tables as the predictor: "good unless toxic"
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels")
    pred = docs.join(labels, "doc_id").select(
        F.col("quality").alias("label"), (F.lit(1) - F.col("toxic")).alias("prediction"))
    return L.balanced_accuracy(pred)


# Smaller trees than the default spaces: the queries are run at every scale.
SMALL_FOREST = {**FOREST_SPACE, "max_depth": {"type": "Integer", "low": 3, "high": 8},
                "n_estimators": {"type": "Integer", "low": 10, "high": 20}}


@register("train_forest", "WITH " + D + """
SELECT doc_id, CAST(quality AS DOUBLE) AS label, TRUE AS valid FROM labelled WHERE split = 'test'""")
def q_train_forest(spark, sf):
    """ML-16: tuned forest over all labelled documents; every hold-out row with
    its label, and whether its prediction is a class."""
    df = labelled_documents(spark, sf)
    data = df.withColumn("label", F.col("quality").cast("double")).drop("quality")
    split = L.stratified_split(data, "label", "doc_id")
    train = L.class_weights(_train(split), "label")
    test = split.filter(F.col(L.SPLIT_COL) == "test")
    stages = L.preprocessor(train, "label", False, exclude=["doc_id"])
    model, _, _ = L.tune(train, stages, "random_forest", SMALL_FOREST, n_iter=2, folds=CV_SPLITS)
    return model.transform(test).select("doc_id", "label", F.col("prediction").isin(0.0, 1.0).alias("valid"))


@register("forest_out_of_bag", "WITH " + D + """
SELECT doc_id, CAST(quality AS DOUBLE) AS label, TRUE AS valid FROM labelled WHERE split = 'train'""")
def q_forest_out_of_bag(spark, sf):
    """ML-10: out-of-bag votes on all labelled training documents; every row with its
    label, and whether its prediction is a class just where a tree did not see it."""
    data = labelled_documents(spark, sf).withColumn("label", F.col("quality").cast("double")).drop("quality")
    train = L.class_weights(_train(L.stratified_split(data, "label", "doc_id")), "label")
    rows = Pipeline(stages=L.preprocessor(train, "label", False, exclude=["doc_id"])).fit(train).transform(train)
    voted = out_of_bag(rows, {"numTrees": 10, "maxDepth": 5}, seed=RANDOM_STATE, weight_col="weight")
    known = F.coalesce(F.col("oob_prediction").isin(0.0, 1.0), F.lit(False))
    return voted.select("doc_id", "label", (known == (F.col("oob_trees") > 0)).alias("valid"))


_BOOSTED_SQL = f"""
ranked AS (
  SELECT vec_id, label % 3 AS label, row_number() OVER (PARTITION BY label % 3
           ORDER BY md5('{RANDOM_STATE}:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS pos,
         count(*) OVER (PARTITION BY label % 3) AS n
  FROM embeddings)
SELECT vec_id, CAST(label AS DOUBLE) AS label, TRUE AS valid FROM ranked
WHERE pos < CAST(floor(CAST({TEST_SIZE} AS DOUBLE) * n + 0.5) AS BIGINT)"""


@register("train_boosted", "WITH " + _BOOSTED_SQL)
def q_train_boosted(spark, sf):
    """ML-11: one-vs-rest boosted trees on all embeddings, their labels folded to
    three classes, searched by all trials of the reference's whole space; every hold-out row with its label, and whether its
    prediction is a class with a finite log loss."""
    emb = table(spark, sf, "embeddings")
    dims = 64
    data = emb.select("vec_id", (F.col("label") % 3).cast("double").alias("label"),
                      *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(dims)])
    split = L.stratified_split(data, "label", "vec_id")
    train = _train(split)
    test = split.filter(F.col(L.SPLIT_COL) == "test")
    stages = L.preprocessor(train, "none", False, exclude=["vec_id"])
    model, _, _ = L.tune(train, stages, "boosted", BOOSTED_SPACE, n_iter=SEARCH_TRIALS, folds=CV_SPLITS)
    loss = L.softmax_log_loss_expr("label", "rawPrediction")
    return model.transform(test).select(
        "vec_id", "label", (F.col("prediction").isin(0.0, 1.0, 2.0) & (loss >= 0) & (loss < 40)).alias("valid"))


@register("train_softmax", "WITH " + _BOOSTED_SQL)
def q_train_softmax(spark, sf):
    """ML-11: boosting on the softmax loss, L1 and L2 penalties and sampling on, on the
    rows of ``train_boosted``; every hold-out row with its label, and whether its
    prediction is a class with a finite log loss."""
    data = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).cast("double").alias("label"),
                                                 *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    split = L.stratified_split(data, "label", "vec_id")
    train, test = _train(split), split.filter(F.col(L.SPLIT_COL) == "test")
    params = L.map_params("softmax", {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.3, "subsample": 0.9, "colsample_bytree": 0.8,
                                      "reg_alpha": 0.1, "reg_lambda": 1.0, "gamma": 0.0})
    stages = L.preprocessor(train, "none", False, exclude=["vec_id"])
    model = Pipeline(stages=[*stages, L.make_model("softmax", params, weight_col=None)]).fit(train)
    loss = L.softmax_log_loss_expr("label", "rawPrediction")
    return model.transform(test).select(
        "vec_id", "label", (F.col("prediction").isin(0.0, 1.0, 2.0) & (loss >= 0) & (loss < 40)).alias("valid"))


@register("softmax_log_loss", """
WITH s AS (
  SELECT vec_id, label % 3 AS label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b,
         CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
e AS (SELECT *, greatest(a, b, c) AS m FROM s),
p AS (
  SELECT vec_id, exp(CASE label WHEN 0 THEN a WHEN 1 THEN b ELSE c END - m) / (exp(a - m) + exp(b - m) + exp(c - m)) AS p
  FROM e)
SELECT vec_id, round(-ln(least(greatest(p, 1e-15), 1 - 1e-15)), 9) AS log_loss FROM p""")
def q_softmax_log_loss(spark, sf):
    """ML-11's metric row by row, on scores read from the embeddings."""
    emb = table(spark, sf, "embeddings")
    scores = F.array(*[F.col("embedding")[i].cast("double") for i in range(3)])
    pred = emb.select("vec_id", (F.col("label") % 3).cast("double").alias("label"),
                      array_to_vector(scores).alias("rawPrediction"))
    return pred.select("vec_id", F.round(L.softmax_log_loss_expr("label", "rawPrediction"), 9).alias("log_loss"))
