"""Training operators on Spark ML: stratified split and folds, encoders,
population scaling, exact-median imputing, class weights, balanced accuracy,
tree models and seeded random search.

Every statistic a stage fits (categories, means, deviations, medians, class
counts) is an aggregate computed on the executors; the driver only receives
the small fitted result (one value per column or class).
"""

from __future__ import annotations

import json
import math
import random
import warnings
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondlake.functions.columns import columns_by_type
from pondlake.operators.boosting import SoftmaxBoosting
from pondlake.operators.logistic import LogisticBoosting
from pondlake.operators.ordinal import broadcast_if_bounded, column_medians, join_groups, with_position
from pondlake.operators.search import propose
from pondlake.session import cut_lineage
from pondlake.schema import (BOOSTED_SPACE, CV_SPLITS, FOREST_SPACE, RANDOM_STATE, SEARCH_TRIALS,
                             TEST_SIZE)

SPLIT_COL = "split"
FOLD_COL = "fold"


# --------------------------------------------------------------------------- ML-1 / ML-2


def shuffle_key(id_col: str, seed: int) -> Column:
    """A seeded, engine-independent shuffle order: md5 of ``seed:id``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = TEST_SIZE,
                     seed: int = RANDOM_STATE, folds: int | None = CV_SPLITS) -> DataFrame:
    """ML-1 (+ ML-2): per class, rows in seeded shuffle order; the first
    ``floor(test_size * n + 0.5)`` are ``test``, the rest ``train``.  Train rows
    also get ``fold = (train position) % folds``, so every fold holds within one
    row of the same count per class.

    Exact (not Bernoulli like ``sampleBy``) and skew-safe: positions come from
    the range-partitioned ordinal, not a window over a whole class.
    """
    p = with_position(df, [label], [shuffle_key(id_col, seed), F.col(id_col)],
                      pos_col="_pos", count_col="_n")
    n_test = F.floor(F.lit(float(test_size)) * F.col("_n") + F.lit(0.5))
    is_test = F.col("_pos") < n_test
    out = p.withColumn(SPLIT_COL, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
    if folds:
        out = out.withColumn(FOLD_COL, F.when(~is_test, F.pmod(F.col("_pos") - n_test, F.lit(folds))
                                              .cast("int")))
    return out.drop("_pos", "_n")


# --------------------------------------------------------------------------- ML-3 / ML-4


def _indexers(cols: Sequence[str]) -> list[StringIndexer]:
    return [StringIndexer(inputCol=c, outputCol=f"{c}_index", stringOrderType="alphabetAsc",
                          handleInvalid="keep") for c in cols]


def label_encode(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML-3: ordinal codes from the sorted train categories; unseen or
    missing -> -1."""
    return OrdinalEncoder(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols]).fit(train).transform(df)


class OrdinalEncoder(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable,
                     DefaultParamsWritable):
    """ML-3 as a stage: the code of a category is its place among the sorted
    training categories, -1 if it has none.  Codes are ordinary numbers: the
    output has no nominal metadata, so trees take any number of categories."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "OrdinalEncoderModel":
        model = Pipeline(stages=_indexers(self.getInputCols())).fit(dataset)
        return OrdinalEncoderModel(inputCols=self.getInputCols(), outputCols=self.getOutputCols(),
                                   labels=json.dumps([list(m.labels) for m in model.stages]))


class OrdinalEncoderModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable,
                          DefaultParamsWritable):
    labels = Param(Params._dummy(), "labels", "JSON list of each column's categories in order",
                   typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, labels=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for i, o, own in zip(self.getInputCols(), self.getOutputCols(), json.loads(self.getOrDefault(self.labels))):
            raw = f"__{o}_index"
            indexer = StringIndexerModel.from_labels(own or [""], inputCol=i, outputCol=raw, handleInvalid="keep")
            code = F.when(F.col(raw) == float(len(own or [""])), F.lit(-1.0)).otherwise(F.col(raw))
            out = indexer.transform(out).withColumn(o, code + F.lit(0.0)).drop(raw)
        return out


def one_hot_stages(cols: Sequence[str]) -> list:
    """Indexers with an extra 'unknown' slot, then one-hot with that slot
    dropped: known categories keep their slot, unseen ones are all zeros."""
    enc = OneHotEncoder(inputCols=[f"{c}_index" for c in cols],
                        outputCols=[f"{c}_vec" for c in cols], dropLast=True)
    return [*_indexers(cols), enc]


def one_hot(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML-4 as arrays (dense view of the one-hot vectors)."""
    model = Pipeline(stages=one_hot_stages(cols)).fit(train)
    out = model.transform(df)
    for c in cols:
        out = out.withColumn(f"{c}_vec", vector_to_array(f"{c}_vec")).drop(f"{c}_index")
    return out


# --------------------------------------------------------------------------- ML-6


class _ColumnStats(Params):
    values = Param(Params._dummy(), "values", "fitted value per input column",
                   typeConverter=TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fitted scale per input column",
                   typeConverter=TypeConverters.toListFloat)


class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable,
                       DefaultParamsWritable):
    """ML-6: ``(x - mean) / stddev_pop`` fitted on the training rows (a zero
    deviation divides by 1): the population deviation, not MLlib's sample
    deviation."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PopulationScalerModel":
        cols = self.getInputCols()
        row = dataset.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                          *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        stds = [float(row[f"s{i}"] or 0.0) for i in range(len(cols))]
        return PopulationScalerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                     values=means, scales=[s if s != 0 else 1.0 for s in stds])


class PopulationScalerModel(Model, HasInputCols, HasOutputCols, _ColumnStats,
                            DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, values=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        vals, scales = self.getOrDefault(self.values), self.getOrDefault(self.scales)
        return dataset.withColumns({
            o: (F.col(i).cast("double") - F.lit(m)) / F.lit(s)
            for i, o, m, s in zip(self.getInputCols(), self.getOutputCols(), vals, scales)})


def scale_exprs(train: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """The same scaling as expressions: one aggregate over ``train`` gives
    every mean and deviation (a single materialised row); each statistic is
    then a scalar subquery over that row (no join, nothing collected)."""
    stats = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                      *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)])
    stats = cut_lineage(stats, small=True)
    out = {}
    for i, c in enumerate(cols):
        mean = stats.select(f"m{i}").scalar()
        std = stats.select(f"s{i}").scalar()
        dev = F.when(std == 0, F.lit(1.0)).otherwise(std)
        out[c] = (F.col(c).cast("double") - mean) / dev
    return out


def standard_scale(train: DataFrame, df: DataFrame, cols: Sequence[str],
                   suffix: str = "_scaled") -> DataFrame:
    exprs = scale_exprs(train, cols)
    return df.withColumns({c + suffix: F.round(e, 9) for c, e in exprs.items()})


# --------------------------------------------------------------------------- ML-8


def exact_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median (interpolated on even counts) of each column, nulls and NaN
    ignored: ``(column_name, median)``, in two scans for all columns
    (``ordinal.column_medians``); no column is sorted whole."""
    return column_medians(df, cols)


def approx_medians(df: DataFrame, cols: Sequence[str], accuracy: int = 10000) -> DataFrame:
    """Approximate medians from mergeable quantile sketches (one map-side
    combined aggregate, no sort): rank error about ``n / accuracy``."""
    return df.select(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c)
                       for c in cols]).select(F.inline(F.array(*[
                           F.struct(F.lit(c).alias("column_name"), F.col(c).alias("median"))
                           for c in cols])))


class _HasAccuracy(Params):
    accuracy = Param(Params._dummy(), "accuracy",
                     "0 for exact medians (distributed ranking), else the sketch accuracy",
                     typeConverter=TypeConverters.toInt)


class MedianImputer(Estimator, HasInputCols, HasOutputCols, _HasAccuracy, DefaultParamsReadable,
                    DefaultParamsWritable):
    """ML-8: fill missing values with the training median per column (MLlib
    trees reject NaN; the reference left nulls to the trees).  ``accuracy=0``
    (default) ranks the values exactly; a positive accuracy uses quantile
    sketches instead, which avoids a full sort on very large training sets."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, accuracy=0):
        super().__init__()
        self._setDefault(accuracy=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "MedianImputerModel":
        cols = self.getInputCols()
        acc = self.getOrDefault(self.accuracy)
        medians = exact_medians(dataset, cols) if acc <= 0 else approx_medians(dataset, cols, acc)
        found = {r.column_name: r.median for r in medians.collect()}
        return MedianImputerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                  values=[float(found.get(c) or 0.0) for c in cols])


class MedianImputerModel(Model, HasInputCols, HasOutputCols, _ColumnStats,
                         DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        vals = self.getOrDefault(self.values)
        return dataset.withColumns({
            o: F.coalesce(F.nanvl(F.col(i).cast("double"), F.lit(None).cast("double")), F.lit(v))
            for i, o, v in zip(self.getInputCols(), self.getOutputCols(), vals)})


def impute(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ML-8 as a query: medians joined in as scalar subqueries."""
    med = cut_lineage(exact_medians(train, cols), small=True)   # one row per column
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"),
                      med.filter(F.col("column_name") == c).select("median").scalar())
        for c in cols})


# --------------------------------------------------------------------------- ML-9 / ML-14


def class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """ML-9: balanced weights ``n / (k * n_class)``: one grouped count
    (materialised: one row per class), its total and size as scalar subqueries
    over that small table, joined back on the label after a size check."""
    counts = cut_lineage(df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc")), small=True)
    total = counts.select(F.sum("_nc")).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    w = counts.select(label, (total / (k * F.col("_nc"))).alias(weight_col))
    return join_groups(df, broadcast_if_bounded(w), [label])


def balanced_accuracy(pred: DataFrame, label: str = "label",
                      prediction: str = "prediction") -> DataFrame:
    """ML-14: mean recall over the classes present, as a one-row frame."""
    recall = pred.groupBy(label).agg(
        F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("_r"))
    return recall.agg(F.round(F.avg("_r"), 9).alias("balanced_accuracy"))


class BalancedAccuracyEvaluator(Evaluator):
    """ML-14 as an evaluator: larger is better."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol, self.predictionCol = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        v = balanced_accuracy(dataset, self.labelCol, self.predictionCol).first()[0]
        return float(v) if v is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True


def softmax_log_loss_expr(label: str = "label", raw: str = "rawPrediction") -> Column:
    """Per-row log loss of softmax(rawPrediction) for the true class."""
    arr = vector_to_array(raw)
    mx = F.array_max(arr)
    denom = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx))
    p_true = F.exp(F.element_at(arr, F.col(label).cast("int") + 1) - mx) / denom
    eps = 1e-15
    return -F.log(F.least(F.greatest(p_true, F.lit(eps)), F.lit(1 - eps)))


def softmax_log_loss(pred: DataFrame, label: str = "label", raw: str = "rawPrediction") -> DataFrame:
    """ML-11 metric: mean multi-class log loss of softmax(rawPrediction)."""
    return pred.agg(F.avg(softmax_log_loss_expr(label, raw)).alias("log_loss"))


# --------------------------------------------------------------------------- ML-7 / ML-10..13


def preprocessor(df: DataFrame, encoding: str = "none", scaling: bool = False,
                 features: Sequence[str] | None = None, label: str = "label",
                 exclude: Sequence[str] = ()) -> list:
    """ML-7: stage list: impute numbers, encode text (``none`` / ``label`` /
    ``ohe``), scale numbers if asked, assemble ``features``.  With ``none`` a
    text column raises: the models take numbers only (ML-5)."""
    skip = set(exclude) | {label, SPLIT_COL, FOLD_COL, "weight"}
    cols = [c for c in (features or df.columns) if c not in skip]
    numeric = [c for c in columns_by_type(df.select(*cols), ["numeric"])]
    text = [c for c in columns_by_type(df.select(*cols), ["text"])]
    stages: list = [MedianImputer(inputCols=numeric, outputCols=[f"{c}_imp" for c in numeric])] if numeric else []
    num_out = [f"{c}_imp" for c in numeric]
    if scaling and numeric:
        stages.append(PopulationScaler(inputCols=num_out, outputCols=[f"{c}_std" for c in numeric]))
        num_out = [f"{c}_std" for c in numeric]
    enc_out: list[str] = []
    if encoding == "label":
        if text:
            stages.append(OrdinalEncoder(inputCols=text, outputCols=[f"{c}_code" for c in text]))
        enc_out = [f"{c}_code" for c in text]
    elif encoding == "ohe":
        stages += one_hot_stages(text)
        enc_out = [f"{c}_vec" for c in text]
    elif encoding != "none":
        raise ValueError(f"unknown encoding {encoding!r}")
    elif text:
        raise ValueError(f"text columns {text} need an encoding ('label' or 'ohe')")
    stages.append(VectorAssembler(inputCols=num_out + enc_out, outputCol="features"))
    return stages


MAX_DEPTH = 30  # MLlib's tree depth limit
SOFTMAX_NAMES = {"colsample_bytree": "colsampleByTree", "gamma": "gamma", "reg_alpha": "regAlpha", "reg_lambda": "regLambda"}


def make_model(name: str, params: Mapping | None = None, seed: int = RANDOM_STATE,
               label: str = "label", weight_col: str | None = "weight"):
    """ML-10 / ML-11: ``random_forest`` (gini, balanced weights), ``softmax``
    (boosting on the multinomial log loss) or ``boosted`` (one-vs-rest
    gradient-boosted trees)."""
    params = dict(params or {})
    if name == "random_forest":
        rf = RandomForestClassifier(labelCol=label, featuresCol="features", impurity="gini",
                                    seed=seed, **({"weightCol": weight_col} if weight_col else {}))
        return rf.setParams(**params) if params else rf
    if name == "softmax":
        return SoftmaxBoosting(labelCol=label, featuresCol="features", seed=seed, weightCol=weight_col, **params)
    if name == "boosted":
        return OneVsRest(classifier=LogisticBoosting(labelCol=label, featuresCol="features", seed=seed, **params),
                         labelCol=label, featuresCol="features", parallelism=4)
    raise ValueError(f"unknown model {name!r}")


def map_params(name: str, sampled: Mapping) -> dict:
    """Reference hyper-parameter names -> MLlib parameters (see SURVEY §2.8)."""
    out: dict = {}
    for k, v in sampled.items():
        if name == "softmax" and k in SOFTMAX_NAMES:
            out[SOFTMAX_NAMES[k]] = float(v)
        elif k == "max_features":
            out["featureSubsetStrategy"] = {"sqrt": "sqrt", "log2": "log2", None: "all"}[v]
        elif k == "min_samples_split":
            out["minInstancesPerNode"] = max(1, int(v) // 2)
        elif k in ("max_samples", "subsample"):
            out["subsamplingRate"] = float(v)
        elif k == "max_depth":
            out["maxDepth"] = min(int(v), MAX_DEPTH)
            if int(v) > MAX_DEPTH:
                warnings.warn(f"max_depth {v} is cut to {MAX_DEPTH}, the deepest tree MLlib grows", stacklevel=2)
        elif k == "n_estimators":
            out["numTrees" if name == "random_forest" else "maxIter"] = int(v)
        elif k == "learning_rate":
            out["stepSize"] = float(v)
        elif k == "colsample_bytree":
            out["featureSubsetStrategy"] = str(float(v))
        elif k == "gamma":
            out["gamma" if name == "boosted" else "minInfoGain"] = float(v)
        elif k in ("reg_alpha", "reg_lambda"):
            warnings.warn(f"{k} has no MLlib counterpart and is ignored", stacklevel=2)
        else:
            raise ValueError(f"unknown hyper-parameter {k!r}")
    return out


def sample_space(space: Mapping[str, Mapping], n: int, seed: int = RANDOM_STATE) -> list[dict]:
    """ML-12: ``n`` seeded draws: Integer (inclusive), Real (uniform or
    log-uniform) and Categorical."""
    rng = random.Random(seed)
    draws = []
    for _ in range(n):
        d = {}
        for k, s in space.items():
            t = s["type"]
            if t == "Integer":
                d[k] = rng.randint(int(s["low"]), int(s["high"]))
            elif t == "Real":
                lo, hi = float(s["low"]), float(s["high"])
                if s.get("prior") == "log-uniform":
                    d[k] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
                else:
                    d[k] = rng.uniform(lo, hi)
            elif t == "Categorical":
                d[k] = rng.choice(list(s["categories"]))
            else:
                raise ValueError(f"unknown space type {t!r}")
        draws.append(d)
    return draws


SPACES = {"random_forest": FOREST_SPACE, "boosted": BOOSTED_SPACE, "softmax": BOOSTED_SPACE}


def tune(train: DataFrame, stages: list, model_name: str, space: Mapping | None = None, n_iter: int = SEARCH_TRIALS,
         folds: int = CV_SPLITS, seed: int = RANDOM_STATE, label: str = "label",
         parallelism: int = 2, search: str = "random"):
    """ML-13: ``n_iter`` trials x ``folds`` folds on the ``fold`` column, best by
    balanced accuracy, refit on all train rows.  ``search`` is ``random`` (seeded
    draws) or ``bayes`` (each trial proposed from the scores of those before,
    ``search.propose``; its folds run side by side).  ``space`` defaults to the
    model's own (``schema``).  The train rows are written by one checkpoint, so that
    folds don't split them again and the trees' many short tasks don't carry the
    split's plan.  Preprocessing is fitted once per fold, and the columns that the
    model reads are written by a checkpoint, so that the plans of the trials' hundreds
    of jobs don't carry every feature's imputing, and kept while trials need them.

    Returns ``(best PipelineModel, best reference-named params, trial table)``."""
    est = make_model(model_name, seed=seed, label=label,
                     weight_col="weight" if "weight" in train.columns else None)
    space = SPACES[model_name] if space is None else space
    if search not in ("random", "bayes"):
        raise ValueError(f"unknown search {search!r}")
    target = est.getClassifier() if isinstance(est, OneVsRest) else est

    def mapped(draw: Mapping) -> dict:
        return {target.getParam(k): v for k, v in map_params(model_name, draw).items()}

    evaluator = BalancedAccuracyEvaluator(labelCol=label)
    train = cut_lineage(train)
    read = [label, "features", *(c for c in ("weight",) if c in train.columns)]

    def parts(fold: int) -> tuple[DataFrame, DataFrame]:
        fit_rows, held = train.filter(F.col(FOLD_COL) != fold), train.filter(F.col(FOLD_COL) == fold)
        prep = Pipeline(stages=stages).fit(fit_rows)
        return tuple(cut_lineage(prep.transform(part).select(*read)).persist(StorageLevel.MEMORY_AND_DISK) for part in (fit_rows, held))

    def score(pm: dict, fit_rows: DataFrame, held: DataFrame) -> float:
        return evaluator.evaluate(_with_params(est, pm).fit(fit_rows).transform(held))

    if search == "bayes" and n_iter:
        draws, scores, ready = [], [], [parts(fold) for fold in range(folds)]
        with ThreadPool(max(1, parallelism)) as pool:
            for _ in range(n_iter):
                draws.append(propose(space, draws, scores, seed))
                pm = mapped(draws[-1])
                scores.append(sum(pool.map(lambda p: score(pm, *p), ready)) / folds)
        trials = [mapped(d) for d in draws]
        for fit_rows, held in ready:
            fit_rows.unpersist()
            held.unpersist()
    else:
        draws = sample_space(space, n_iter, seed)
        trials = [mapped(d) for d in draws] or [{}]
        scores = [0.0] * len(trials)
        for fold in range(folds):
            fit_rows, held = parts(fold)
            with ThreadPool(max(1, parallelism)) as pool:
                for i, v in enumerate(pool.imap(lambda pm: score(pm, fit_rows, held), trials)):
                    scores[i] += v / folds
            fit_rows.unpersist()
            held.unpersist()
    best = max(range(len(trials)), key=lambda i: scores[i])
    prep = Pipeline(stages=stages).fit(train)
    model = _with_params(est, trials[best]).fit(prep.transform(train))
    return PipelineModel([*prep.stages, model]), draws[best] if draws else {}, list(zip(draws, scores))


def _with_params(est, params: dict):
    """A copy of the estimator with the given parameters. Those of a one-vs-rest model are
    its classifier's, to which its own ``copy`` passes them; a classifier among the
    parameters would be overwritten by that copy."""
    return est.copy(params)


def evaluate(model, test: DataFrame, label: str = "label") -> float:
    """ML-15: balanced accuracy of ``model`` on the held-out rows."""
    v = balanced_accuracy(model.transform(test), label).first()[0]
    return float(v) if v is not None else float("nan")


def train_table(df: DataFrame, label: str, id_col: str, model_name: str, space: Mapping | None = None,
                encoding: str = "none", scaling: bool = False, n_iter: int = SEARCH_TRIALS,
                folds: int = CV_SPLITS, seed: int = RANDOM_STATE, test_size: float = TEST_SIZE,
                parallelism: int = 2, search: str = "random"):
    """ML-16: split -> weights -> preprocessor -> tuned model -> hold-out score.

    Returns ``(model, params, test balanced accuracy)``."""
    if label not in df.columns:
        raise ValueError(f"target column {label!r} not found")
    data = df.withColumn("label", F.col(label).cast("double"))
    if label != "label":
        data = data.drop(label)
    split = stratified_split(data, "label", id_col, test_size, seed, folds)
    train = class_weights(split.filter(F.col(SPLIT_COL) == "train"), "label")
    test = split.filter(F.col(SPLIT_COL) == "test")
    stages = preprocessor(train, encoding, scaling, exclude=[id_col])
    model, params, _ = tune(train, stages, model_name, space, n_iter, folds, seed,
                            parallelism=parallelism, search=search)
    return model, params, evaluate(model, test)
