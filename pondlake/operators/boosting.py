"""ML-11: gradient boosting on the softmax loss, with L1 and L2 penalties.

Each round grows one tree a class on the gradients ``w (p - y)`` and the second
derivatives ``w p (1 - p)`` of the multinomial log loss. Features are cut at their
quantiles once. A level of all the round's trees is one Spark job: tasks turn their
Arrow batches into histograms of (class, node, feature), an aggregate with map-side
combine sums them, the best cut of every node is taken in the cluster, and the driver
receives one row a node, which is what the model itself holds. Rows carry their
margins; the trees of at most ``CUT_ROUNDS`` rounds are applied on the fly, then the
margins are written by a checkpoint, so a lost executor repeats that much and no more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondlake.session import cut_lineage, ship_package

#: Rounds whose trees are applied on the fly before the margins are written.
CUT_ROUNDS = 10

#: A tree: per node the feature, the cut (left if at most), the children (-1: a leaf), the value.
Tree = dict[str, list]


def _leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The node at which each row of ``x`` ends."""
    feature, cut, left, right = (np.asarray(tree[k]) for k in ("feature", "cut", "left", "right"))
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        inner = left[node] >= 0
        if not inner.any():
            return node
        below = x[rows, feature[node]] <= cut[node]
        node = np.where(inner, np.where(below, left[node], right[node]), node)


def _margins(rounds: list[list[Tree]], x: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += np.asarray(tree["value"])[_leaf_of(tree, x)]
    return out


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _drawn(row: np.ndarray, key: int, rate: float) -> np.ndarray:
    """Whether each row is in the round's sample, from its number and the round's key."""
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return z < np.uint64(min(rate, 1.0) * (2 ** 64 - 1025))


def _values(features: str) -> Column:
    return F.when(F.col(features).isNotNull(), vector_to_array(features))


class _BoostingParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasRawPredictionCol, HasSeed):
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "shrinkage of leaf values", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows a round", TypeConverters.toFloat)
    colsampleByTree = Param(Params._dummy(), "colsampleByTree", "share of features a tree", TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "L1 penalty on leaf values", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty on leaf values", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "least gain of a cut", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least sum of second derivatives below a cut", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins a feature", TypeConverters.toInt)


class SoftmaxBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees on the multinomial log loss; labels are 0, 1, ..., k-1.

    Rows of a null label or null features are left out of the fit. A null weight
    counts 1. NaN goes to the right of every cut. An empty table raises."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, predictionCol="prediction",
                 rawPredictionCol="rawPrediction", seed=0, maxIter=100, maxDepth=6, stepSize=0.3, subsamplingRate=1.0,
                 colsampleByTree=1.0, regAlpha=0.0, regLambda=1.0, gamma=0.0, minChildWeight=1.0, maxBins=32):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", rawPredictionCol="rawPrediction",
                         seed=0, maxIter=100, maxDepth=6, stepSize=0.3, subsamplingRate=1.0, colsampleByTree=1.0, regAlpha=0.0,
                         regLambda=1.0, gamma=0.0, minChildWeight=1.0, maxBins=32)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setParams(self, **params) -> "SoftmaxBoosting":
        self._set(**params)
        return self

    def _fit(self, dataset: DataFrame) -> "SoftmaxBoostingModel":
        get = lambda name: self.getOrDefault(getattr(self, name))
        ship_package(dataset.sparkSession)
        weight = F.coalesce(F.col(get("weightCol")).cast("double"), F.lit(1.0)) if self.isSet(self.weightCol) else F.lit(1.0)
        given = dataset.select(F.col(get("labelCol")).cast("int").alias("y"), weight.alias("w"),
                               _values(get("featuresCol")).alias("x")).filter("y is not null and x is not null")
        given = cut_lineage(given.withColumn("row", F.monotonically_increasing_id()))
        top = given.agg(F.max("y"), F.min("y"), F.max(F.size("x"))).first()
        if top[0] is None:
            raise ValueError("no rows to fit on")
        if top[1] < 0:
            raise ValueError("labels are 0, 1, ..., k-1")
        classes, width, bins = max(top[0] + 1, 2), top[2], get("maxBins")
        shares = [i / bins for i in range(1, bins)]
        found = given.agg(*[F.percentile_approx(F.nanvl(F.col("x")[i], F.lit(None).cast("double")), shares, 10_000).alias(f"q{i}")
                            for i in range(width)]).first()
        edges = [sorted(set(found[i] or [])) for i in range(width)]

        rng = np.random.default_rng(get("seed"))
        rows = given.withColumn("m", F.array_repeat(F.lit(0.0), classes))
        done: list[list[Tree]] = []
        fresh: list[list[Tree]] = []  # rounds that are not in the margins of ``rows``
        for _ in range(get("maxIter")):
            key = int(rng.integers(1, 2 ** 62))
            size = max(1, round(get("colsampleByTree") * width))
            masks = np.zeros((classes, width), bool)
            for k in range(classes):
                masks[k, rng.permutation(width)[:size]] = True
            trees = self._grow(rows, fresh, edges, masks, key, get)
            done.append(trees)
            fresh.append(trees)
            if len(fresh) == CUT_ROUNDS:
                rows, fresh = cut_lineage(_with_margins(rows, fresh)), []
        return self._copyValues(SoftmaxBoostingModel(trees=json.dumps({"classes": classes, "rounds": done})))

    def _grow(self, rows: DataFrame, fresh: list[list[Tree]], edges: list[list[float]], masks: np.ndarray, key: int, get) -> list[Tree]:
        """One tree a class, level by level; ``value`` is what a row in the node gets."""
        bins, classes, rate = get("maxBins"), len(masks), get("subsamplingRate")
        alpha, penalty, least, gamma, step = (get(k) for k in ("regAlpha", "regLambda", "minChildWeight", "gamma", "stepSize"))
        trees: list[Tree] = [{"feature": [0], "cut": [0.0], "left": [-1], "right": [-1], "value": [0.0]} for _ in range(classes)]
        names = [f"{s}{b}" for s in "gh" for b in range(bins)]

        def histograms(batches: Iterator[pd.DataFrame], open_nodes: list[list[int]]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if rate < 1:
                    batch = batch[_drawn(batch["row"].to_numpy(), key, rate)]
                if not len(batch):
                    continue
                x = np.array(batch["x"].tolist(), float)
                p = _softmax(_margins(fresh, x, np.array(batch["m"].tolist(), float)))
                w, y = batch["w"].to_numpy(), batch["y"].to_numpy()
                binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
                for k in range(classes):
                    place = np.full(len(trees[k]["left"]), -1)
                    place[open_nodes[k]] = range(len(open_nodes[k]))
                    at = place[_leaf_of(trees[k], x)]
                    use = at >= 0
                    if not use.any():
                        continue
                    g, h = (w * (p[:, k] - (y == k)))[use], (w * p[:, k] * (1 - p[:, k]))[use]
                    chosen = np.flatnonzero(masks[k])
                    cell = (at[use][:, None] * len(chosen) + np.arange(len(chosen))) * bins + binned[use][:, chosen]
                    cells = len(open_nodes[k]) * len(chosen) * bins
                    sums = [np.bincount(cell.ravel(), np.repeat(v, len(chosen)), cells).reshape(-1, bins) for v in (g, h)]
                    out = pd.DataFrame(np.hstack(sums), columns=names)
                    out.insert(0, "f", np.tile(chosen, len(open_nodes[k])).astype(np.int32))
                    out.insert(0, "node", np.repeat(open_nodes[k], len(chosen)).astype(np.int32))
                    out.insert(0, "k", np.int32(k))
                    yield out

        def shrunk(g: np.ndarray) -> np.ndarray:
            return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)

        def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
            return shrunk(g) ** 2 / np.maximum(h + penalty, 1e-12)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The best cut of each (class, node, feature) and the sums left of it and in all."""
            for b in batches:
                v = b[names].to_numpy()
                g, h = np.cumsum(v[:, :bins], axis=1), np.cumsum(v[:, bins:], axis=1)
                ga, ha = g[:, -1:], h[:, -1:]
                gain = 0.5 * (score(g, h) + score(ga - g, ha - h) - score(ga, ha)) - gamma
                limit = np.array([len(edges[f]) for f in b["f"]])[:, None]
                gain[(np.arange(bins) >= limit) | (h < least) | (ha - h < least)] = -np.inf
                c = gain.argmax(axis=1)
                i = np.arange(len(b))
                yield pd.DataFrame({"k": b["k"], "node": b["node"], "f": b["f"], "gain": gain[i, c], "c": c, "gl": g[i, c], "hl": h[i, c],
                                    "g": ga[:, 0], "h": ha[:, 0]})

        open_nodes = [[0] for _ in range(classes)]
        for depth in range(get("maxDepth") + 1):
            level = rows.mapInPandas(lambda it, nodes=open_nodes: histograms(it, nodes),
                                     "k int, node int, f int, " + ", ".join(f"{n} double" for n in names))
            sums = level.groupBy("k", "node", "f").agg(*[F.sum(n).alias(n) for n in names])
            cuts = sums.mapInPandas(best, "k int, node int, f int, gain double, c int, gl double, hl double, g double, h double")
            cuts = cuts.groupBy("k", "node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), "c", "gl", "hl", "g", "h")).alias("b"))
            open_nodes = [[] for _ in range(classes)]
            value = lambda g, h: float(-step * shrunk(np.float64(g)) / max(h + penalty, 1e-12))
            for r in sorted(cuts.collect(), key=lambda r: (r.k, r.node)):  # one row a node of the model
                tree, b = trees[r.k], r.b
                tree["value"][r.node] = value(b.g, b.h)
                if depth == get("maxDepth") or not b.gain > 0:
                    continue
                tree["feature"][r.node], tree["cut"][r.node] = -b.f, edges[-b.f][b.c]
                for side, g, h in (("left", b.gl, b.hl), ("right", b.g - b.gl, b.h - b.hl)):
                    tree[side][r.node] = len(tree["left"])
                    open_nodes[r.k].append(len(tree["left"]))
                    for name, v in (("feature", 0), ("cut", 0.0), ("left", -1), ("right", -1), ("value", value(g, h))):
                        tree[name].append(v)
            if not any(open_nodes) or depth + 1 == get("maxDepth"):
                break  # the last level's values are known from the cuts above it
        return trees


def _with_margins(rows: DataFrame, rounds: list[list[Tree]]) -> DataFrame:
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["m"] = list(_margins(rounds, np.array(b["x"].tolist(), float), np.array(b["m"].tolist(), float)))
                yield b
    return rows.mapInPandas(add, rows.schema)


class SoftmaxBoostingModel(Model, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Margins of all classes (``rawPrediction``), and the class of the greatest, the
    least of equal ones. Rows of null features get nulls."""

    trees = Param(Params._dummy(), "trees", "classes and rounds of trees, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees=None):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", rawPredictionCol="rawPrediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        held = json.loads(self.getOrDefault(self.trees))
        classes, rounds = held["classes"], held["rounds"]

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            known = x.notna().to_numpy()
            rows = np.array(x[known].tolist(), float).reshape(known.sum(), -1)
            found = iter(_margins(rounds, rows, np.zeros((len(rows), classes))) if len(rows) else [])
            return pd.Series([next(found) if k else None for k in known], dtype=object)

        raw, prediction = self.getOrDefault(self.rawPredictionCol), self.getOrDefault(self.predictionCol)
        scored = dataset.withColumn(raw, margins(_values(self.getOrDefault(self.featuresCol))))
        best = F.array_position(F.col(raw), F.array_max(F.col(raw))).cast("double") - 1
        return scored.withColumn(prediction, best).withColumn(raw, F.when(F.col(raw).isNotNull(), array_to_vector(F.col(raw))))
