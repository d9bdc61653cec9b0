"""ML-11: boosted trees for two classes, the classifier of the one-vs-rest model.

The trees are those of MLlib's ``GBTClassifier``: margins F with P(1) = 1 / (1 + exp(-2 F)),
a first tree of weight 1 on the labels -1 and 1, then trees of weight ``stepSize`` on the
loss's negative gradients, all cut by least squares at the features' values or, where
these are many, quantiles, a leaf holding its rows' mean. MLlib runs Spark jobs for every
level of every tree, so that hundreds of rounds on a small table are nearly all waiting.
Here a table of at most ``TASK_VALUES`` feature values is boosted whole in one task, and
trials, folds and classes run side by side; a larger one is boosted by a Spark job a level,
in which tasks sum histograms and the driver receives one row a node, as in ``boosting``.

``gamma`` is the reference's: the least drop of the log loss, summed over a node's rows,
for which it is cut, here by the second derivative's upper bound. MLlib has only
``minInfoGain``, a mean over the rows, on whose scale the reference's 0 to 5 stops every cut.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondlake.operators.boosting import CUT_ROUNDS, Tree, _drawn, _leaf_of, _values
from pondlake.session import cut_lineage, ship_package

#: Feature values (rows x features) of a table that one task boosts whole; 32 MB.
TASK_VALUES = 4_000_000
#: Open nodes whose histograms are held at once.
NODES = 128


def _subset(strategy: str, width: int) -> int:
    """Features that a node looks at, by MLlib's names."""
    known = {"all": width, "auto": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(max(width, 2)))),
             "onethird": math.ceil(width / 3)}
    if strategy in known:
        return min(known[strategy], width)
    if strategy.isdigit() and int(strategy) >= 1:
        return min(int(strategy), width)
    share = float(strategy)
    if not 0 < share <= 1:
        raise ValueError(f"featureSubsetStrategy {strategy!r}")
    return max(1, math.ceil(share * width))


def _chosen(nodes: np.ndarray, width: int, size: int, key: int) -> np.ndarray:
    """Whether each node looks at each feature, from the node's number and the round's key."""
    with np.errstate(over="ignore"):
        z = (nodes.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return z <= np.partition(z, size - 1, axis=1)[:, size - 1:size]


def _residuals(y: np.ndarray, m: np.ndarray, first: bool) -> np.ndarray:
    """What a round's tree is fitted to, of labels -1 and 1."""
    if first:
        return y.copy()
    with np.errstate(over="ignore"):
        return 4 * y / (1 + np.exp(2 * y * m))


def _loss_scale(first: bool) -> float:
    """Log loss per squared error of the residuals, with the second derivative's upper bound."""
    return 0.5 if first else 0.125


def _cuts(n: np.ndarray, s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drop of the squared error by each cut of (node, feature, bin) histograms of counts and
    sums, and counts and sums left of it; -inf where a side has too few rows or the drop is
    rounding."""
    cn, cs = n.cumsum(axis=2), s.cumsum(axis=2)
    all_n, all_s = cn[:, :, -1:], cs[:, :, -1:]
    cn, cs = cn[:, :, :-1], cs[:, :, :-1]
    rn = all_n - cn
    ok = (cn >= least) & (rn >= least)
    whole = all_s ** 2 / np.maximum(all_n, 1)
    gain = cs * cs / np.maximum(cn, 1) + (all_s - cs) ** 2 / np.maximum(rn, 1) - whole
    gain[~ok | (gain <= 1e-12 + 1e-10 * whole)] = -np.inf
    return gain, cn, cs


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    """The values of a feature if they are few, else its distinct quantiles; NaN left out."""
    v = np.sort(v[~np.isnan(v)])
    few = np.unique(v)
    if len(few) <= bins:
        return few[:bins - 1]
    at = np.ceil(np.arange(1, bins) / bins * len(v)).astype(int) - 1
    return np.unique(v[np.maximum(at, 0)])


def _grow_here(binned: np.ndarray, used: np.ndarray, r: np.ndarray, edges: list[np.ndarray], bins: int, key: int, scale: float,
               depth: int, least: int, size: int, info: float, gamma: float) -> Tree:
    """A tree on the rows ``used``, all of them in this task."""
    width = binned.shape[1]
    tree: Tree = {"feature": [0], "cut": [0.0], "left": [-1], "right": [-1], "value": [0.0]}
    rows, at, ids = used, np.zeros(len(used), np.int64), np.zeros(1, np.int64)
    for level in range(depth + 1):
        k, own = len(ids), r[rows]
        n, s, q = np.bincount(at, minlength=k), np.bincount(at, own, k), np.bincount(at, own * own, k)
        for i, v in zip(ids.tolist(), (s / np.maximum(n, 1)).tolist()):
            tree["value"][i] = v
        spread = q - s * s / np.maximum(n, 1)
        can = (n >= 2 * least) & (scale * spread >= gamma) & (spread > 1e-10 * q)  # no cut gains more than the spread
        if level == depth or not can.any():
            break
        if not can.all():
            kept = can[at]
            rows, at, ids, n = rows[kept], (np.cumsum(can) - 1)[at[kept]], ids[can], n[can]
            own = r[rows]
        if len(ids) > NODES:
            order = np.argsort(at, kind="stable")
            rows, at, own = rows[order], at[order], own[order]
        child = np.full((len(ids), 2), -1, np.int64)  # of each node, where it is cut
        feature, place = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for start in range(0, len(ids), NODES):
            some = ids[start:start + NODES]
            lo, hi = (np.searchsorted(at, [start, start + NODES]) if len(ids) > NODES else (0, len(at)))
            cell = binned[rows[lo:hi]] + ((at[lo:hi] - start) * (width * bins))[:, None]
            shape = (len(some), width, bins)
            count = np.bincount(cell.ravel(), minlength=len(some) * width * bins).reshape(shape)
            total = np.bincount(cell.ravel(), np.repeat(own[lo:hi], width), len(some) * width * bins).reshape(shape)
            gain, _, _ = _cuts(count, total, least)
            if size < width:
                gain[~_chosen(some, width, size, key)] = -np.inf
            gain = gain.reshape(len(some), -1)
            best = gain.argmax(axis=1)
            g = gain[np.arange(len(some)), best]
            cut = (g > 0) & (scale * g >= gamma) & (g >= info * n[start:start + NODES])
            feature[start:start + NODES], place[start:start + NODES] = best // (bins - 1), best % (bins - 1)
            for i in np.flatnonzero(cut):
                node, f, c = int(some[i]), int(feature[start + i]), int(place[start + i])
                new = len(tree["left"])
                tree["feature"][node], tree["cut"][node], tree["left"][node], tree["right"][node] = f, float(edges[f][c]), new, new + 1
                child[start + i] = new, new + 1
                for name, v in (("feature", 0), ("cut", 0.0), ("left", -1), ("right", -1), ("value", 0.0)):
                    tree[name] += [v, v]
        kept = child[at, 0] >= 0
        if not kept.any():
            break
        rows, at = rows[kept], at[kept]
        f = feature[at]
        right = binned[rows, f] - f * bins > place[at]
        to = child[at, right.astype(np.int64)]
        ids = np.sort(child[child >= 0])
        at = np.searchsorted(ids, to)
    return tree


def _boost_here(x: np.ndarray, y: np.ndarray, row: np.ndarray, params: dict) -> list[Tree]:
    """All rounds on a table that is in this task."""
    bins, keys = params["bins"], np.random.default_rng(params["seed"])
    edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") + f * bins for f, e in enumerate(edges)], axis=1)
    m, trees, everyone = np.zeros(len(x)), [], np.arange(len(x))
    for i in range(params["rounds"]):
        key = int(keys.integers(1, 2 ** 62))
        used = np.flatnonzero(_drawn(row, key, params["rate"])) if params["rate"] < 1 else everyone
        tree = _grow_here(binned, used, _residuals(y, m, i == 0), edges, bins, key, _loss_scale(i == 0), params["depth"], params["least"],
                          params["size"], params["info"], params["gamma"])
        if i:
            tree["value"] = [params["step"] * v for v in tree["value"]]
        m += np.asarray(tree["value"])[_leaf_of(tree, x)] if len(tree["left"]) > 1 else tree["value"][0]
        trees.append(tree)
    return trees


def _margin(trees: list[Tree], x: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for tree in trees:
        out += np.asarray(tree["value"])[_leaf_of(tree, x)] if len(tree["left"]) > 1 else tree["value"][0]
    return out


class _LogisticParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, HasSeed):
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins a feature", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "weight of the trees after the first", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows a round", TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features a node looks at", TypeConverters.toString)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows below a cut", TypeConverters.toInt)
    minInfoGain = Param(Params._dummy(), "minInfoGain", "least drop of a node's variance by a cut", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "least drop of the log loss by a cut, over all its rows", TypeConverters.toFloat)

    def getMaxIter(self) -> int:
        return self.getOrDefault(self.maxIter)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)


class LogisticBoosting(Estimator, _LogisticParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for labels 0 and 1. Rows of a null label or null features are left
    out of the fit. NaN goes to the right of every cut. An empty table raises."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", rawPredictionCol="rawPrediction", seed=0,
                 maxIter=20, maxDepth=5, maxBins=32, stepSize=0.1, subsamplingRate=1.0, featureSubsetStrategy="all", minInstancesPerNode=1,
                 minInfoGain=0.0, gamma=0.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", rawPredictionCol="rawPrediction", seed=0,
                         maxIter=20, maxDepth=5, maxBins=32, stepSize=0.1, subsamplingRate=1.0, featureSubsetStrategy="all",
                         minInstancesPerNode=1, minInfoGain=0.0, gamma=0.0)
        self._set(**self._input_kwargs)

    def setParams(self, **params) -> "LogisticBoosting":
        self._set(**params)
        return self

    def _fit(self, dataset: DataFrame) -> "LogisticBoostingModel":
        get = lambda name: self.getOrDefault(getattr(self, name))
        params = {"rounds": get("maxIter"), "depth": get("maxDepth"), "bins": get("maxBins"), "step": get("stepSize"), "rate": get("subsamplingRate"),
                  "least": get("minInstancesPerNode"), "info": get("minInfoGain"),
                  "gamma": get("gamma"), "seed": get("seed")}
        ship_package(dataset.sparkSession)
        given = dataset.select((2 * F.col(get("labelCol")).cast("double") - 1).alias("y"), _values(get("featuresCol")).alias("x")) \
            .filter("y is not null and x is not null").withColumn("row", F.monotonically_increasing_id())
        strategy, most = get("featureSubsetStrategy"), TASK_VALUES
        _subset(strategy, 1)  # an unknown one raises here

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The rounds, or none where the task has seen more than it boosts."""
            held, size = [], 0
            for b in batches:
                if len(b):
                    held.append((np.array(b["x"].tolist(), float), b["y"].to_numpy(), b["row"].to_numpy()))
                    size += held[-1][0].size
                if size > most:
                    break
            trees = None
            if held and size <= most:
                x, y, row = (np.concatenate(v) for v in zip(*held))
                trees = json.dumps(_boost_here(x, y, row, {**params, "size": _subset(strategy, x.shape[1])})) if np.isin(y, (-1, 1)).all() else ""
            yield pd.DataFrame({"values": [size], "trees": [trees]})
        [found] = given.coalesce(1).mapInPandas(fit, "values long, trees string").collect()
        if not found["values"]:
            raise ValueError("no rows to fit on")
        trees = found.trees
        if trees is None:
            given = cut_lineage(given)
            top = given.agg(F.max(F.size("x")).alias("width"), F.bool_and(F.col("y").isin(-1.0, 1.0)).alias("two")).first()
            params["size"] = _subset(strategy, top.width)
            trees = json.dumps(_boost_apart(given, top.width, params)) if top.two else ""
        if not trees:
            raise ValueError("labels are 0 and 1")
        return self._copyValues(LogisticBoostingModel(trees=trees))


def _boost_apart(given: DataFrame, width: int, params: dict) -> list[Tree]:
    """All rounds on a table of any size, a Spark job a level."""
    bins, keys = params["bins"], np.random.default_rng(params["seed"])
    found = given.agg(*[F.percentile_approx(F.nanvl(F.col("x")[i], F.lit(None).cast("double")), [j / bins for j in range(1, bins)], 10_000)
                        .alias(f"q{i}") for i in range(width)]).first()
    edges = [np.unique(np.array(found[i] or [], float)) for i in range(width)]

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's distinct values of each feature, one more than ``bins`` at most."""
        held = [np.empty(0)] * width
        for b in batches:
            x = np.array(b["x"].tolist(), float).reshape(len(b), width)
            held = [v if len(v) > bins else np.union1d(v, x[~np.isnan(x[:, f]), f])[:bins + 1] for f, v in enumerate(held)]
        yield pd.DataFrame({"f": np.repeat(np.arange(width), [len(v) for v in held]), "v": np.concatenate(held)})
    few = given.select("x").mapInPandas(values, "f int, v double").groupBy("f").agg(F.collect_set("v").alias("v")).filter(F.size("v") <= bins)
    for r in few.collect():
        edges[r.f] = np.sort(np.array(r.v))[:bins - 1]
    rows, trees, fresh = given.withColumn("m", F.lit(0.0)), [], []
    for i in range(params["rounds"]):
        tree = _grow_apart(rows, fresh, i == 0, edges, int(keys.integers(1, 2 ** 62)), params)
        if i:
            tree["value"] = [params["step"] * v for v in tree["value"]]
        trees.append(tree)
        fresh.append(tree)
        if len(fresh) == CUT_ROUNDS:
            rows, fresh = cut_lineage(_with_margin(rows, fresh)), []
    return trees


def _with_margin(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["m"] = _margin(trees, np.array(b["x"].tolist(), float), b["m"].to_numpy())
                yield b
    return rows.mapInPandas(add, rows.schema)


def _grow_apart(rows: DataFrame, fresh: list[Tree], first: bool, edges: list[np.ndarray], key: int, params: dict) -> Tree:
    bins, rate, least, width = params["bins"], params["rate"], params["least"], len(edges)
    scale, size = _loss_scale(first), params["size"]
    tree: Tree = {"feature": [0], "cut": [0.0], "left": [-1], "right": [-1], "value": [0.0]}
    names = [f"{s}{b}" for s in "ns" for b in range(bins)]

    def histograms(batches: Iterator[pd.DataFrame], open_nodes: np.ndarray) -> Iterator[pd.DataFrame]:
        for b in batches:
            if rate < 1:
                b = b[_drawn(b["row"].to_numpy(), key, rate)]
            if not len(b):
                continue
            x = np.array(b["x"].tolist(), float)
            at = _leaf_of(tree, x)
            kept = np.flatnonzero(np.isin(at, open_nodes))
            kept = kept[np.argsort(at[kept], kind="stable")]
            if not len(kept):
                continue
            r = _residuals(b["y"].to_numpy(), _margin(fresh, x, b["m"].to_numpy()), first)[kept]
            binned = np.stack([np.searchsorted(e, x[kept, f], side="left") + f * bins for f, e in enumerate(edges)], axis=1)
            present, at = np.unique(at[kept], return_inverse=True)
            for start in range(0, len(present), NODES):
                some = present[start:start + NODES]
                lo, hi = np.searchsorted(at, [start, start + NODES])
                cell = (binned[lo:hi] + ((at[lo:hi] - start) * (width * bins))[:, None]).ravel()
                cells = len(some) * width * bins
                sums = [np.bincount(cell, v, cells).reshape(-1, bins) for v in (None, np.repeat(r[lo:hi], width))]
                out = pd.DataFrame(np.hstack(sums), columns=names)
                out.insert(0, "f", np.tile(np.arange(width, dtype=np.int32), len(some)))
                out.insert(0, "node", np.repeat(some, width).astype(np.int32))
                yield out

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best cut of each (node, feature) and the sums left of it and in all."""
        for b in batches:
            if not len(b):
                continue
            v = b[names].to_numpy()
            n, s = v[:, None, :bins], v[:, None, bins:]
            gain, cn, cs = (a[:, 0] for a in _cuts(n, s, least))
            if size < width:
                mask = _chosen(b["node"].to_numpy(), width, size, key)
                gain[~mask[np.arange(len(b)), b["f"].to_numpy()]] = -np.inf
            c, i = gain.argmax(axis=1), np.arange(len(b))
            yield pd.DataFrame({"node": b["node"], "f": b["f"], "gain": gain[i, c], "c": c, "nl": cn[i, c], "sl": cs[i, c],
                                "n": n[:, 0].sum(axis=1), "s": s[:, 0].sum(axis=1)})

    open_nodes = np.zeros(1, np.int64)
    for level in range(max(params["depth"], 1)):
        sums = rows.mapInPandas(lambda it, nodes=open_nodes: histograms(it, nodes), "node int, f int, " + ", ".join(f"{n} double" for n in names)) \
            .groupBy("node", "f").agg(*[F.sum(n).alias(n) for n in names])
        cuts = sums.mapInPandas(best, "node int, f int, gain double, c int, nl double, sl double, n double, s double") \
            .groupBy("node").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), "c", "nl", "sl", "n", "s")).alias("b"))
        opened = []
        for node, b in sorted(cuts.collect()):  # one row a node of the model
            tree["value"][node] = b.s / b.n
            if params["depth"] == 0 or not (b.gain > 0 and scale * b.gain >= params["gamma"] and b.gain >= params["info"] * b.n):
                continue
            tree["feature"][node], tree["cut"][node] = -b.f, float(edges[-b.f][b.c])
            for side, n, s in (("left", b.nl, b.sl), ("right", b.n - b.nl, b.s - b.sl)):
                tree[side][node] = len(tree["left"])
                opened.append(len(tree["left"]))
                for name, v in (("feature", 0), ("cut", 0.0), ("left", -1), ("right", -1), ("value", s / n)):
                    tree[name].append(v)
        if not opened:
            break  # the last level's values are known from the cuts above it
        open_nodes = np.array(opened)
    return tree


class _Grown:
    """What MLlib's tree models tell of a tree."""

    def __init__(self, tree: Tree):
        self.numNodes = len(tree["left"])
        depth = [0] * self.numNodes
        for node, sides in enumerate(zip(tree["left"], tree["right"])):  # children come after their node
            for side in sides:
                if side >= 0:
                    depth[side] = depth[node] + 1
        self.depth = max(depth)


class LogisticBoostingModel(Model, _LogisticParams, DefaultParamsReadable, DefaultParamsWritable):
    """The margins (-F, F) as ``rawPrediction``, and 1 where F is above 0. Rows of null
    features get nulls."""

    grown = Param(Params._dummy(), "grown", "a tree a round, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees=None):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", rawPredictionCol="rawPrediction")
        if trees is not None:
            self._set(grown=trees)

    @property
    def trees(self) -> list[_Grown]:
        return [_Grown(t) for t in json.loads(self.getOrDefault(self.grown))]

    @property
    def getNumTrees(self) -> int:
        return len(json.loads(self.getOrDefault(self.grown)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        held = self.getOrDefault(self.grown)

        @F.pandas_udf("double")
        def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = json.loads(held)
            for x in batches:
                known, out = x.notna().to_numpy(), np.full(len(x), np.nan)
                if known.any():
                    out[known] = _margin(trees, np.array(x[known].tolist(), float), np.zeros(known.sum()))
                yield pd.Series(out)

        raw, prediction = self.getOrDefault(self.rawPredictionCol), self.getOrDefault(self.predictionCol)
        known = F.col(self.getOrDefault(self.featuresCol)).isNotNull()
        scored = dataset.withColumn(raw, margin(_values(self.getOrDefault(self.featuresCol))))
        scored = scored.withColumn(prediction, F.when(known, (F.col(raw) > 0).cast("double")))
        return scored.withColumn(raw, F.when(known, array_to_vector(F.array(-F.col(raw), F.col(raw)))))
