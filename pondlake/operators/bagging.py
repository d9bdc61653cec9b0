"""ML-10: out-of-bag predictions of a random forest.

MLlib does not say which rows a tree has seen. Here each tree's sample is a seeded
Poisson weight a row, an expression of the row's number, so that it can be told again
later: a tree is fitted on the rows of positive weight and votes on those of weight 0.
Trees are grown a few at a time and add their votes to the rows in one pass, which is
written by a checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondlake.session import cut_lineage

#: Trees that vote in one pass over the rows.
TREES_A_PASS = 20


def _unused(columns: Sequence[str], base: str) -> str:
    """A column name that none of ``columns`` has (Spark compares without case)."""
    while base.lower() in {c.lower() for c in columns}:
        base += "_"
    return base


def sample_weight(row: Column, tree: int, rate: float, seed: int) -> Column:
    """How often a tree's sample holds a row: Poisson of mean ``rate``, from the row's
    number, the tree and the seed alone."""
    u = F.pmod(F.xxhash64(row, F.lit(seed), F.lit(tree)), F.lit(1 << 53)) / float(1 << 53)
    term, total, steps = math.exp(-rate), 0.0, []
    for k in range(1, 20):
        total += term
        steps.append(total)
        term *= rate / k
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))


def _times(values: Column, k: int) -> Column:
    return F.size(F.filter(values, lambda v: F.coalesce(v == k, F.lit(False))))


def out_of_bag(train: DataFrame, params: Mapping | None = None, seed: int = 42, label: str = "label",
               features: str = "features", weight_col: str | None = None, parallelism: int = 4) -> DataFrame:
    """The rows of ``train`` with ``oob_prediction``, the class that most trees vote for
    which did not see the row (of equal ones the least; null if every tree saw it), and
    ``oob_trees``, how many these are.

    ``params`` are MLlib parameters of a forest (``numTrees``, ``subsamplingRate``,
    ``maxDepth``, ...). Labels are 0, 1, ..., k-1; rows of a null label or null features
    are left out. An empty table gives no rows."""
    params = dict(params or {})
    trees, rate = int(params.pop("numTrees", 20)), float(params.pop("subsamplingRate", 1.0))
    params.setdefault("featureSubsetStrategy", "sqrt")
    row, votes, weight = (_unused(train.columns, c) for c in ("_row", "_votes", "_weight"))
    seen = [_unused(train.columns, f"_tree{i}") for i in range(TREES_A_PASS)]
    rows = train.filter(F.col(label).isNotNull() & F.col(features).isNotNull()).withColumn(row, F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    top = rows.agg(F.max(label)).first()[0]
    classes = int(top or 0) + 1
    rows = rows.withColumn(votes, F.array_repeat(F.lit(0), classes))
    given = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)

    def grow(tree: int):
        sample = rows.withColumn(weight, given * sample_weight(F.col(row), tree, rate, seed)).filter(F.col(weight) > 0)
        est = RandomForestClassifier(labelCol=label, featuresCol=features, weightCol=weight, numTrees=1, bootstrap=False,
                                     subsamplingRate=1.0, seed=seed + tree, impurity="gini").setParams(**params)
        # a sample of nothing votes for nothing
        return None if sample.isEmpty() else est.fit(sample)

    for first in range(0, trees if top is not None else 0, TREES_A_PASS):
        numbers = range(first, min(first + TREES_A_PASS, trees))
        with ThreadPool(max(1, parallelism)) as pool:
            models = [(t, m) for t, m in zip(numbers, pool.map(grow, numbers)) if m is not None]
        voted = rows
        for name, (_, model) in zip(seen, models):
            voted = model.setPredictionCol(name).setRawPredictionCol("").setProbabilityCol("").transform(voted)
        cast = F.array(*[F.when(sample_weight(F.col(row), t, rate, seed) == 0, F.col(name)) for name, (t, _) in zip(seen, models)])
        counts = F.array(*[F.col(votes)[k] + _times(cast, k) for k in range(classes)])
        rows = cut_lineage(voted.withColumn(votes, counts).select(*rows.columns))
    total = F.aggregate(votes, F.lit(0), lambda a, b: a + b)
    best = (F.array_position(F.col(votes), F.array_max(F.col(votes))) - 1).cast("double")
    return rows.select(*train.columns, F.when(total > 0, best).alias("oob_prediction"), total.alias("oob_trees"))
