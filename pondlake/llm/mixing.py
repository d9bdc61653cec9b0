"""Mixing sources to target weights by subset-sum budget fitting.

Targets: every source has a weight; the budget (a share of all words) is dealt
by weight, at most ``most_epochs`` times a source's size, the excess to the
others by weight. A source takes each of its documents as often as whole epochs
fit; the remaining budget is met by a subset of its documents. Documents are
counted by exact length; the bulk of the subset is a share of each length's
count, rounded by seeded hashes, and the last part of the budget is a bounded
knapsack over the counts left, solved by dynamic programming on the set of
reachable sums. Of each length, the documents with the least seeded hashes go in.

Only (source, length, count) rows enter the fit, one group per source, bounded by
the number of distinct lengths. To choose documents of a length, hash ranges are
counted first and only the range at the border is ranked, so a length shared by
a third of all rows is ranked in many small parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pondlake.llm.common import WS, Scratch, fresh, keep_rows, sized_join, text_key, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
#: The knapsack's budget: the bulk leaves about this many words to it.
WINDOW = 16_384
#: Documents of one source and length that are ranked together.
RANKED = 500


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS[1:-1]}]+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """``source, source_size, target`` for rows of ``source, size``.

    Sources by code point, null last, take the weights in turn. The level L at
    which sum(min(most_epochs * size, weight * L)) is the budget is found from
    running sums over the sources in order of the level at which each is full:
    one row per source, no rows of documents.
    """
    w = [float(x) for x in weights]
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, w)), (
        (F.row_number().over(order) - 1) % len(w) + 1).cast("int")))
    cap = most_epochs * F.col("source_size")
    whole = Window.partitionBy()
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("cap", cap).withColumn("budget", share * F.sum("source_size").over(whole))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(0, Window.unboundedFollowing)
    # the level if all sources before this one are full and this one and those after it are not
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                         / F.sum("weight").over(rest))
    per = per.withColumn("place", F.row_number().over(full)).withColumn("fits", F.col("weight") * F.col("level") <= F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(whole)
    target = F.least("cap", F.coalesce(F.col("weight") * level["level"], F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def _fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that they sum to the largest reachable
    total not over ``budget``: sums as bits of one integer, counts in binary parts."""
    take = np.zeros(len(lengths), np.int64)
    items, sums, mask = [], [1], (1 << (budget + 1)) - 1
    for i in np.argsort(lengths, kind="stable"):
        size = int(lengths[i])
        left = min(int(counts[i]), budget // size if size else 0)
        k = 1
        while left > 0:
            k = min(k, left)
            grown = sums[-1] | (sums[-1] << (k * size)) & mask
            if grown != sums[-1]:
                items.append((i, k))
                sums.append(grown)
            left -= k
            k *= 2
        if sums[-1] == mask or sums[-1] >> budget & 1:
            break
    at = sums[-1].bit_length() - 1
    for (i, k), before in zip(reversed(items), reversed(sums[:-1])):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """Documents to take of each length (ascending), at most its count, summing to about
    ``budget`` (exactly, if the knapsack reaches it)."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    rng = np.random.default_rng(seed)
    bulk = budget - WINDOW if budget > 4 * WINDOW else 0
    take = np.minimum(counts, np.floor(counts * (bulk / max(total, 1)) + rng.random(len(counts))).astype(np.int64))
    left = budget - int((lengths * take).sum())
    low = WINDOW // 2 if budget > 4 * WINDOW else 0
    while not low <= left <= 4 * WINDOW:  # what rounding has left over: single documents, long ones first
        if left < low:
            there = np.flatnonzero((take > 0) & (lengths > 0))
            near = there[lengths[there] <= WINDOW - left]
            i = near[-1] if len(near) else there[0]
            n = max(1, min(int(take[i]), (low - left) // int(lengths[i])))
            take[i] -= n
            left += n * int(lengths[i])
        else:
            there = np.flatnonzero((take < counts) & (lengths > 0) & (lengths <= left - low))
            if not len(there):
                break
            i = there[-1]
            n = max(1, min(int(counts[i] - take[i]), (left - 2 * WINDOW) // int(lengths[i])))
            take[i] += n
            left -= n * int(lengths[i])
    return take + _fill(lengths, counts - take, left) if left > 0 else take


_PLAN = "source string, size long, full long, take long, n long"


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The fit of one source; rows are its lengths."""
    pdf = pdf.sort_values("size", kind="stable")
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    source_size, target = int(pdf["source_size"].iloc[0]), Fraction(float(pdf["target"].iloc[0]))
    full = int(target // source_size) if source_size else 0
    budget = round(target) - full * source_size
    take = fit(lengths, counts, budget, int(pdf["seed"].iloc[0])) if budget > 0 else np.zeros(len(counts), np.int64)
    return pd.DataFrame({"source": pdf["source"], "size": lengths, "full": full, "take": take, "n": counts})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = 1.5, most_epochs: float = 2.0, seed: int = 17,
        scratch: Scratch | None = None, named: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken, text_key``.

    ``size`` counts words (runs without ASCII white space; null text 0); ``taken``
    is ``size`` times the copies the mix takes, none more than ``most_epochs``
    rounded up. A null source is a source of its own, last in order. Rows alike in
    id, source and text are interchangeable. An empty table gives none. ``named`` is
    the key of a text where the caller needs another than its digest.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    name = F.col(source_col).cast("string")
    key = text_key(F.col(text_col)) if named is None else named
    # rows alike in all that counts are one row with their number, so no draw is shared by more than one
    alike = docs.select(F.col(id_col).alias("doc_id"), name.alias("source"), words_in(text_or_empty(text_col)).alias("size"),
                        key.alias("text_key")).groupBy("doc_id", "source", "size", "text_key").agg(F.count("*").alias("copies"))
    rows = scratch.write(alike.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source", "text_key"), F.lit(2**31))))
    counted = scratch.write(rows.groupBy("source", "size").agg(F.sum("copies").alias("n")))
    goal = scratch.write(targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most_epochs))
    fitted = sized_join(counted, goal, ["source"], "inner", 64) \
        .withColumn("seed", F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(2**31)))
    plan = scratch.write(fitted.groupBy("source").applyInPandas(_plan, T._parse_datatype_string(_PLAN)))

    # the hash range of each document; ranges hold about RANKED documents of a length
    plan = plan.withColumn("ranges", F.ceil(F.col("n") / RANKED).cast("long"))
    known = sized_join(rows, plan.drop("n"), ["source", "size"], "inner", 64)
    known = known.withColumn("range", F.floor(F.col("draw") * F.col("ranges") / F.lit(2**31)).cast("long"))
    split = known.filter("ranges > 1").groupBy("source", "size", "range").agg(F.sum("copies").alias("here"), F.first("take").alias("take"))
    upto = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    split = scratch.write(split.withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))
                          .select("source", "size", "range", (F.col("take") - F.col("before")).alias("want"), "here"))
    one = known.filter("ranges = 1").withColumn("want", F.col("take")).withColumn("here", F.col("ranges") * RANKED + 1)
    many = sized_join(known.filter("ranges > 1"), split, ["source", "size", "range"], "inner", 64)
    both = one.unionByName(many)
    ranked = both.filter("want > 0 and want < here")
    order = Window.partitionBy("source", "size", "range").orderBy("draw", "doc_id", "text_key")
    earlier = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("extra", F.greatest(F.lit(0), F.least("copies", F.col("want") - earlier)))
    sure = both.filter("not (want > 0 and want < here)").withColumn("extra", F.when(F.col("want") > 0, F.col("copies")).otherwise(0))
    out = sized_join(ranked.unionByName(sure), goal, ["source"], "inner", 64)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    times = F.col("full") + (F.col("copy") <= F.col("extra")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "text_key")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The documents the mix takes, each as often as it is taken, all columns unchanged.

    Rows alike in id, source and text are one document, taken as often as all of them;
    rows that differ in source are documents of their own.
    """
    scratch, spent = Scratch(docs.sparkSession, "mixed"), Scratch(docs.sparkSession, "mix")
    source = F.col(source_col).cast("string")
    named = text_key(F.concat(F.coalesce(F.concat(F.octet_length(source).cast("string"), F.lit(":"), source), F.lit("-")),
                              text_or_empty(text_col)))
    taken = mix(docs, id_col, text_col, source_col, scratch=spent, named=named, **settings)
    times = scratch.write(taken.select(
        "doc_id", "text_key", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int").alias("times")))
    spent.clear()
    verdict = times.select("doc_id", "text_key", (F.col("times") > 0).alias("kept"))
    kept = keep_rows(docs, verdict, id_col, text_col, named=named)
    more = scratch.write(times.groupBy("doc_id", "text_key").agg(F.sum("times").alias("times")).filter("times > 1"))
    key, n, i = (fresh(docs.columns, x) for x in ("_key", "_times", "_copy"))
    kept = kept.withColumn(key, named)
    more = more.select(F.col("doc_id").alias(id_col), F.col("text_key").alias(key), F.col("times").alias(n))
    kept = sized_join(kept, more, [id_col, key], "left", 64)
    copies = F.explode(F.sequence(F.lit(1), F.coalesce(F.col(n), F.lit(1)).cast("int")))
    return kept.withColumn(i, copies).select(*docs.columns)
