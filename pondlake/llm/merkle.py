"""Merkle manifest of a dataset: leaves, inner nodes, and a proof for every row.

Rows are numbered once, by range partitions, inside their group (a third of all
rows in one group spans many partitions). Then each round is a slot pivot:
conditional aggregates spread the children of one ancestor into fanout columns,
concatenating the columns of a parent hashes it, and for each child the columns
but its own are its siblings. A round covers ``STEP`` levels at a time, so its
columns are the descendants of one ancestor ``STEP`` levels up; a task meets the
few children of a parent, never a group. On the way down each child receives its
siblings followed by those of its ancestors, as one run of 32-byte digests.

The group roots are the leaves of one more tree, built by the same rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pondlake.llm.common import Scratch, fresh, sized_join

FANOUT = 2
#: Descendants that one round spreads into columns, at most.
SLOTS = 8
DIGEST = 32


def leaf_text(columns: Sequence[Column]) -> Column:
    """The columns one after the other: ``-`` for null, else byte count, ``:`` and value."""
    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.concat(*[one(c) for c in columns])


def digest(text: Column) -> Column:
    """The 32 bytes of SHA-256; ``hexed`` writes them as text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def _parent(children: Sequence[Column]) -> Column:
    """The digest over the children that are there, each as hex text."""
    return digest(F.concat(*[F.coalesce(hexed(c), F.lit("")) for c in children]))


def numbered(scratch: Scratch, rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with column ``name``: their dense position from 0 by ``order``.

    Range partitions are sorted and written; a partition's offset is the sum of the
    row counts before it, one row a partition. Rows equal in ``order`` are dealt
    over partitions by a row number, so that no tie lands in one task.
    """
    tie, part, at, first = (fresh([*rows.columns, name], x) for x in ("_tie", "_part", "_place", "_before"))
    tied = rows.withColumn(tie, F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, F.col(tie))
    kept = scratch.write(ranged.drop(tie).withColumn(part, F.spark_partition_id())
                         .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy(part).agg(F.count("*").alias("n"))
    offsets = scratch.write(sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)))
    return sized_join(kept, offsets, [part], "inner", 16).select(*rows.columns, (F.col(first) + F.col(at)).alias(name))


def _steps(fanout: int) -> int:
    step = 1
    while fanout ** (step + 1) <= SLOTS:
        step += 1
    return step


def tree(scratch: Scratch, leaves: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(roots, paths) of the trees over ``leaves``: ``grp, idx`` (dense from 0 in
    its group), ``width`` (leaves of the group) and ``node`` (digest).

    ``roots`` holds ``grp, node``. ``paths`` holds ``grp, idx, siblings``: the
    digests of all siblings from the leaf's level upward, left to right.
    """
    step = _steps(fanout)
    slots = fanout ** step
    pivots, level = [], leaves
    while not level.filter("width > 1").isEmpty():
        slot = F.col("idx") % slots
        spread = level.groupBy("grp", F.floor(F.col("idx") / slots).cast("long").alias("up")).agg(
            F.first("width").alias("w0"), *[F.max(F.when(slot == s, F.col("node"))).alias(f"c0_{s}") for s in range(slots)])
        for k in range(step):
            spread = spread.select("*", F.ceil(F.col(f"w{k}") / F.lit(fanout)).cast("long").alias(f"w{k + 1}"), *[
                _above([F.col(f"c{k}_{i}") for i in range(p * fanout, (p + 1) * fanout)], F.col(f"w{k}")).alias(f"c{k + 1}_{p}")
                for p in range(fanout ** (step - k - 1))])
        pivots.append(scratch.write(spread))
        level = pivots[-1].select("grp", F.col("up").alias("idx"), F.col(f"w{step}").alias("width"), F.col(f"c{step}_0").alias("node"))
    paths = level.select("grp", "idx", F.lit(b"").alias("siblings"))
    for table in reversed(pivots):
        met = table.join(paths.withColumnsRenamed({"grp": "_g", "idx": "_i"}),
                         (F.col("grp") == F.col("_g")) & (F.col("up") == F.col("_i")))
        child = F.explode(F.filter(F.array(*[
            F.struct((F.col("up") * slots + s).alias("idx"), F.col(f"c0_{s}").isNotNull().alias("there"),
                     F.concat(*_siblings(s, fanout, step), "siblings").alias("siblings")) for s in range(slots)]), lambda x: x["there"]))
        paths = met.select("grp", child.alias("x")).select("grp", "x.idx", "x.siblings")
    return level.select("grp", "node"), paths


def _above(run: list[Column], width: Column) -> Column:
    """The parent of a run of children; a level of which the group has one node is
    its root, and nothing is hashed above it."""
    return F.when(run[0].isNotNull(), F.when(width > 1, _parent(run)).otherwise(run[0]))


def _siblings(slot: int, fanout: int, step: int) -> list[Column]:
    """Of one pivoted row, the columns beside a slot's own at each level, lowest first."""
    out = []
    for k in range(step):
        own = slot // fanout ** k
        first = own - own % fanout
        out += [F.coalesce(F.col(f"c{k}_{i}"), F.lit(b"")) for i in range(first, first + fanout) if i != own]
    return out


def fold(start: Column, position: Column, width: Column, siblings: Column, fanout: int = FANOUT) -> Column:
    """The root recomputed from a leaf digest, its place among ``width`` leaves and
    its siblings; at each level the own digest stands among its siblings by place."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fanout
    levels = F.filter(F.array(*[F.lit(x).cast("long") for x in powers]), lambda x: x < width)
    zero = F.struct(start.alias("node"), F.lit(0).cast("int").alias("at"), position.cast("long").alias("idx"), width.cast("long").alias("width"))

    def up(state: Column, _: Column) -> Column:
        own = state["idx"] % fanout
        others = (F.least(F.lit(fanout).cast("long"), state["width"] - state["idx"] + own) - 1).cast("int")
        before = F.substring(siblings, state["at"] + 1, (own * DIGEST).cast("int"))
        after = F.substring(siblings, state["at"] + 1 + (own * DIGEST).cast("int"), (others - own.cast("int")) * DIGEST)
        return F.struct(digest(F.concat(hexed(before), hexed(state["node"]), hexed(after))).alias("node"),
                        (state["at"] + others * DIGEST).alias("at"),
                        F.floor(state["idx"] / fanout).cast("long").alias("idx"),
                        F.ceil(state["width"] / fanout).cast("long").alias("width"))

    return F.aggregate(levels, zero, up)["node"]


def manifest(rows: DataFrame, leaf: str, group: str, order: str, fanout: int = FANOUT) -> tuple[DataFrame, str]:
    """``rows`` with the proof of each in the tree over ``leaf`` (a digest column), and
    the proof's column name, one that no given column has.

    Leaves stand by ``group`` (null first), then ``order`` (null first), then their
    digest; equal rows are equal leaves, each with its own place. The proof is a
    struct: ``position, width`` (place and leaves in the group), ``group_position,
    groups`` (place of the group and number of groups), ``subroot, root``,
    ``siblings`` (up to the subroot) and ``group_siblings`` (from there to the root),
    all digests as bytes. An empty table gives an empty result.
    """
    given = rows.columns
    name = fresh(given, "proof")
    scratch = Scratch(rows.sparkSession, "merkle")
    rows = rows.select(F.struct(*given).alias("row"), F.col(leaf).alias("leaf"), F.col(group).alias("group"), F.col(order).alias("order"))
    leaf, group, order, at, key, lead = "leaf", "group", "order", "_at", "_grp", "_lead"
    ordered = numbered(scratch, rows, [F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first(), F.col(leaf)], at)
    groups = scratch.write(ordered.groupBy(group).agg(F.min(at).alias(lead), F.count("*").alias("width")))
    placed = scratch.write(sized_join(ordered, groups, [group], "inner", 256)
                           .withColumn(key, F.col(lead)).withColumn("position", F.col(at) - F.col(lead)).drop(at, lead))
    roots, paths = tree(scratch, placed.select(F.col(key).alias("grp"), F.col("position").alias("idx"), "width", F.col(leaf).alias("node")), fanout)
    # group roots in the order of their groups: a group's key is the place of its first leaf
    tops = numbered(scratch, scratch.write(roots), [F.col("grp")], "idx")
    tops = scratch.write(tops)
    width = F.lit(tops.count()).cast("long")
    root, over = tree(scratch, tops.select(F.lit(0).cast("long").alias("grp"), "idx", width.alias("width"), "node"), fanout)
    over = over.select(F.col("idx").alias("group_position"), F.col("siblings").alias("group_siblings"))
    top = root.first()
    head = scratch.write(tops.join(over, F.col("idx") == F.col("group_position")).select(
        F.col("grp").alias(key), "group_position", width.alias("groups"), F.col("node").alias("subroot"),
        F.lit(bytes(top["node"]) if top else None).cast("binary").alias("root"), "group_siblings"))
    met = placed.join(paths, (F.col(key) == F.col("grp")) & (F.col("position") == F.col("idx")))
    full = sized_join(met, head, [key], "inner", 160 + 64 * DIGEST * (fanout - 1))
    parts = ("position", "width", "group_position", "groups", "subroot", "root", "siblings", "group_siblings")
    return full.select("row.*", F.struct(*parts).alias(name)), name


def verify(leaf: Column, proof: str, fanout: int = FANOUT) -> Column:
    """The root folded from a leaf digest along the proof of its row."""
    p = F.col(proof)
    return fold(fold(leaf, p["position"], p["width"], p["siblings"], fanout),
                p["group_position"], p["groups"], p["group_siblings"], fanout)
