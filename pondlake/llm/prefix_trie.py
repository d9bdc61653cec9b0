"""Trie of conversation prefixes, built as a burst trie.

A trie head stands for a prefix and holds a container: the suffixes of the
conversations that begin with it. All heads of a round are sized by one aggregate
with map-side combine. A container with more than ``LIMIT`` suffixes or
``LIMIT_TURNS`` turns bursts: its head first takes in the turns that all its
suffixes share (the common prefix of their least and greatest), then each next
turn id becomes a head with a container of its own. Containers that remain are
dealt to shards by their head; a task sorts the suffixes of its shard and sweeps
them once into nodes, keeping only the open path. The subtree sums of burst heads
come from the heads below, one aggregate a round, last round first.

So a group of any number of equal conversations is one shared path, and the most a
task sorts of one container is ``LIMIT`` suffixes. A turn is named by 16 bytes of
the SHA-256 of its role and text; no text leaves the first stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pondlake.llm.common import Scratch, sized_join

LIMIT = 4096
LIMIT_TURNS = 1 << 18
#: Suffixes that a shard holds, about.
PER_SHARD = 1 << 14
_TURNS = "array<struct<id:binary,bytes:int>>"
ROOT = b""
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


def turn_lists(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as name and bytes of text.

    Order is by turn, null first; equal turns by role, then text. A null role or text is empty. Rows without a
    conversation id belong to no conversation and are left out. One conversation is one row, of about 60 bytes a turn.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by = F.coalesce(F.col(role).cast("string"), F.lit(""))
    named = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), by.alias("_role"), said.alias("_text"),
        F.octet_length(said).alias("bytes"),
        F.substring(F.unhex(F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said).cast("binary"), 256)), 1, 16).alias("id"))
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    placed = named.select("conv_id", F.row_number().over(order).alias("place"), "id", "bytes")
    listed = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "bytes"))).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(lists: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Each conversation with its first h turns taken from the first conversation of
    its group: h = crc32(decimal id) mod (most + 1), the group's first id is
    id - id mod ``group``. Fewer are taken where that one has fewer, none where it is absent."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    own = lists.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = lists.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    met = own.join(heads, "base", "left")
    borrowed = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr(f"cast(array() as {_TURNS})"))
    return met.select("conv_id", F.concat(borrowed, F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns"))


def _shared(lo: Column, hi: Column) -> Column:
    """How many first turns two suffixes share."""
    unequal = F.array_position(F.zip_with(F.transform(lo, lambda t: t["id"]), F.transform(hi, lambda t: t["id"]),
                                          lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(unequal == 0, F.size(lo)).otherwise(unequal - 1).cast("int")


def _ids_sha(scratch: Scratch, ended: DataFrame) -> DataFrame:
    """``head, ends_sha256`` of ``head, conv_id``: the digest of the decimal ids, ascending, comma-joined.

    Ids are sorted by range partitions and joined there into strings of at most
    ``LIMIT`` ids, so a head with a third of all conversations costs its digest's
    task few rows, which it reads in order and feeds to one running digest.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, convs = batch.column("head").to_pylist(), batch.column("conv_id").to_pylist()
            out, first = [[], [], []], 0
            for k in range(1, len(heads) + 1):
                if k == len(heads) or heads[k] != heads[first] or k - first == LIMIT:
                    out[0].append(heads[first])
                    out[1].append(convs[first])
                    out[2].append(",".join(map(str, convs[first:k])))
                    first = k
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                             names=["head", "least", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, [[], []]
        for batch in batches:
            for head, ids in zip(batch.column("head").to_pylist(), batch.column("ids").to_pylist()):
                if state is None or head != now:
                    if state is not None:
                        done[0].append(now)
                        done[1].append(state.hexdigest())
                    now, state = head, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state is not None:
            done[0].append(now)
            done[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["head", "ends_sha256"])

    joined = ended.repartitionByRange("head", "conv_id").sortWithinPartitions("head", "conv_id") \
                  .mapInArrow(chunks, "head binary, least long, ids string")
    return scratch.write(joined).repartition("head").sortWithinPartitions("head", "least") \
                  .mapInArrow(digests, "head binary, ends_sha256 string")


def _sweep(rows: list[tuple[list[bytes], list[int], int]], depth: int, out: list[list]) -> tuple[int, int, int, list[int]]:
    """Sweep one container into ``out``; return its head's children, leaves below,
    saved sum below and the conversations that end at the head.

    ``rows`` are (turn ids, bytes, conversation); nodes are appended in the order in
    which they close, so the smallest member of a parent is filled in last.
    """
    rows.sort(key=lambda r: (r[0], r[2]))
    # an open node: least member, bytes, members, children, leaves, saved, ended, rows of its children
    path: list[list] = [[None, 0, 0, 0, 0, 0, [], []]]

    def close() -> None:
        least, size, n, kids, leaves, saved, ended, below = path.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * size
        for row in below:
            row[2] = least
        row = [least, depth + len(path), None, n, kids, leaves, saved,
               hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()]
        out.append(row)
        up = path[-1]
        up[3] += 1
        up[4] += leaves
        up[5] += saved
        up[7].append(row)

    before: list[bytes] = []
    for ids, sizes, conv in rows:
        k, most = 0, min(len(before), len(ids))
        while k < most and before[k] == ids[k]:
            k += 1
        while len(path) > k + 1:
            close()
        for size in sizes[k:]:
            path.append([conv, size, 0, 0, 0, 0, [], []])
        for node in path[1:]:
            node[2] += 1
            node[0] = min(node[0], conv)
        path[-1][6].append(conv)
        before = ids
    while len(path) > 1:
        close()
    head = path[0]
    return head[3], head[4], head[5], head[6]


_SWEPT = "head binary, " + NODE


def _swept(rows: DataFrame, shards: int) -> DataFrame:
    """Nodes of all containers in ``rows`` (``head, depth, head_conv, conv_id, turns``); the row of depth
    -1 of a head sums up its container."""
    def shard(group: pa.Table) -> pa.Table:
        held: dict[bytes, list] = {}
        about: dict[bytes, tuple[int, int]] = {}
        for head, depth, least, conv, turns in zip(*[group.column(c).to_pylist() for c in ("head", "depth", "head_conv", "conv_id", "turns")]):
            held.setdefault(head, []).append(([t["id"] for t in turns], [t["bytes"] for t in turns], conv))
            about[head] = depth, least
        columns: list[list] = [[] for _ in range(9)]
        for head, own in held.items():
            out: list[list] = []
            depth, least = about[head]
            kids, leaves, saved, ended = _sweep(own, depth, out)
            for row in out:
                if row[2] is None:
                    row[2] = least
            out.append([None, -1, None, None, kids, leaves, saved,
                        hashlib.sha256(",".join(map(str, sorted(ended))).encode()).hexdigest()])
            columns[0] += [head] * len(out)
            for column, values in zip(columns[1:], zip(*out)):
                column += values
        kinds = [pa.binary(), *[pa.int64()] * 7, pa.string()]
        names = ["head", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("head"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(shard, _SWEPT)


def trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie over ``conv_id, turns`` (distinct, non-null ids).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. A conversation without turns ends at the root. An empty table has no nodes.
    """
    scratch = Scratch(sequences.sparkSession, "trie")
    # head: the trie head whose container holds the suffix; conversations enter at the root
    rows = scratch.write(sequences.select(F.lit(ROOT).alias("head"), F.lit(0).cast("long").alias("depth"), "conv_id", "turns"))
    parent_of = None
    rounds: list[DataFrame] = []
    nodes: list[DataFrame] = []
    first = True
    while not rows.isEmpty():
        sized = rows.groupBy("head", "depth").agg(
            F.count("*").alias("n"), F.sum(F.size("turns").cast("long")).alias("turns_in"), F.min("conv_id").alias("least"),
            F.min("turns").alias("lo"), F.max("turns").alias("hi"))
        bursts = (F.col("n") > LIMIT) | ((F.col("turns_in") > LIMIT_TURNS) & (F.col("n") > 1))
        if first:
            entry = sized.select("*", F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("parent_conv"),
                                 F.lit(0).alias("bytes"))
        else:
            entry = sized.join(parent_of, "head")
        heads = scratch.write(entry.withColumn("burst", bursts).withColumn("path", F.when(F.col("burst"), F.slice(
            "lo", F.lit(1), _shared(F.col("lo"), F.col("hi")))).otherwise(F.expr(f"cast(array() as {_TURNS})"))).select(
            "head", "depth", "n", "least", "parent", "parent_conv", "burst",
            F.concat(F.array("bytes"), F.transform("path", lambda t: t["bytes"])).alias("sizes")))
        rounds.append(heads)
        placed = sized_join(rows, heads.select("head", "burst", F.col("least").alias("head_conv"), (F.size("sizes") - 1).alias("taken")),
                            ["head"], "inner", 96)
        # containers that stay
        count = heads.filter("not burst").agg(F.sum("n")).first()[0] or 0
        swept = scratch.write(_swept(placed.filter("not burst").select("head", "depth", "head_conv", "conv_id", "turns"),
                                     max(1, -(-count // PER_SHARD))))
        nodes.append(swept)
        # containers that burst: suffixes after the head's own path
        rest = placed.filter("burst").select(
            "head", (F.col("depth") + F.col("taken")).alias("depth"), "conv_id", "head_conv",
            F.expr("slice(turns, taken + 1, greatest(size(turns) - taken, 0))").alias("turns"))
        next_turn = F.col("turns")[0]
        below = scratch.write(rest.filter(F.size("turns") > 0).select(
            F.substring(F.unhex(F.sha2(F.concat(F.col("head"), F.lit(b"/"), next_turn["id"]), 256)), 1, 16).alias("head"),
            (F.col("depth") + 1).alias("depth"), "conv_id", F.expr("slice(turns, 2, size(turns) - 1)").alias("turns"),
            F.col("head").alias("parent"), F.col("head_conv").alias("parent_conv"), next_turn["bytes"].alias("bytes")))
        ended = _ids_sha(scratch, rest.filter(F.size("turns") == 0).select("head", "conv_id"))
        rounds[-1] = (heads, scratch.write(ended))
        parent_of = below.select("head", "parent", "parent_conv", "bytes").distinct()
        rows, first = below.select("head", "depth", "conv_id", "turns"), False
    return _summed(scratch, rounds, nodes)


def _summed(scratch: Scratch, rounds: list[tuple[DataFrame, DataFrame]], swept: list[DataFrame]) -> DataFrame:
    """All nodes, those of burst heads with the sums of the heads below them."""
    out, below, counts = None, None, ["n_children", "n_leaves", "saved_tokens"]
    for (heads, ended), nodes in reversed(list(zip(rounds, swept))):
        sums = nodes.filter("depth = -1").select("head", *counts, "ends_sha256")
        if below is None:
            below = ended.select("head", *[F.lit(0).cast("long").alias(c) for c in counts]).filter("false")
        # a burst head may have heads below it, conversations that end at it, or both
        both = below.join(ended, "head", "full").na.fill(0, counts)
        sums = sums.unionByName(both)
        none = hashlib.sha256(b"").hexdigest()
        full = scratch.write(heads.join(sums, "head").select(
            "head", "depth", "n", "least", "parent", "parent_conv", "sizes", "n_children",
            F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), "saved_tokens",
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
        # the nodes of a head's own path, first to last
        at = full.select("*", F.posexplode("sizes").alias("k", "size"))
        last = F.col("k") == F.size("sizes") - 1
        onward = F.sum("size").over(Window.partitionBy("head").orderBy(F.desc("k")))
        own = at.select(
            F.col("least").alias("conv_id"), (F.col("depth") + F.col("k")).alias("depth"),
            F.when(F.col("k") == 0, F.col("parent_conv")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
            (F.col("saved_tokens") + (F.col("n") - 1) * onward).alias("saved_tokens"),
            F.when(last, F.col("ends_sha256")).otherwise(none).alias("ends_sha256"))
        part = own.unionByName(nodes.filter("depth >= 0").drop("head"))
        out = part if out is None else out.unionByName(part)
        total = F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")
        below = full.filter("parent is not null").groupBy(F.col("parent").alias("head")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum(F.col("saved_tokens") + (F.col("n") - 1) * total).alias("saved_tokens"))
    return out if out is not None else scratch.spark.createDataFrame([], NODE)
