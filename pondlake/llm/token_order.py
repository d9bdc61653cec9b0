"""Training-order materialisation of token sequences.

Documents become sequences of at most ``SEQUENCE`` ids. Sequences get a dense
index in the order of document and piece (range partitions of the bare keys, their
counts, then running sums), and a keyed Feistel permutation of
the index with cycle-walking gives each its global slot: a bijection of
[0, n) computed row by row, so the order is fixed by the key and no shuffle of
random numbers or sort by them is needed. Range partitions of slots then write
shards: one Parquet row per shard holding a fixed number of records of a fixed
stride, in slot order. The record of slot s is in shard s // per_shard at byte
(s % per_shard) * stride, so readers go on from any slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pondlake.llm.common import Scratch, ship, sized_join
from pondlake.llm.tokens import batches_of, default_path, tokenizer

SEQUENCE, PER_SHARD, ROUNDS = 512, 512, 6
#: Sequences that one writing task gets.
PER_TASK = 32_768
_SEQUENCES = "doc_id long, piece int, length int, ids binary"
_SHARDS = "shard long, first_slot long, records int, stride int, data binary"


def _round(half: np.ndarray, key: np.uint64) -> np.ndarray:
    x = half ^ key
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slots_of(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of [0, n) at ``index``: a balanced Feistel network over
    the next even number of bits, walked until the image is below ``n``."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)
    keys = np.random.default_rng([key & (2**63 - 1), n]).integers(0, 2**63, ROUNDS, dtype=np.uint64)
    out = index.astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        left, right = out[walk] >> np.uint64(bits), out[walk] & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        out[walk] = left << np.uint64(bits) | right
        walk = out >= np.uint64(n)
    return out.astype(np.int64)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE,
              tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, length, ids`` (little-endian unsigned 16-bit): each document's
    ids and the end id in pieces of ``length``. Null text is empty."""
    ship(docs.sparkSession)
    path = tokenizer_path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in batches:
            text = batch.column("text")
            for first, last in batches_of(text):
                ids, bounds = encode(text.slice(first, last - first))
                if len(ids) and int(ids.max()) > 65535:
                    raise ValueError("16-bit records hold vocabularies of at most 65536 ids")
                out: list[list] = [[], [], [], []]
                for i, doc in enumerate(batch.column("doc_id").slice(first, last - first).to_pylist()):
                    own = np.append(ids[bounds[i]:bounds[i + 1]], end_id).astype("<u2")
                    for k, start in enumerate(range(0, len(own), length)):
                        piece = own[start:start + length]
                        for column, value in zip(out, (doc, k, len(piece), piece.tobytes())):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)],
                                                 names=["doc_id", "piece", "length", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, _SEQUENCES)


def materialise(seqs: DataFrame, path: str, key: int, length: int = SEQUENCE, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards of ``seqs`` (from ``sequences``) under ``path`` and return the
    manifest: ``doc_id, piece, length, slot``.

    A record is its length as an unsigned 32-bit number, then its ids, padded with
    zeros to the stride ``4 + 2 * length``. Repeated rows are sequences of their own;
    an empty table writes no shard. The order depends on ``key`` and the rows alone, not
    on files, partitions or the size of the cluster: sequences are counted by document,
    piece, length and a hash of the ids (null documents first; those that agree in all
    are equal records).
    """
    spark = seqs.sparkSession
    scratch = Scratch(spark, "order")
    rows = scratch.write(seqs.withColumn("place", F.monotonically_increasing_id()), compression="zstd")
    # place comes last, so that equal records of a hot key spread over partitions too
    keys = rows.select("doc_id", "piece", "length", F.xxhash64("ids").alias("ids_hash"), "place")
    ranked = keys.repartitionByRange(*keys.columns).sortWithinPartitions(*keys.columns)
    ranked = scratch.write(ranked.select("place", F.monotonically_increasing_id().alias("rank")))
    task = F.shiftright("rank", 33)
    counts = scratch.write(ranked.groupBy(task.alias("task")).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per writing task
    base = scratch.write(counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))

    def permuted(index: pd.Series) -> pd.Series:
        return pd.Series(slots_of(index.to_numpy(np.int64), total, key))

    index = F.col("base") + F.col("rank").bitwiseAND(F.lit(2**33 - 1))
    slots = sized_join(ranked.withColumn("task", task), base, ["task"], "inner", 24)
    slots = scratch.write(slots.select("place", F.pandas_udf(permuted, "long")(index).alias("slot")))
    dealt = sized_join(rows, slots, ["place"], "inner", 24) \
        .withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))
    stride = 4 + 2 * length

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, data = None, 0, bytearray()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([len(data) // stride], pa.int32()),
                 pa.array([stride], pa.int32()), pa.array([bytes(data)], pa.binary())],
                names=["shard", "first_slot", "records", "stride", "data"])

        for batch in batches:
            for s, slot, n, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "length", "ids"))):
                if s != shard:
                    if data:
                        yield row()
                    shard, first, data = s, slot, bytearray()
                data += n.to_bytes(4, "little") + ids.ljust(stride - 4, b"\0")
        if data:
            yield row()

    tasks = max(1, -(-total // PER_TASK))
    ordered = dealt.select("shard", "slot", "length", "ids").repartitionByRange(tasks, "shard").sortWithinPartitions("slot")
    ordered.mapInArrow(write, _SHARDS).write.option("compression", "zstd").parquet(path)
    manifest = scratch.write(dealt.select("doc_id", "piece", "length", "slot"))
    scratch.drop(rows, ranked, slots)
    return manifest


def read_slots(spark: SparkSession, path: str, first_slot: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """``slot, shard, byte_offset, length, ids_crc32, ids`` from ``first_slot`` on, read
    from the shards by their fixed stride; earlier shards are not read."""
    ship(spark)
    shards = spark.read.schema(_SHARDS).parquet(path).filter(F.col("shard") >= first_slot // per_shard)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, records, stride, data in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.arange(max(0, first_slot - first), records)
                sizes = [int.from_bytes(data[i * stride:i * stride + 4], "little") for i in at]
                ids = [data[i * stride + 4:i * stride + 4 + 2 * n] for i, n in zip(at, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + at, pa.int64()), pa.array([shard] * len(at), pa.int64()), pa.array(at * stride, pa.int64()),
                     pa.array(sizes, pa.int32()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["slot", "shard", "byte_offset", "length", "ids_crc32", "ids"])

    return shards.mapInArrow(read, "slot long, shard long, byte_offset long, length int, ids_crc32 long, ids binary")
