"""Best-two-fit packing of documents into sequences.

Documents are tokenised where they are read; only a row per piece (no ids unless
asked for) is written to the shared folder. Pieces are dealt by hash to packing
tasks of about ``PER_TASK`` pieces; each packs its share, so a run over any number of
documents leaves few unfilled sequences per ``PER_TASK`` pieces. Full pieces are
sequences of their own and skip the packing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondlake.llm.common import Scratch, ship
from pondlake.llm.tokens import batches_of, default_path, tokenizer

CAPACITY = 2048
PER_TASK = 20_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer_path: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut only beyond ``capacity``.

    Null text is empty (its one piece is the end id); a null id stays null. ``ids`` holds little-endian
    unsigned 32-bit ids, null unless ``with_ids``.
    """
    ship(docs.sparkSession)
    path = tokenizer_path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in batches:
            text = batch.column("text")
            for first, last in batches_of(text):
                ids, bounds = encode(text.slice(first, last - first))
                rows = [[], [], [], [], [], []]
                for i, doc in enumerate(batch.column("doc_id").slice(first, last - first).to_pylist()):
                    own = np.append(ids[bounds[i]:bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        raw = own[start:start + capacity].tobytes()
                        for column, value in zip(rows, (doc, k, start, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None)):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, _PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes into ``lengths``, each at most ``capacity``.

    A bin is filled greedily by the longest document that fits, until none does.
    Then its smallest document is replaced by the two unpacked documents that fit
    the gap it leaves most tightly, if they fill more of it than it did.
    """
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stock[int(lengths[i])].append(i)
    there = 0  # bit n: documents of length n are left
    for n, held in enumerate(stock):
        there |= bool(held) << n

    def longest(most: int) -> int:
        return (there & ((2 << most) - 1)).bit_length() - 1 if most > 0 else 0

    def take(n: int) -> int:
        nonlocal there
        i = stock[n].pop()
        if not stock[n]:
            there &= ~(1 << n)
        return i

    bins = []
    while there:
        own, gap = [], capacity
        while (n := longest(gap)) > 0:
            own.append((n, take(n)))
            gap -= n
        if gap and len(own) > 1:
            smallest, i = own[-1]
            room, best = smallest + gap, (smallest, 0, 0)
            # the longer of the two, from the longest that fits down to half the room
            bits = there & ((1 << room) - 1)
            while (a := bits.bit_length() - 1) * 2 >= room - 1 or a * 2 > best[0]:
                if a <= 0:
                    break
                b = longest(min(a, room - a))
                if b == a and len(stock[a]) < 2:
                    b = longest(a - 1) if a > 1 else 0
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                bits &= ~(1 << a)
            if best[1]:
                own.pop()
                own += [(best[1], take(best[1])), (best[2], take(best[2]))]
                stock[smallest].append(i)
                there |= 1 << smallest
        bins.append([i for _, i in own])
    return bins


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from ``pieces``) with ``sequence_id`` and ``offset`` on each row.

    Sequence ids are unique numbers without order. Ties of length go by doc_id (null
    last) and piece, so reruns over the same pieces agree but for the numbers. Rows
    repeated with the same id are packed as often; an empty table gives no rows.
    """
    scratch = Scratch(cut.sparkSession, "pack")
    kept = scratch.write(cut)
    count = kept.filter(F.col("length") < capacity).count()
    tasks = max(1, -(-count // PER_TASK))
    columns = kept.columns
    schema = kept.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def fill(group: pa.Table) -> pa.Table:
        # in Arrow: pandas would turn the ids of a share with a null one into floats
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = group["length"].to_numpy()
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        base = group["task"][0].as_py() << 32
        for k, own in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in own:
                sequence[i], offset[i] = base + k, at
                at += int(lengths[i])
        return group.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    task = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks))
    packed = kept.filter(F.col("length") < capacity).withColumn("task", task).groupBy("task").applyInArrow(fill, schema)
    # full pieces: a sequence each, numbered below zero
    full = kept.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()) \
               .withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
