"""Training order: the permutation, the shards, resumable reads."""

import zlib
from collections import Counter

import numpy as np
import pytest

from pondlake.llm import token_order as to
from pondlake.llm.tokens import WordTokenizer, default_path
from tests.llm import helpers as h


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 65_537])
def test_permutation_is_a_bijection(n):
    slots = to.slots_of(np.arange(n), n, 5)
    assert sorted(slots) == list(range(n))
    assert (slots == to.slots_of(np.arange(n), n, 5)).all()
    if n >= 1000:
        assert (slots != to.slots_of(np.arange(n), n, 6)).mean() > 0.99
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.1


def test_permutation_beyond_32_bits():
    n = 10**15 + 37
    index = np.arange(n - 1000, n)
    slots = to.slots_of(index, n, 1)
    assert len(set(slots)) == 1000 and slots.min() >= 0 and slots.max() < n


def test_shards_hold_every_sequence(spark, tmp_path):
    texts = [r[1] for r in h.awkward_rows()]
    docs = spark.createDataFrame([(i, t, 9, "c") for i, t in enumerate(texts)] + [(0, texts[0], 9, "c")],
                                 "doc_id long, text string, slot long, ids string").repartition(5)
    path = str(tmp_path / "shards")
    manifest = to.materialise(to.sequences(docs, length=64), path, key=11, length=64, per_shard=16).collect()
    own = WordTokenizer(default_path()).tokenizer
    want = Counter()
    for i, t in [*enumerate(texts), (0, texts[0])]:
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u2")
        for k, s in enumerate(range(0, len(ids), 64)):
            want[i, k, ids[s:s + 64].tobytes()] += 1
    n = sum(want.values())
    read = {r.slot: r for r in to.read_slots(spark, path, per_shard=16).collect()}
    assert sorted(read) == list(range(n)) == sorted(r.slot for r in manifest)
    assert Counter((m.doc_id, m.piece, bytes(read[m.slot].ids)) for m in manifest) == want
    for s, r in read.items():
        assert (r.shard, r.byte_offset, r.length) == (s // 16, s % 16 * 132, len(r.ids) // 2) and r.ids_crc32 == zlib.crc32(r.ids)
    later = to.read_slots(spark, path, first_slot=n - 21, per_shard=16).collect()
    assert sorted(r.slot for r in later) == list(range(n - 21, n))
    shards = spark.read.parquet(path).collect()
    assert all(len(r.data) == r.records * r.stride and r.first_slot == r.shard * 16 for r in shards)
    assert all(r.records == 16 for r in shards if r.shard < n // 16)


def test_order_is_of_the_rows_not_of_their_partitions(spark, tmp_path):
    texts = [r[1] for r in h.awkward_rows()]
    rows = [(None if i % 3 == 0 else 2**60 + i % 5, t) for i, t in enumerate(texts * 3)] + [(None, "same words")] * 40
    seen = []
    for parts, seed in ((2, 1), (5, 2)):
        mixed = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]
        docs = spark.createDataFrame(mixed, "doc_id long, text string").repartition(parts)
        path = str(tmp_path / f"shards{parts}")
        manifest = to.materialise(to.sequences(docs, length=32), path, key=3, length=32, per_shard=8)
        seen.append((sorted((r.shard, bytes(r.data)) for r in spark.read.parquet(path).collect()),
                     sorted(map(str, manifest.collect()))))
    assert seen[0] == seen[1] and len(seen[0][0]) > 5


def test_empty(spark, tmp_path):
    assert to.materialise(to.sequences(h.empty(spark)), str(tmp_path / "x"), key=1).count() == 0
    assert to.read_slots(spark, str(tmp_path / "x")).count() == 0


def test_query(spark):
    from pondlake.llm.queries import QUERIES
    out = QUERIES["op2_feistel_order"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    assert {r.doc_id for r in out} == {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()}
