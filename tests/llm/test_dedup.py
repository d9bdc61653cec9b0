"""Exact and near dedup against brute force, on awkward rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pondlake.llm import minmax_hash, radix_dedup
from tests.llm import helpers as h


def test_exact_classes(spark):
    got = radix_dedup.exact_classes(h.awkward(spark)).collect()
    rows = h.awkward_rows()
    assert len(got) == len(rows)
    want = {}
    for text, ids in h.exact_groups(rows).items():
        known = [i for i in ids if i is not None]
        want[h.sha(text)] = (min(known) if known else None, len(ids), Counter(ids))
    for key, (keep, size, ids) in want.items():
        own = [r for r in got if r.text_sha256 == key]
        assert Counter(r.doc_id for r in own) == ids
        assert {(r.keep_id, r.group_size) for r in own} == {(keep, size)}
        assert [r.doc_id for r in own if r.kept] == [keep]  # one row, even of repeated ones


def test_texts_that_part_late(spark):
    """Same length and the same bytes up to the end: only the last rounds part them."""
    body = "x" * 20_000
    rows = [(i, body + "abc"[i % 3]) for i in range(9)] + [(9, body + "d"), (10, body[:-1] + "zz")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in
           radix_dedup.exact_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i % 3, 3, i < 3) for i in range(9)} | {9: (9, 1, True), 10: (10, 1, True)}


def test_exact_dedup_keeps_columns_and_one_row_a_group(spark):
    docs = h.awkward(spark)
    out = radix_dedup.exact_dedup(docs)
    assert out.schema == docs.schema
    assert out.count() == len(h.exact_groups(h.awkward_rows()))


def test_empty_tables(spark):
    assert radix_dedup.exact_classes(h.empty(spark)).collect() == []
    assert minmax_hash.near_components(h.empty(spark)).collect() == []
    assert minmax_hash.near_dedup(h.empty(spark)).collect() == []


def test_near_components(spark):
    rows = h.awkward_rows()
    rows = [r for r in rows if r[0] is not None]
    docs = spark.createDataFrame(rows, h.SCHEMA).repartition(4)
    sets = [h.shingles(r[1]) for r in rows]
    comp = h.components(sets)
    name = {}
    for r, c in zip(rows, comp):
        name[c] = min(name.get(c, r[0]), r[0])
    want = Counter((r[0], len(s), name[c] if s else r[0]) for r, s, c in zip(rows, sets, comp))
    got = minmax_hash.near_components(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minmax_hash.near_dedup(docs)
    assert kept.schema == docs.schema
    alone = sum(not s for s in sets)
    assert kept.count() == len({c for c, s in zip(comp, sets) if s}) + alone


def test_null_ids_are_linked(spark):
    text = "a b c d e f g h"
    got = minmax_hash.near_components(spark.createDataFrame([(None, text), (None, text), (4, text), (None, "q r s t u")],
                                                            "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter(
        {(None, 4, False): 2, (4, 4, True): 1, (None, None, True): 1})


def test_chain_of_links(spark):
    """a~b~c with a and c apart: one component through b."""
    w = [f"t{i}" for i in range(400)]
    texts = [" ".join(w[k:k + 300]) for k in range(0, 100, 20)]
    sets = [h.shingles(t) for t in texts]
    assert h.components(sets) == [0] * 5 and len(sets[0] & sets[4]) * 100 < 75 * len(sets[0] | sets[4])
    got = minmax_hash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


@pytest.mark.parametrize("edit", [0.02, 0.04, 0.055])
def test_hot_buckets_with_several_components(spark, edit):
    """Families about one original at and under the threshold: what the star does not
    link must still be found pair by pair."""
    rng = np.random.default_rng(int(edit * 1000))
    base = [f"b{i}" for i in range(200)]
    texts = []
    for _ in range(150):
        own = list(base)
        for k in np.flatnonzero(rng.random(200) < edit):
            own[k] = f"n{rng.integers(10**9)}"
        texts.append(" ".join(own))
    want = h.components([h.shingles(t) for t in texts])
    got = minmax_hash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(want))


def test_shingle_sets_count_distinct_windows():
    texts = [r[1] for r in h.awkward_rows()]
    got = [len(s) for s in minmax_hash.shingle_sets(pa.array(texts, pa.string()))]
    assert got == [len(h.shingles(t)) for t in texts]
    again = list(minmax_hash.shingle_sets(pa.array(texts[::-1], pa.string()).slice(2)))
    assert [s.tobytes() for s in again] == [s.tobytes() for s in minmax_hash.shingle_sets(pa.array(texts, pa.string()))][::-1][2:]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        x = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        y = x.copy()
        n = int(4000 * (1 - share) / (1 + share))
        y[:n] = rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.frombuffer(minmax_hash._signature(v), np.uint32) for v in (x, y))
        assert abs((a == b).mean() - (4000 - n) / (4000 + n)) < 0.15


def test_registered_queries_keep_every_row(spark):
    from pondlake.llm.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name in ("op6_radix_dedup", "op10_minmax_components"):
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert out.count() == docs.count() and out.filter(F.col("doc_id").isNull()).count() == 0
