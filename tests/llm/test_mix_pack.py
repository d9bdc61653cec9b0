"""Mixing and packing: targets, budgets, exact ids, bins."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pondlake.llm import mixing, packing
from pondlake.llm.tokens import WordTokenizer, default_path
from tests.llm import helpers as h


def _targets(sizes: dict, share: float = 1.5, most: float = 2.0) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, active, out = share * sum(sizes.values()), set(names), {}
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in active}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        active -= set(over)
    return out


def test_mix(spark):
    rows = h.awkward_rows()
    got = mixing.mix(h.awkward(spark)).collect()
    size = lambda t: len(h.words(t))
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r[1])
    want = _targets(total)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == total[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= max(1, 0.01 * want[s]), (s, taken[s], want[s])


def test_mix_reruns_agree(spark):
    a, b = (sorted((r.doc_id, r.taken) for r in mixing.mix(d).filter("doc_id is not null").collect())
            for d in (h.awkward(spark), h.awkward(spark).repartition(2)))
    assert a == b


def test_hot_length_is_ranked_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 10)
    rows = [(i, "a b c", "s") for i in range(300)] + [(1000 + i, "a b c d e", "t") for i in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
    want = _targets({"s": 900, "t": 300}, 0.5)
    assert all(abs(taken[s] - want[s]) < 5 for s in want)


def test_mixed_rows(spark):
    docs = h.awkward(spark)
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    want = sum(r.taken for r in mixing.mix(docs).collect())
    assert sum(len(h.words(r.text)) for r in out.collect()) == want
    assert mixing.mixed(h.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_exact_where_small_lengths_allow(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 6000, 400))
    counts = rng.integers(1, 30, len(lengths))
    budget = int((lengths * counts).sum() * rng.uniform(0.05, 0.95))
    take = mixing.fit(lengths, counts, budget, seed)
    assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() == budget


def test_knapsack_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 12, 4))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(1, 40))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = mixing._fill(lengths, counts, budget)
        assert (take <= counts).all() and (lengths * take).sum() == max(s for s in sums if s <= budget)


TEXTS = [r[1] for r in h.awkward_rows() if r[0] not in (402, 403, 404)] + [
    "Don't stop; it's 3.14, e-mail: a.b@c.d!! ### $x$ naïve CAFÉ Ünḯ ß ﬁ Σας ΟΔΟΣ", "tab\tnl\n nbsp em　ideographic",
    "x<|endoftext|>y <|startoftext|>", "İstanbul ǅ ŉ Kelvin K ſ", "a" * 3000, "word. word, word! word?! (word) [x] | y | 'll 're"]


def test_tokens_equal_the_tokenizers():
    own = WordTokenizer(default_path())
    ids, bounds = own.encode(pa.array(TEXTS, pa.string()))
    for i, t in enumerate(TEXTS):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_tokens_of_slices():
    """Ranges of a batch, as the tasks take them."""
    own = WordTokenizer(default_path())
    texts = ["é à la carte"] * 3 + TEXTS + ["à É È Straße"] * 3
    whole = pa.array(texts, pa.string())
    for a in range(0, len(texts), 4):
        ids, bounds = own.encode(whole.slice(a, 4))
        for i, t in enumerate(texts[a:a + 4]):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_pieces_and_bins(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1, 2)],
                                 "doc_id long, text string, length int, piece int")
    cut = packing.pieces(docs, with_ids=True)
    out = packing.pack(cut).collect()
    own = WordTokenizer(default_path())
    want = Counter()
    for i, t in [*enumerate(TEXTS), (0, TEXTS[0])]:
        ids = np.array(own.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            raw = ids[s:s + 2048].tobytes()
            want[i, k, s, len(raw) // 4, zlib.crc32(raw), raw] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own_bin in bins.values():
        at = 0
        for offset, length in sorted(own_bin):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(h.empty(spark))).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_two_fit_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 2048, 3000))[::-1]
    bins = packing.best_two_fit(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= 1.02 * -(-lengths.sum() // 2048) + 1 + (lengths > 1024).sum() * 0.02 or len(bins) <= (lengths > 1024).sum() + 5


def test_two_small_replace_one():
    # greedy takes 6 then 3; 2 + 2 fill the gap of 4 that 3 leaves
    bins = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(sum([6, 3, 2, 2][i] for i in b) for b in bins) == [3, 10]


def test_words_are_ascii_space_separated(spark):
    t = "a b c\x0bd\x1ce"
    got = mixing.mix(spark.createDataFrame([(1, t, "s")], "doc_id long, text string, source string")).first()
    assert got["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t)) == 3


def test_mixed_keeps_rows_of_both_sources(spark):
    docs = spark.createDataFrame([(1, "a b c", "A"), (1, "a b c", "B"), (2, "d e f", None)], "doc_id long, text string, source string")
    taken = {(r.doc_id, r.source): r.taken for r in mixing.mix(docs).collect()}
    got = Counter((r.doc_id, r.source) for r in mixing.mixed(docs).collect())
    assert {k: 3 * n for k, n in got.items()} == {k: n for k, n in taken.items() if n} and len(got) >= 2


def test_rows_without_ids_are_drawn_evenly(spark):
    """Equal lengths and null ids: texts have draws of their own, and copies are counted."""
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w x"), F.col("id").cast("string")).alias("text"),
                                    F.lit("s").alias("source"))
    copies = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs.unionByName(copies), share=0.5).collect()
    assert len(got) == 7000 and sum(r.taken for r in got) == 7000
    assert {r.taken for r in got} == {0, 2}
    some = sum(r.taken > 0 for r in got if r.source == "s")
    assert some == 3500


def test_ids_beyond_doubles_beside_a_null_one(spark):
    ids = [2**60 + 1, 2**60 + 3, None, 5]
    docs = spark.createDataFrame([(i, f"word {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    out = packing.pack(packing.pieces(docs)).collect()
    assert sorted(r.doc_id or 0 for r in out) == sorted(i or 0 for i in ids)
