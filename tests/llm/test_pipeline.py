"""The pipeline: each stage against brute force on its own input, and awkward tables."""

from collections import Counter, defaultdict

import corpus_pipeline
from pondlake.llm.common import Scratch
from tests.llm import helpers as h

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = scratch.write(stage(spark, docs, SF))
        seen[name] = before, docs.collect()
        if name != "pack_sequences":
            assert docs.columns == columns
            assert not Counter(docs.collect()) - Counter(before) or name == "mix_sources"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]

    before, after = seen["quality_rules"]
    failed = {r.doc_id for r in before for q in [h.quality(r.text)] if q[0] < 50 or 100 * q[4] > 50 * q[0]}
    assert not failed & {r.doc_id for r in after}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert {r.doc_id for r in before if r.doc_id in good} - failed <= {r.doc_id for r in after}

    before, after = seen["exact_dedup"]
    groups = h.exact_groups([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {min(ids) for ids in groups.values()} and len(after) == len(groups)

    before, after = seen["near_dedup"]
    comp = h.components([h.shingles(r.text) for r in before])
    members = defaultdict(list)
    for r, c in zip(before, comp):
        members[c].append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(min(m) for m in members.values())

    before, after = seen["mix_sources"]
    size = lambda rows: sum(len(h.words(r.text)) for r in rows)
    assert abs(size(after) - 1.5 * size(before)) <= 0.02 * size(before)
    assert max(Counter(r.doc_id for r in after).values()) <= 2 and {r.doc_id for r in after} <= {r.doc_id for r in before}

    before, after = seen["pack_sequences"]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
    bins = defaultdict(int)
    for r in after:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 3


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty_and_awkward_documents(spark):
    for docs in (h.empty(spark), h.awkward(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0


def test_registered(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
