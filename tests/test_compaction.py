"""Merging the stream's small files: every row once at every step, few files, flat look-ups."""

import datetime as dt
import shutil
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from pondlake.operators import drift as D
from pondlake.operators import series as R
from pondlake.schema import CANON
from pondlake.streaming import compaction as C
from pondlake.streaming import streams as S

SCHEMA = "pond_id int, created_at timestamp, entry_id long, v double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _rows(batch, ponds=(1, 2, None), n=4):
    """A batch: ``n`` new keys of each pond, one row without time, the keys in time order."""
    out = [(p, START + dt.timedelta(minutes=n * batch + i), n * batch + i, float(batch)) for p in ponds for i in range(n)]
    return out[:-1] + [(*out[-1][:1], None, *out[-1][2:])]


def _batch(spark, table, batch_id, rows):
    fresh = S.new_keys(spark, spark.createDataFrame(rows, SCHEMA), table, batch_id).withColumn("batch_id", F.lit(batch_id))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pond_id", "batch_id").parquet(table)
    S.KeyIntervals(spark, table).written(batch_id)


def _keys(df):
    return sorted(((r.pond_id or 0), r.entry_id) for r in df.select("pond_id", "entry_id").collect())


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "a table")  # a blank in the path
    for b in range(6):
        _batch(spark, path, b, _rows(b))
    return path


WANT = sorted((p, k) for p in (0, 1, 2) for k in range(24))


def test_rows_stay_the_same_and_files_few(spark, table):
    merged = C.MergedBatches(spark, table)
    assert merged.spans() == [] and _keys(merged.rows()) == WANT
    assert merged.merge() == (0, 4) and merged.spans() == [(0, 4)] and merged.batches() == [5]
    assert _keys(merged.rows()) == WANT == _keys(spark.read.parquet(table))   # nothing is deleted yet
    assert merged.merge() is None                                             # the newest batch may be replayed
    assert merged.expire(3) == 9 and _keys(merged.rows()) == WANT             # batches 0-2 of three ponds
    assert merged.expire(99) == 6 and _keys(merged.rows()) == WANT
    assert _keys(spark.read.parquet(table)) == sorted((p, k) for p in (0, 1, 2) for k in range(20, 24))
    files = C.stream_files(spark, table, table + "_zones").files()
    assert len([f for f in files if "_merged" in f]) == 1 and len(files) == 4


def test_spans_grow_geometrically(spark, tmp_path):
    table, rewritten, spans = str(tmp_path / "t"), 0, []
    for b in range(18):
        spark.createDataFrame(_rows(b), SCHEMA).withColumn("batch_id", F.lit(b)).write.mode("append").partitionBy(
            "pond_id", "batch_id").parquet(table)
        merged = C.MergedBatches(spark, table)
        span = merged.merge()
        rewritten += span[1] - span[0] + 1 if span else 0
        merged.expire(b - 1)
        spans = merged.spans()
    assert spans[0][0] == 0 and spans[-1][1] == 16 and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))
    assert len(spans) <= 5 and rewritten <= 17 * 5
    assert _keys(C.MergedBatches(spark, table).rows()) == sorted((p, k) for p in (0, 1, 2) for k in range(72))


def test_a_merge_that_dies_hides_nothing(spark, table, monkeypatch):
    merged = C.MergedBatches(spark, table)
    merged.merge(before=3)
    with monkeypatch.context() as m:                     # after the rows, before the keys
        m.setattr(C, "key_intervals", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            merged.merge()
    assert merged.spans() == [(0, 2)] and _keys(merged.rows()) == WANT
    assert merged.merge() == (0, 4) and merged.spans() == [(0, 4)] and _keys(merged.rows()) == WANT
    assert merged.expire(0) == 2 and merged.spans() == [(0, 4)] and _keys(merged.rows()) == WANT  # the span inside goes


def test_replay_of_the_newest_batch_and_of_a_merged_one(spark, table):
    S.MergedBatches(spark, table).merge()
    _batch(spark, table, 5, _rows(5))
    assert _keys(S.stored_rows(spark, table)) == WANT
    with pytest.raises(ValueError, match="merged already"):
        S.ingest_batch(spark, table)(spark.createDataFrame([], "path string"), 4)


def test_repeats_are_found_in_merged_files(spark, table, monkeypatch):
    monkeypatch.setattr(S.KeyIntervals, "FOLD", 2)
    merged = C.MergedBatches(spark, table)
    merged.merge()
    merged.expire(99)
    late = [(1, START, 3, 0.0), (None, START, 7, 0.0), (9, START, 3, 0.0), (2, START, 23, 0.0)]
    files = S.KeyIntervals(spark, table).files(spark.createDataFrame(late, SCHEMA), 6)
    assert len(files) == 2                               # the span's file and pond 2 of batch 5
    for b in (6, 7, 8, 9):
        _batch(spark, table, b, late + _rows(b))
    assert _keys(S.stored_rows(spark, table)) == sorted([(p, k) for p in (0, 1, 2) for k in range(40)] + [(9, 3)])
    shutil.rmtree(table + "_keys")                       # a lost store is made again
    assert S.new_keys(spark, spark.createDataFrame(late, SCHEMA), table, 10).count() == 0


def test_newest_rows_and_cursors_read_only_their_files(spark, tmp_path):
    table = str(tmp_path / "t")
    for b in range(4):
        rows = spark.createDataFrame(_rows(b, ponds=(1, 2), n=150), SCHEMA).filter("created_at is not null")
        rows.withColumn("batch_id", F.lit(b)).write.mode("append").partitionBy("pond_id", "batch_id").parquet(table)
    merged = C.MergedBatches(spark, table)
    merged.merge(rows_per_file=100)
    t, df = C.stream_files(spark, table, str(tmp_path / "z")), merged.rows()
    assert sum("_merged" in f for f in t.files()) >= 8
    show = lambda x: sorted(map(str, x.collect()))
    names = ["pond_id", "created_at", "entry_id", "v"]
    want = [show(D.monitor(df, ["v"], 200)), show(R.overview(df, ["v"], 310, 30, 5)), show(R.newest_n_per_pond(df.select(names), 7))]
    needed = set(t.newest_files(200)) | {r.file for r in t.stretches().filter("base < 345 and base + size > 310").select("file").collect()}
    assert len(needed) < len(t.files()) - 2
    for f in set(t.files()) - needed:
        open(unquote(f.removeprefix("file:")), "wb").write(b"no parquet")
    cut = t.select(*names)
    assert [show(D.monitor(t, ["v"], 200)), show(R.overview(t, ["v"], 310, 30, 5)), show(R.newest_n_per_pond(cut, 7))] == want


def test_stream_that_compacts(spark, tmp_path):
    src, table = tmp_path / "src", str(tmp_path / "readings")
    src.mkdir()
    for i in range(6):
        with open(src / f"IoTPond1_{i}.csv", "w") as f:
            f.write(",".join(CANON) + "\n")
            for key in (2 * i, 2 * i + 1, 0):            # key 0 again and again
                f.write(",".join(str(v) for v in [f"0{i + 1}/01/2024 10:00:00", key, 1.0, 2, 3.0, 7.0, 0.5, 4, 10, 1.5, 2.5]) + "\n")
    run = lambda: S.ingest_stream(spark, str(src), table, str(tmp_path / "ck"), available_now=True, max_files=1,
                                  compact_every=2, keep_batches=1).awaitTermination(300)
    run()
    merged = C.MergedBatches(spark, table)
    assert merged.upto() == 4 and merged.batches() == [5]
    assert _keys(merged.rows()) == [(1, k) for k in range(12)]
    S.refresh_stream(spark, table, str(tmp_path / "ck2"), str(tmp_path / "rep"), str(tmp_path / "ov"), columns=["temperature"],
                     report_range=10, available_now=True).awaitTermination(300)
    # the pond is new to the report, so that it starts from all its rows, merged ones too
    assert spark.read.parquet(str(tmp_path / "ov_newest/current")).count() == 12


def test_empty_first_batch(spark, tmp_path):
    table = str(tmp_path / "t")
    _batch(spark, table, 0, [])
    assert not C.MergedBatches(spark, table).exists()
    _batch(spark, table, 1, _rows(0))
    assert C.MergedBatches(spark, table).merge() is None and S.stored_rows(spark, table).count() == 12
