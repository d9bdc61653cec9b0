"""Streaming ingest equals the batch rules; keyed dedup; refresh outputs."""

import os

from pyspark.sql import functions as F

from pondlake.fixtures import events_readings
from pondlake.schema import CANON
from pondlake.streaming import streams as S
from tests.conftest import SF_SMALL


def _raw_files(spark, folder):
    """Canonical-order raw CSVs, one per pond, built from the events fixture."""
    r = events_readings(spark, SF_SMALL)
    ponds = {"click": 1, "view": 2, "purchase": 3, "error": 4, "signup": 5}
    os.makedirs(folder, exist_ok=True)
    for name, num in ponds.items():
        rows = (r.filter(F.col("pond_id") == name)
                 .select(F.date_format("created_at", "dd/MM/yyyy HH:mm:ss").alias("created_at"),
                         "entry_id", "value", "k").collect())
        with open(f"{folder}/IoTPond{num}.csv", "w") as f:
            f.write(",".join(CANON) + "\n")
            for x in rows:
                vals = [x.created_at, x.entry_id, x.value, x.k, x.value, 7.0, 0.5, x.k, 10, 1.5, 2.5]
                f.write(",".join(str(v) for v in vals) + "\n")
            # a repeated key inside the watermark, dropped by the stream
            x = rows[0]
            f.write(",".join(str(v) for v in [x.created_at, x.entry_id, x.value, x.k, x.value, 7.0,
                                               0.5, x.k, 10, 1.5, 2.5]) + "\n")
    return r.count()


def test_ingest_and_refresh_streams(spark, tmp_path):
    src, table = str(tmp_path / "src"), str(tmp_path / "readings")
    n = _raw_files(spark, src)
    q = S.ingest_stream(spark, src, table, str(tmp_path / "ck1"), available_now=True)
    q.awaitTermination(300)
    out = spark.read.parquet(table)
    assert out.count() == n                               # the repeats are gone
    assert out.select("pond_id").distinct().count() == 5
    assert dict(out.dtypes)["created_at"] == "timestamp"
    # batch rules on the same files give the same rows
    batch = S.typed_readings(spark.read.option("header", True).schema(S.RAW).csv(src)
                             .withColumn("pond_id", F.regexp_extract(F.col("_metadata.file_name"),
                                                                     r"\d+", 0).cast("int")))
    assert batch.dropDuplicates(["pond_id", "entry_id"]).count() == n

    reports, view = str(tmp_path / "reports"), str(tmp_path / "overview")
    q2 = S.refresh_stream(spark, table, str(tmp_path / "ck2"), reports, view,
                          columns=["temperature", "ph"], report_range=100,
                          sensors=["temperature", "turbidity"], available_now=True)
    q2.awaitTermination(300)
    rep = spark.read.parquet(reports)
    assert rep.filter("test_order = 0").count() == 5
    ov = spark.read.parquet(view)
    assert ov.count() == 10 and ov.filter("start != 0").count() == 0


def test_keyed_dedup_across_micro_batches(spark, tmp_path):
    src, table = tmp_path / "src2", str(tmp_path / "readings2")
    src.mkdir()

    def write(name, rows):
        with open(src / name, "w") as f:
            f.write(",".join(CANON) + "\n")
            for t, key in rows:
                f.write(",".join(str(v) for v in [t, key, 1.0, 2, 3.0, 7.0, 0.5, 4, 10, 1.5, 2.5]) + "\n")

    write("IoTPond1_a.csv", [("01/01/2024 10:00:00", 1), ("01/01/2024 10:05:00", 2)])
    write("IoTPond1_b.csv", [("01/01/2024 10:20:00", 1), ("01/01/2024 10:25:00", 3)])
    write("IoTPond2_a.csv", [("01/01/2024 10:20:00", 1)])       # same key, other pond: kept
    q = S.ingest_stream(spark, str(src), table, str(tmp_path / "ck"),
                        available_now=True, max_files=1)
    q.awaitTermination(300)
    out = spark.read.parquet(table)
    keys = sorted((r.pond_id, r.entry_id) for r in out.select("pond_id", "entry_id").collect())
    assert keys == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert q.lastProgress is not None


def test_refresh_batch_replay_is_idempotent(spark, tmp_path):
    table = str(tmp_path / "readings3")
    r = events_readings(spark, SF_SMALL)
    rows = r.select(F.when(F.col("pond_id") == "click", 1).otherwise(2).alias("pond_id"),
                    F.col("created_at").cast("timestamp").alias("created_at"), "entry_id",
                    F.col("value").alias("temperature"), F.col("k").alias("ph"))
    rows.write.partitionBy("pond_id").parquet(table)
    run = S.refresh_batch(spark, table, str(tmp_path / "rep"), str(tmp_path / "ov"),
                          ["temperature", "ph"], 100, ["temperature", "ph"])
    batch = spark.read.parquet(table).filter("pond_id = 1")
    run(batch, 7)
    first = spark.read.parquet(str(tmp_path / "rep")).count()
    run(batch, 7)                      # the same micro-batch replayed after a failure
    assert spark.read.parquet(str(tmp_path / "rep")).count() == first == 3
    assert spark.read.parquet(str(tmp_path / "ov")).count() == 2


HEADER7 = [c for c in ["created_at", "entry_id", "Temperature (C)", "Turbidity(NTU)", "Dissolved Oxygen(g/ml)",
                       "PH", "Ammonia(g/ml)", "nitrate(g/ml)", "Population", "Fish_Length (cm)", "Fish_Weight (g)"]]


def _csv(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def _reading(time, key, turbidity="10", population=True):
    row = [time, key, 24.5, turbidity, 6.1, 7.2, 0.3, 12, 50, 7.5, 120.25]
    return row if population else row[:8] + row[9:]


def test_an_older_second_pond_and_rows_without_time_are_kept(spark, tmp_path):
    src, table = tmp_path / "late", str(tmp_path / "late_table")
    src.mkdir()
    _csv(src / "a_IoTPond1.csv", HEADER7, [_reading(f"{d:02d}/03/2024 10:00:00", d) for d in range(1, 11)])
    run = lambda: S.ingest_stream(spark, str(src), table, str(tmp_path / "ck"), available_now=True).awaitTermination(300)
    run()
    _csv(src / "b_IoTPond2.csv", HEADER7, [_reading(f"{d:02d}/02/2024 10:00:00", d) for d in range(1, 11)])
    _csv(src / "c_IoTPond1.csv", HEADER7, [_reading("01/01/2020 10:00:00", 3), _reading(None, 77)])
    run()
    out = spark.read.parquet(table)
    keys = sorted((r.pond_id, r.entry_id) for r in out.collect())
    assert keys == [(1, k) for k in range(1, 11)] + [(1, 77)] + [(2, k) for k in range(1, 11)]
    assert out.filter("pond_id = 1 and entry_id = 3").first().created_at.year == 2024  # the repeat went
    assert out.filter("entry_id = 77").first().created_at is None


def test_batch_rules_hold_in_the_stream(spark, tmp_path):
    """Repairs, splices, missing-value tokens, extra columns: as in the batch load."""
    from pondlake.sources.csv_ingest import ingest_folder
    src, table = tmp_path / "rules", str(tmp_path / "rules_table")
    src.mkdir()
    _csv(src / "IoTPond4.csv", HEADER7, [_reading("01/01/2024 10:00:00", 1, "Jan-00"), _reading("02/01/2024 10:00:00", 2, "NA")])
    _csv(src / "IoTPond7.csv", [h for h in HEADER7 if h != "Population"],
         [_reading("2024-01-03 10:00:00", 1, population=False)])
    _csv(src / "IoTPond9a.csv".replace("9a", "1"), HEADER7[:1] + ["Date"] + HEADER7[1:] + ["extra"],
         [r[:1] + ["x"] + r[1:] + ["y"] for r in [_reading("04/01/2024 10:00:00", 5)]])
    S.ingest_stream(spark, str(src), table, str(tmp_path / "ck"), available_now=True).awaitTermination(300)
    got = spark.read.parquet(table).drop("batch_id")
    want = ingest_folder(spark, str(src))
    cols = sorted(want.columns)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert {(r.pond_id, r.turbidity) for r in got.collect()} == {(4, 12.45), (4, None), (7, 10.0), (1, 10.0)}


def test_replayed_ingest_batch_writes_the_same(spark, tmp_path):
    src, table = tmp_path / "replay", str(tmp_path / "replay_table")
    src.mkdir()
    _csv(src / "IoTPond1.csv", HEADER7, [_reading("01/01/2024 10:00:00", k) for k in (1, 2, 2)])
    files = spark.createDataFrame([(f"file://{src}/IoTPond1.csv",)], "path string")
    run = S.ingest_batch(spark, table)
    for batch in (0, 0, 1):                       # 0 again after a failure; 1 has the same keys
        run(files, batch)
    assert sorted(r.entry_id for r in spark.read.parquet(table).collect()) == [1, 2]


def test_refresh_merges_batches_as_the_whole_table_would(spark, tmp_path):
    from pondlake.operators import drift
    table = str(tmp_path / "inc")
    r = events_readings(spark, SF_SMALL)
    rows = r.select(F.when(F.col("pond_id") == "click", 1).otherwise(2).alias("pond_id"),
                    F.col("created_at").cast("timestamp").alias("created_at"), "entry_id",
                    F.col("value").alias("temperature"), F.col("k").alias("ph")).cache()
    run = S.refresh_batch(spark, table, str(tmp_path / "rep"), str(tmp_path / "ov"), ["temperature", "ph"], 100, ["temperature", "ph"])
    for i in range(3):
        part = rows.filter(F.col("entry_id") % 3 == i)
        part.write.mode("append").partitionBy("pond_id").parquet(table)
        run(part, i)
    got = spark.read.parquet(str(tmp_path / "rep")).filter("batch_id = 2").drop("batch_id")
    want = drift.monitor(rows, ["temperature", "ph"], 100)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def _batch(spark, table, batch_id, rows):
    """One micro-batch of rows (pond, key) through the key lookup, the write and the record."""
    df = spark.createDataFrame(rows, "pond_id int, entry_id long")
    fresh = S.new_keys(spark, df, table, batch_id).withColumn("batch_id", F.lit(batch_id))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pond_id", "batch_id").parquet(table)
    S.KeyIntervals(spark, table).written(batch_id)


def test_key_lookup_stays_flat_over_many_batches(spark, tmp_path, monkeypatch):
    """Keys grow with time: a batch looks up the files of its repeats, not the history."""
    monkeypatch.setattr(S.KeyIntervals, "FOLD", 4)
    table = str(tmp_path / "readings")
    looked_up = []
    for b in range(14):
        # ten new keys a pond, and one of the batch before again
        rows = [(p, 10 * b + i) for p in (1, 2) for i in range(-1 if b else 0, 10)]
        looked_up.append(len(S.KeyIntervals(spark, table).files(spark.createDataFrame(rows, "pond_id int, entry_id long"), b)))
        _batch(spark, table, b, rows)
    assert looked_up[0] == 0 and max(looked_up) <= 2 * 4 and max(looked_up[-4:]) <= max(looked_up[1:5])
    store = S.KeyIntervals(spark, table)
    upto, batches = store._folders()
    assert upto > 0 and len(batches) <= 5
    assert spark.read.parquet(table).count() == 280 == spark.read.parquet(table).dropDuplicates(["pond_id", "entry_id"]).count()
    # a replay of the last batch writes what it wrote; a very late repeat is found
    _batch(spark, table, 13, [(p, 130 + i) for p in (1, 2) for i in range(-1, 10)])
    _batch(spark, table, 14, [(1, 3), (2, 3), (3, 3)])
    assert spark.read.parquet(table).count() == 281


def test_key_store_of_a_table_that_had_none(spark, tmp_path):
    table = str(tmp_path / "old")
    spark.range(50).selectExpr("1 AS pond_id", "id AS entry_id", "7 AS batch_id").write.partitionBy("pond_id", "batch_id").parquet(table)
    rows = spark.createDataFrame([(1, 49), (1, 50), (None, 50), (None, 50)], "pond_id int, entry_id long")
    got = sorted(map(str, S.new_keys(spark, rows, table, 8).collect()))
    assert got == ["Row(pond_id=1, entry_id=50)", "Row(pond_id=None, entry_id=50)"]
