"""Zone map and position index: answers equal those of a scan, and files that cannot
hold an answer are not read (they are overwritten with rubbish here)."""

import datetime as dt
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from pondlake.operators import crosspond as C
from pondlake.operators import drift as D
from pondlake.operators import series as S
from pondlake.sources.pond_files import PondFiles, write_clustered

SCHEMA = "pond_id string, created_at timestamp_ntz, entry_id long, v double"
START = dt.datetime(2024, 1, 1)


def readings(n=600, seed=1, ponds=("a", "b", None), nulls=0):
    rng = random.Random(seed)
    rows = [(p, START + dt.timedelta(minutes=i), 10_000 * k + i, rng.random()) for k, p in enumerate(ponds) for i in range(n)]
    rows += [(p, None, 900_000 + 10 * k + j, rng.random()) for k, p in enumerate(ponds) for j in range(nulls)]
    return rows


def rows_of(df):
    return sorted(map(str, df.collect()))


def spoil(files):
    """Make the files unreadable."""
    for f in files:
        name = unquote(f.removeprefix("file:"))
        with open(name, "wb") as out:
            out.write(b"no parquet")


@pytest.fixture
def table(spark, tmp_path):
    def make(parts, rows_per_file=50, partition_by=()):
        path = str(tmp_path / "a table" / "rows")  # a blank in the path
        frames = [spark.createDataFrame(p, SCHEMA) for p in parts]
        for f in frames:
            write_clustered(f, path, rows_per_file, partition_by=partition_by)
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f)
        return PondFiles(spark, path, str(tmp_path / "zones"), whole.select(*whole.columns).schema if not partition_by else None).refresh(), whole
    return make


LATE = [("a", START + dt.timedelta(minutes=300 + 2 * i, seconds=30), 700_000 + i, 1.0) for i in range(40)]


@pytest.mark.parametrize("parts", [[readings()], [readings(nulls=5)], [readings(nulls=3), LATE], [readings(n=300)[k::2] for k in range(2)]],
                         ids=["ordered", "null_times", "late", "overlapping"])
def test_answers_equal_a_scan(table, parts):
    t, df = table(parts)
    assert rows_of(t.sizes()) == rows_of(df.groupBy("pond_id").agg(F.count("*").alias("__L")))
    for n in (7, 5000):
        assert rows_of(S.newest_n_per_pond(t, n)) == rows_of(S.newest_n_per_pond(df, n))
        assert rows_of(S.newest_n(t, n)) == rows_of(S.newest_n(df, n))
    assert rows_of(S.sliding_window(t, 3, 30, 5)) == rows_of(S.sliding_window(df, 3, 30, 5))
    assert rows_of(S.overview(t, ["v"], 333, 30, 5)) == rows_of(S.overview(df, ["v"], 333, 30, 5))
    assert rows_of(S.pond_detail(t, "a", ["v"], 317, 30, 5)) == rows_of(S.pond_detail(df, "a", ["v"], 317, 30, 5))


def test_partitioned_layout(table):
    rows = [(p, t, e, v) for p, t, e, v in readings(ponds=("a", "b 1", "c%2"))]
    t, df = table([rows], partition_by=["pond_id"])
    assert rows_of(S.newest_n_per_pond(t, 20).select("pond_id", "entry_id", "rn")) == rows_of(
        S.newest_n_per_pond(df, 20).select("pond_id", "entry_id", "rn"))
    assert rows_of(S.pond_detail(t, "b 1", ["v"], 200)) == rows_of(S.pond_detail(df, "b 1", ["v"], 200))


def test_monitor_reads_only_the_newest_files(table):
    t, df = table([readings()])
    want = rows_of(D.monitor(df, ["v"], 60))
    needed = set(t.newest_files(60))
    assert 3 <= len(needed) <= 9 < len(t.files())
    spoil(set(t.files()) - needed)
    assert rows_of(D.monitor(t, ["v"], 60)) == want
    with pytest.raises(Exception):
        D.monitor(t, ["v"], 5000).collect()


def test_cursor_reads_only_its_files(table):
    t, df = table([readings()])
    want = rows_of(S.overview(df, ["v"], 240, 30, 5))
    wanted = t.stretches().filter("base < 275 and base + size > 240").select("file").distinct().collect()
    keep = {r.file for r in wanted}
    assert len(keep) <= 9 < len(t.files())
    spoil(set(t.files()) - keep)
    assert rows_of(S.overview(t, ["v"], 240, 30, 5)) == want
    assert t.sizes().count() == 3  # sizes come from the zone map


def test_late_rows_join_only_the_stretch_that_they_overlap(table):
    t, df = table([readings(), LATE])
    runs = t.stretches().filter("pond_id = 'a'").groupBy("run", "base", "size").agg(F.count("*").alias("files")).orderBy("base").collect()
    assert [r.base for r in runs] == [sum(x.size for x in runs[:i]) for i in range(len(runs))]
    assert sorted(r.files for r in runs)[-1] > 1 and sorted(r.files for r in runs)[0] == 1 and sum(r.size for r in runs) == 640


def test_refresh_reads_new_files_only(table, spark):
    t, df = table([readings()])
    first = set(t.files())
    with pytest.raises(ValueError, match="zone map"):
        write_clustered(spark.createDataFrame(LATE, SCHEMA), t.path, 50)
        t.sizes()
    new = set(t.files()) - first
    spoil(first)
    t.refresh()
    assert {r.file for r in t.zones().select("file").distinct().collect()} == first | new
    assert t.refresh().zones().count() == t.zones().dropDuplicates(["file", "pond_id"]).count()


def test_keys_name_their_files(table, spark):
    t, df = table([readings()])
    keys = spark.createDataFrame([("a", 120), ("a", 130), (None, 20_000)], "pond_id string, entry_id long")
    files = t.files_with_keys(keys)
    assert 1 <= len(files) <= 4
    got = {tuple(r) for r in t.stored_keys(keys).collect()}
    assert {tuple(r) for r in keys.collect()} <= got
    assert t.files_with_keys(spark.createDataFrame([("a", 5_000), ("zz", 1)], "pond_id string, entry_id long")) == []


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    t = PondFiles(spark, path, str(tmp_path / "zones")).refresh()
    assert S.newest_n_per_pond(t, 5).count() == 0 and t.sizes().count() == 0 and S.overview(t, ["v"], 0).count() == 0
