"""One pond holding 90% of the rows: the skew-safe operators still equal
plain single-window formulations (brute force, fine at test size)."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pondlake.fixtures import events_readings
from pondlake.operators import drift as D
from pondlake.operators import series as S
from tests.conftest import SF_MID


@pytest.fixture(autouse=True)
def large_group_path(monkeypatch):
    # the hot pond (9,000 rows) takes the large-group paths, the cold ponds windows
    from pondlake.operators import ordinal
    monkeypatch.setattr(ordinal, "SMALL_GROUP_ROWS", 1000)


@pytest.fixture(scope="module")
def skewed(spark):
    r = events_readings(spark, SF_MID)
    return r.withColumn("pond_id", F.when(F.col("entry_id") % 10 < 9, F.lit("hot"))
                        .otherwise(F.col("pond_id")))


def _brute_positions(df):
    w = Window.partitionBy("pond_id").orderBy("created_at", "entry_id")
    return df.select("*", (F.row_number().over(w) - 1).alias("pos"),
                     F.count(F.lit(1)).over(Window.partitionBy("pond_id")).alias("n_rows"))


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_positions_and_horizon(spark, skewed):
    b = _brute_positions(skewed)
    assert _rows(S.row_position(skewed), ["entry_id", "pos"]) == _rows(b, ["entry_id", "pos"])
    w = Window.partitionBy("pond_id").orderBy("pos")
    exp = b.select("entry_id", F.lead("value", 10).over(w).alias("value_future"))
    got = S.horizon_value(skewed, ["value", "k"])
    assert _rows(got, ["entry_id", "value_future"]) == _rows(exp, ["entry_id", "value_future"])


def test_overview_and_window(spark, skewed):
    tick = 4321
    b = _brute_positions(skewed).filter("n_rows >= 110")
    b = b.withColumn("start", F.pmod(F.lit(tick), F.col("n_rows") - 109))
    last = b.filter(F.col("pos") == F.col("start") + 99).select("pond_id", F.col("value").alias("latest"))
    fut = b.filter(F.col("pos") == F.col("start") + 109).select("pond_id", F.col("value").alias("future"))
    exp = last.join(fut, "pond_id")
    got = S.overview(skewed, ["value", "k"], tick).filter("sensor = 'value'")
    assert _rows(got, ["pond_id", "latest", "future"]) == _rows(exp, ["pond_id", "latest", "future"])
    win = S.sliding_window(skewed, 3000)
    expw = _brute_positions(skewed).filter((F.col("pos") >= 3000) & (F.col("pos") < 3110))
    assert _rows(win, ["entry_id", "pos"]) == _rows(expw, ["entry_id", "pos"])


def test_newest_and_monitor(spark, skewed):
    n = 1000
    w = Window.partitionBy("pond_id").orderBy(F.col("created_at").desc(), F.col("entry_id").desc())
    brute = skewed.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    got = S.newest_n_per_pond(skewed, n, salt_buckets=4)
    assert _rows(got, ["entry_id", "rn"]) == _rows(brute, ["entry_id", "rn"])
    halves = brute.withColumn("half", F.when(F.col("rn") <= n // 2, "current").otherwise("reference"))
    exp = D.drift_report(D.psi(halves, ["value", "k"], bounded=False), ["value", "k"])
    rep = D.monitor(skewed, ["value", "k"], n)
    cols = ["pond_id", "test_order", "value", "status"]
    assert _rows(rep, cols) == _rows(exp, cols)


def test_trend_all_has_one_row_per_cursor(spark):
    from pondlake.fixtures import events_readings as readings
    from tests.conftest import SF_SMALL
    r = readings(spark, SF_SMALL)
    got = S.trend_all(r, ["value", "k"])
    sizes = {row.pond_id: row["count"] for row in r.groupBy("pond_id").count().collect()}
    per = {(row.pond_id, row.sensor): (row.n, row.lo, row.hi) for row in got.groupBy("pond_id", "sensor").agg(
        F.count(F.lit(1)).alias("n"), F.min("cursor").alias("lo"), F.max("cursor").alias("hi")).collect()}
    for (pond, _), (n, lo, hi) in per.items():
        assert (n, lo, hi) == (sizes[pond] - 109, 0, sizes[pond] - 110)
