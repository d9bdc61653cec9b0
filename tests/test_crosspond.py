"""Alignment with a pond too short for the base window, and band edges."""

from pyspark.sql import functions as F

from pondlake.operators import crosspond as C


def _ponds(spark, lengths):
    rows = []
    for pond, n in lengths.items():
        rows += [(pond, i, float(i) + pond * 1000) for i in range(n)]
    df = spark.createDataFrame(rows, "pond_id int, entry_id long, value double")
    return df.withColumn("created_at", F.timestamp_seconds("entry_id"))


def test_short_pond_gets_null_readings(spark):
    df = _ponds(spark, {1: 400, 2: 250, 3: 400})
    # base pond 1: L = 400, tick 200 -> start 200 % 291 = 200 -> positions 200..299
    al = C.align_ponds(df, 1, ["value"], tick=200)
    assert al.count() == 300
    short = al.filter("pond_id = 2")
    assert short.filter("reading IS NULL").count() == 50          # positions 250..299
    stats = C.cross_pond_stats(al).orderBy("pos").collect()
    assert len(stats) == 100
    last = stats[-1]                                              # pos 299: ponds 1 and 3 only
    assert (last["min"], last["max"]) == (1299.0, 3299.0) and last["median"] == 2299.0


def test_band_edges(spark):
    df = spark.createDataFrame([("p", x) for x in (None, 0.0, 100.0, 100.5, 150.0, 150.5, -51.0)],
                               "pond_id string, v double")
    got = {r.band: r.n for r in C.range_profile(df, ["v"], [("v", 50.0, 50.0)]).collect()}
    assert got == {"null": 1, "normal": 2, "outlier": 2, "out_of_range": 2}


def test_median_stats_paths_agree(spark):
    from pondlake.operators.ordinal import group_median_stats
    rows = [(g, float(v) if v is not None else None)
            for g, vs in {1: [3, 1, 2, 8], 2: [5], 3: [None, None], 4: [7, None, 1]}.items() for v in vs]
    df = spark.createDataFrame(rows, "g int, v double")
    small = sorted(group_median_stats(df, ["g"], "v").collect())
    large = sorted(group_median_stats(df, ["g"], "v", small_group_rows=0).collect())
    assert small == large
    assert [tuple(r) for r in small] == [(1, 1.0, 2.5, 8.0), (2, 5.0, 5.0, 5.0), (3, None, None, None),
                                         (4, 1.0, 4.0, 7.0)]
