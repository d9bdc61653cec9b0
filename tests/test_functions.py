"""Column functions: parsing rules and their edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pondlake.functions import parse as P


def test_lenient_ts_tries_each_format_per_row(spark):
    df = spark.createDataFrame([("31/01/2024 10:00:00",), ("2024-02-01 11:00:00",), ("junk",)], "t string")
    one = [r.t for r in P.lenient_ts(df, "t").collect()]
    assert one == [dt.datetime(2024, 1, 31, 10), None, None]       # the reference: one format
    two = [r.t for r in P.lenient_ts(df, "t", ["dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]).collect()]
    assert two == [dt.datetime(2024, 1, 31, 10), dt.datetime(2024, 2, 1, 11), None]


def test_strict_ts_fails_on_bad_text(spark):
    df = spark.createDataFrame([("31/01/2024 10:00:00",), ("31/02/2024 10:00:00",)], "t string")
    with pytest.raises(Exception, match="cannot parse time t"):
        df.select(P.strict_ts("t")).collect()


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert [r.x for r in P.nan_to_null(df, ["x"]).collect()] == [None, 1.0, None]


def test_repair_rules_by_pond_and_for_all(spark):
    df = spark.createDataFrame([(4, "Jan-00"), (5, "Jan-00")], "pond_id int, v string")
    only4 = [r.v for r in P.repair_literal(df, [(4, "Jan-00", "12.45")]).orderBy("pond_id").collect()]
    assert only4 == ["12.45", "Jan-00"]
    every = [r.v for r in P.repair_literal(df, [(None, "Jan-00", "12.45")]).collect()]
    assert every == ["12.45", "12.45"]


def test_pond_id_from_name(spark):
    df = spark.createDataFrame([("IoTPond12.csv",), ("iot_pond_3_v2.csv",)], "f string")
    assert [r.p for r in df.select(P.pond_id_from_name(F.col("f")).alias("p")).collect()] == [12, 3]
    bad = spark.createDataFrame([("IoTPond.csv",)], "f string")
    with pytest.raises(Exception, match="no pond number"):
        bad.select(P.pond_id_from_name(F.col("f"))).collect()


def test_lenient_numeric_skips_absent_columns(spark):
    df = spark.createDataFrame([("1.5", "x")], "a string, b string")
    out = P.lenient_numeric(df, ["a", "b", "missing"]).first()
    assert out.a == 1.5 and out.b is None


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e3, 1e3, allow_nan=False), st.floats(-1e3, 1e3, allow_nan=False)),
                min_size=1, max_size=30))
def test_trend_is_antisymmetric_under_negation(spark, pairs):
    from pondlake.operators.series import trend
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    pos = {r.i: r.trend for r in trend(df, "a", "b").collect()}
    neg = {r.i: r.trend for r in trend(df.select("i", (-F.col("a")).alias("a"),
                                                 (-F.col("b")).alias("b")), "a", "b").collect()}
    flip = {"up": "down", "down": "up", "flat": "flat"}
    assert all(neg[i] == flip[pos[i]] for i in pos)
