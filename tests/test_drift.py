"""PSI properties and report semantics."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pondlake.operators import drift as D

CURRENT, REFERENCE = "current", "reference"


def _halves(spark, ref, cur):
    rows = [("p", REFERENCE, float(x)) for x in ref] + [("p", CURRENT, float(x)) for x in cur]
    return spark.createDataFrame(rows, "pond_id string, half string, x double")


def _psi(spark, ref, cur):
    return D.psi(_halves(spark, ref, cur), ["x"]).first().psi


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=2, max_size=40),
       st.lists(st.integers(0, 30), min_size=2, max_size=40))
def test_psi_nonnegative_and_symmetric(spark, a, b):
    ab, ba = _psi(spark, a, b), _psi(spark, b, a)
    assert ab >= 0
    assert abs(ab - ba) < 1e-9


def test_psi_identical_is_zero(spark):
    xs = list(range(50))
    assert _psi(spark, xs, xs) == 0.0


def test_constant_column_is_zero(spark):
    assert _psi(spark, [3] * 10, [3] * 7) == 0.0


def test_empty_half_is_insufficient(spark):
    halves = _halves(spark, [], [1, 2, 3])
    p = D.psi(halves, ["x"])
    assert p.first().psi is None
    assert D.psi_column_tests(p).first().status == "INSUFFICIENT"


def test_shift_fails_and_drift_verdict(spark):
    ref = list(range(0, 100))
    cur = list(range(60, 160))
    p = D.psi(_halves(spark, ref, cur), ["x"])
    assert D.psi_column_tests(p).first().status == "FAIL"
    rep = D.drift_report(p, ["x"]).orderBy("test_order").collect()
    assert rep[0].test_order == 0 and rep[0].status == "FAIL"      # 1 of 1 columns drifted
    assert rep[1].column_name == "x"
    retrain = D.retrain_list(D.drift_report(p, ["x"])).collect()
    assert [r.pond_id for r in retrain] == ["p"]


def test_report_range_odd_gives_extra_row_to_current(spark):
    from pondlake.operators.series import drift_halves
    df = spark.range(0, 20).select(F.lit("p").alias("pond_id"),
                                   F.timestamp_seconds("id").alias("created_at"),
                                   F.col("id").alias("entry_id"))
    h = drift_halves(df, 7)
    counts = {r.half: r["count"] for r in h.groupBy("half").count().collect()}
    assert counts == {"current": 4, "reference": 3}


def test_text_column_one_bin_per_value(spark):
    rows = [("p", "reference", v) for v in "aaab"] + [("p", "current", v) for v in "abbb"]
    halves = spark.createDataFrame(rows, "pond_id string, half string, s string")
    got = D.psi(halves, ["s"]).first()
    r, c = {"a": 0.75, "b": 0.25}, {"a": 0.25, "b": 0.75}
    import math
    exp = sum((r[k] - c[k]) * math.log(r[k] / c[k]) for k in r)
    assert got.bins is None and abs(got.psi - round(exp, 9)) < 1e-12
    same = D.psi(halves, ["s"], bounded=False).first()
    assert same.psi == got.psi
