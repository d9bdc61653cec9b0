"""Drift queries (DRF-1..7) over the E fixture."""

from __future__ import annotations

from pondlake.fixtures import E_REPORT_RANGE, E_SENSORS, drifting_readings, events_readings
from pondlake.operators import drift as D
from pondlake.operators.series import drift_halves
from pondlake.plans.catalog import register
from pondlake.plans.sqltext import E, e_halves, psi_ctes, report_ctes

N = E_REPORT_RANGE
COLS = E_SENSORS
_PSI = e_halves(N) + psi_ctes(COLS)
_REPORT = _PSI + report_ctes(COLS)


def _psi(spark, sf):
    return D.psi(drift_halves(events_readings(spark, sf), N), COLS, bounded=True)


@register("psi", "WITH " + _PSI + "\nSELECT * FROM psi")
def q_psi(spark, sf):
    return _psi(spark, sf)


@register("psi_column_tests", "WITH " + _REPORT + "\nSELECT * FROM tests")
def q_psi_column_tests(spark, sf):
    return D.psi_column_tests(_psi(spark, sf))


@register("drifted_columns", "WITH " + _REPORT + "\nSELECT * FROM drifted")
def q_drifted_columns(spark, sf):
    return D.drifted_columns(_psi(spark, sf))


@register("is_drift", "WITH " + _REPORT + "\nSELECT * FROM verdict")
def q_is_drift(spark, sf):
    return D.is_drift(D.drifted_columns(_psi(spark, sf)))


@register("drift_report", "WITH " + _REPORT + "\nSELECT * FROM report")
def q_drift_report(spark, sf):
    return D.drift_report(_psi(spark, sf), COLS)


@register("monitor", "WITH " + _REPORT + "\nSELECT * FROM report")
def q_monitor(spark, sf):
    return D.monitor(events_readings(spark, sf), COLS, N)


@register("retrain_list", "WITH " + _REPORT + """
SELECT pond_id, value AS drift_share FROM report WHERE test_order = 0 AND status = 'FAIL'""")
def q_retrain_list(spark, sf):
    return D.retrain_list(D.monitor(events_readings(spark, sf), COLS, N))


@register("half_counts", "WITH " + e_halves(N) + """
SELECT pond_id, half, count(*) AS n FROM halves GROUP BY pond_id, half""")
def q_half_counts(spark, sf):
    """AGG-3 for the monitor's halves: rows per pond and half."""
    from pondlake.operators.crosspond import class_counts
    return class_counts(drift_halves(events_readings(spark, sf), N), ["pond_id", "half"])


# The same operators where there is drift and a pond too short to tell.
E_DRIFT = """readings AS (
  SELECT event_type AS pond_id, ts AS created_at, event_id AS entry_id,
         CASE WHEN event_type IN ('click', 'error')
              THEN value + date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) * CAST(10 AS DOUBLE)
              ELSE value END AS value,
         try_cast(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS k
  FROM events WHERE event_type <> 'signup' OR event_id % 40 = 0)"""
_DRIFT_REPORT = _REPORT.replace(E, E_DRIFT)


def _drift_psi(spark, sf):
    return D.psi(drift_halves(drifting_readings(spark, sf), N), COLS, bounded=True)


@register("psi_column_tests_drift", "WITH " + _DRIFT_REPORT + "\nSELECT * FROM tests")
def q_psi_column_tests_drift(spark, sf):
    return D.psi_column_tests(_drift_psi(spark, sf))


@register("is_drift_drift", "WITH " + _DRIFT_REPORT + "\nSELECT * FROM verdict")
def q_is_drift_drift(spark, sf):
    return D.is_drift(D.drifted_columns(_drift_psi(spark, sf)))


@register("monitor_drift", "WITH " + _DRIFT_REPORT + "\nSELECT * FROM report")
def q_monitor_drift(spark, sf):
    return D.monitor(drifting_readings(spark, sf), COLS, N)


@register("retrain_list_drift", "WITH " + _DRIFT_REPORT + """
SELECT pond_id, value AS drift_share FROM report WHERE test_order = 0 AND status = 'FAIL'""")
def q_retrain_list_drift(spark, sf):
    return D.retrain_list(D.monitor(drifting_readings(spark, sf), COLS, N))
