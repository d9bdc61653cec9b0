"""The large-group paths as queries of their own: every group is taken by range
partitions and brackets, whatever its size, and one pond has a null id. The
oracles are those of the ordinary queries, so both paths must agree with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondlake.fixtures import E_BASE_POND, E_SENSORS, events_readings
from pondlake.operators import crosspond as C
from pondlake.operators import drift as D
from pondlake.operators import ordinal
from pondlake.operators import series as S
from pondlake.plans.catalog import ORACLE, register
from pondlake.plans import queries_crosspond, queries_drift  # noqa: F401  (their SQL is reused below)
from pondlake.plans.queries_series import TICK, WINDOW_START

NULL_POND = "view"


def forced(build: Callable[[], DataFrame]) -> DataFrame:
    """Build a plan as if every group were over the size that one task may hold."""
    before, ordinal.SMALL_GROUP_ROWS = ordinal.SMALL_GROUP_ROWS, 0
    try:
        return build()
    finally:
        ordinal.SMALL_GROUP_ROWS = before


def null_pond_readings(spark, sf) -> DataFrame:
    r = events_readings(spark, sf)
    return r.withColumn("pond_id", F.when(F.col("pond_id") != NULL_POND, F.col("pond_id")))


def _sql(name: str) -> str:
    return ORACLE[name].replace("event_type AS pond_id", f"nullif(event_type, '{NULL_POND}') AS pond_id", 1)


@register("row_position_large", _sql("row_position"))
def q_row_position_large(spark, sf):
    return forced(lambda: S.row_position(null_pond_readings(spark, sf)))


@register("horizon_value_large", _sql("horizon_value"))
def q_horizon_value_large(spark, sf):
    return forced(lambda: S.horizon_value(null_pond_readings(spark, sf), E_SENSORS))


@register("sliding_window_large", _sql("sliding_window"))
def q_sliding_window_large(spark, sf):
    return forced(lambda: S.sliding_window(null_pond_readings(spark, sf), WINDOW_START))


@register("trend_all_large", _sql("trend_all"))
def q_trend_all_large(spark, sf):
    return forced(lambda: S.trend_all(null_pond_readings(spark, sf), E_SENSORS))


@register("overview_large", _sql("overview"))
def q_overview_large(spark, sf):
    return forced(lambda: S.overview(null_pond_readings(spark, sf), E_SENSORS, TICK))


@register("pond_stats_large", f"""
SELECT pond_id, sensor, min(reading) AS min, median(reading) AS median, max(reading) AS max FROM (
  SELECT nullif(event_type, '{NULL_POND}') AS pond_id, 'value' AS sensor, CAST(value AS DOUBLE) AS reading FROM events
  UNION ALL
  SELECT nullif(event_type, '{NULL_POND}'), 'k', try_cast(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) FROM events)
GROUP BY pond_id, sensor""")
def q_pond_stats_large(spark, sf):
    long = S.unpivot_sensors(null_pond_readings(spark, sf), E_SENSORS, ["pond_id"])
    return forced(lambda: C.cross_pond_stats(long, keys=["pond_id", "sensor"]))


@register("psi_join_null", _sql("psi"))
def q_psi_join_null(spark, sf):
    """The ranges by an aggregate and a join, as for halves beyond ``WINDOW_ROWS``."""
    return D.psi(S.drift_halves(null_pond_readings(spark, sf), queries_drift.N), E_SENSORS)


@register("length_guard_null", f"""
WITH e AS (SELECT nullif(event_type, '{NULL_POND}') AS pond_id, event_id AS entry_id FROM events)
SELECT * FROM e WHERE EXISTS (
  SELECT 1 FROM (SELECT pond_id FROM e GROUP BY pond_id HAVING count(*) >= 110) k
  WHERE k.pond_id IS NOT DISTINCT FROM e.pond_id)""")
def q_length_guard_null(spark, sf):
    return S.length_guard(null_pond_readings(spark, sf).select("pond_id", "entry_id"))


@register("align_ponds_null", _sql("align_ponds"))
def q_align_ponds_null(spark, sf):
    return C.align_ponds(null_pond_readings(spark, sf), E_BASE_POND, E_SENSORS, TICK)


@register("aggregate_overview_large", _sql("aggregate_overview"))
def q_aggregate_overview_large(spark, sf):
    return forced(lambda: C.aggregate_overview(null_pond_readings(spark, sf), E_BASE_POND, E_SENSORS, TICK))
