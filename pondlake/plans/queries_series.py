"""Series queries (PRJ-10/13/14, FLT-6, SRT-1..5, WIN-1..8) over fixtures E and L."""

from __future__ import annotations

from pyspark.sql import functions as F

from pondlake.fixtures import E_REPORT_RANGE, E_SENSORS, L_SENSORS, events_readings, lineitem, table
from pondlake.operators import series as S
from pondlake.plans.catalog import register
from pondlake.plans.sqltext import E, E_POS, e_cursor, e_halves

N = E_REPORT_RANGE
TICK = 1234          # refreshes since the dashboard opened
WINDOW_START = 250   # a fixed cursor for the sliding-window query
DETAIL_POND = "click"


@register("select_columns", "WITH " + E + "\nSELECT pond_id, entry_id, value, k FROM readings")
def q_select_columns(spark, sf):
    return S.select_columns(events_readings(spark, sf), E_SENSORS, keys=["pond_id", "entry_id"])


@register("format_reading", "WITH " + E + """
SELECT *, printf('%.2f', value) AS value_text, printf('%.2f', k) AS k_text FROM readings""")
def q_format_reading(spark, sf):
    return S.format_reading(events_readings(spark, sf), E_SENSORS)


_L_IDS = "l_orderkey, l_linenumber, l_returnflag AS pond_id"


@register("unpivot_sensors", "\nUNION ALL\n".join(
    f"SELECT {_L_IDS}, '{s}' AS sensor, CAST({s} AS DOUBLE) AS reading FROM lineitem"
    for s in L_SENSORS))
def q_unpivot_sensors(spark, sf):
    li = lineitem(spark, sf).withColumnRenamed("l_returnflag", "pond_id")
    return S.unpivot_sensors(li, L_SENSORS, ["l_orderkey", "l_linenumber", "pond_id"])


@register("sort_by_time", "WITH " + E + "\nSELECT * FROM readings ORDER BY pond_id, created_at, entry_id")
def q_sort_by_time(spark, sf):
    return S.sort_by_time(events_readings(spark, sf))


@register("newest_n", "WITH " + E + f"""
SELECT * FROM readings ORDER BY created_at DESC NULLS FIRST, entry_id DESC LIMIT {N}""")
def q_newest_n(spark, sf):
    return S.newest_n(events_readings(spark, sf), N)


@register("newest_n_per_pond", "WITH " + e_halves(N) + "\nSELECT * EXCLUDE (half) FROM halves")
def q_newest_n_per_pond(spark, sf):
    return S.newest_n_per_pond(events_readings(spark, sf), N)


@register("drift_halves", "WITH " + e_halves(N) + "\nSELECT * FROM halves")
def q_drift_halves(spark, sf):
    return S.drift_halves(events_readings(spark, sf), N)


@register("latest_per_pond", "WITH " + E + """
SELECT pond_id, created_at, entry_id, value, k FROM (
  SELECT *, row_number() OVER (PARTITION BY pond_id ORDER BY created_at DESC, entry_id DESC) AS rn
  FROM readings) WHERE rn = 1""")
def q_latest_per_pond(spark, sf):
    return S.latest_per_pond(events_readings(spark, sf))


@register("row_position", "WITH " + E_POS + "\nSELECT * EXCLUDE (n_rows) FROM positioned")
def q_row_position(spark, sf):
    return S.row_position(events_readings(spark, sf))


@register("cursor_position", "WITH " + E + f"""
SELECT pond_id, count(*) AS n_rows, {TICK} % (count(*) - 109) AS start
FROM readings GROUP BY pond_id HAVING count(*) >= 110""")
def q_cursor_position(spark, sf):
    return S.cursor_position(events_readings(spark, sf), TICK)


@register("length_guard", """
SELECT 'event_type' AS keyed_by, event_type AS pond_id, count(*) AS n_rows,
       CASE WHEN count(*) >= 110 THEN 'kept' ELSE 'skipped' END AS status
FROM events GROUP BY event_type
UNION ALL
SELECT 'user_id', CAST(user_id AS VARCHAR), count(*),
       CASE WHEN count(*) >= 110 THEN 'kept' ELSE 'skipped' END
FROM events GROUP BY user_id""")
def q_length_guard(spark, sf):
    ev = table(spark, sf, "events")
    by_type = S.length_report(ev.withColumn("pond_id", F.col("event_type")))
    by_user = S.length_report(ev.withColumn("pond_id", F.col("user_id").cast("string")))
    return (by_type.select(F.lit("event_type").alias("keyed_by"), "*")
            .unionByName(by_user.select(F.lit("user_id").alias("keyed_by"), "*")))


@register("length_guard_rows", """
SELECT e.*, 'event_type' AS keyed_by FROM events e
WHERE event_type IN (SELECT event_type FROM events GROUP BY event_type HAVING count(*) >= 110)
UNION ALL
SELECT e.*, 'user_id' FROM events e
WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 110)""")
def q_length_guard_rows(spark, sf):
    ev = table(spark, sf, "events")
    by_type = S.length_guard(ev.withColumn("pond_id", F.col("event_type")))
    by_user = S.length_guard(ev.withColumn("pond_id", F.col("user_id")))
    return (by_type.drop("pond_id").withColumn("keyed_by", F.lit("event_type"))
            .unionByName(by_user.drop("pond_id").withColumn("keyed_by", F.lit("user_id"))))


@register("sliding_window", "WITH " + E_POS + f"""
SELECT * EXCLUDE (n_rows),
       CASE WHEN pos < {WINDOW_START + 100} THEN 'history' ELSE 'horizon' END AS segment
FROM positioned WHERE pos >= {WINDOW_START} AND pos < {WINDOW_START + 110}""")
def q_sliding_window(spark, sf):
    return S.sliding_window(events_readings(spark, sf), WINDOW_START)


_HORIZON_SQL = E_POS + """,
hv AS (
  SELECT * EXCLUDE (n_rows),
         lead(value, 10) OVER (PARTITION BY pond_id ORDER BY pos) AS value_future,
         lead(k, 10) OVER (PARTITION BY pond_id ORDER BY pos) AS k_future
  FROM positioned)"""


@register("horizon_value", "WITH " + _HORIZON_SQL + "\nSELECT * FROM hv")
def q_horizon_value(spark, sf):
    return S.horizon_value(events_readings(spark, sf), E_SENSORS)


@register("trend", "WITH " + _HORIZON_SQL + """
SELECT *, value_future - value AS delta,
       CASE WHEN value_future - value > 0.01 THEN 'up'
            WHEN value_future - value < -0.01 THEN 'down' ELSE 'flat' END AS trend
FROM hv""")
def q_trend(spark, sf):
    return S.trend(S.horizon_value(events_readings(spark, sf), E_SENSORS), "value", "value_future")


_TREND_ALL_SQL = E_POS + """,
pairs AS (
  SELECT pond_id, pos, created_at, value, k,
         lead(value, 10) OVER w AS value_future, lead(k, 10) OVER w AS k_future,
         lead(pos, 10) OVER w AS pos_future
  FROM positioned WINDOW w AS (PARTITION BY pond_id ORDER BY pos)),
long AS (
  SELECT pond_id, 'value' AS sensor, pos, created_at, value AS latest, value_future AS future
  FROM pairs WHERE pos >= 99 AND pos_future IS NOT NULL
  UNION ALL
  SELECT pond_id, 'k', pos, created_at, k, k_future
  FROM pairs WHERE pos >= 99 AND pos_future IS NOT NULL)
SELECT pond_id, sensor, pos - 99 AS cursor, created_at, latest, future, future - latest AS delta,
       CASE WHEN future - latest > 0.01 THEN 'up' WHEN future - latest < -0.01 THEN 'down'
            ELSE 'flat' END AS trend
FROM long"""


@register("trend_all", "WITH " + _TREND_ALL_SQL)
def q_trend_all(spark, sf):
    return S.trend_all(events_readings(spark, sf), E_SENSORS)


_OVERVIEW_SQL = e_cursor(TICK) + """,
two AS (
  SELECT *, pos = start + 99 AS is_latest FROM cursored
  WHERE pos = start + 99 OR pos = start + 109),
long AS (
  SELECT pond_id, start, 'value' AS sensor, is_latest, created_at, value AS reading FROM two
  UNION ALL
  SELECT pond_id, start, 'k', is_latest, created_at, k FROM two),
agg AS (
  SELECT pond_id, sensor, start,
         max(CASE WHEN is_latest THEN created_at END) AS created_at,
         max(CASE WHEN is_latest THEN reading END) AS latest,
         max(CASE WHEN NOT is_latest THEN reading END) AS future
  FROM long GROUP BY pond_id, sensor, start)
SELECT *, future - latest AS delta,
       CASE WHEN future - latest > 0.01 THEN 'up' WHEN future - latest < -0.01 THEN 'down'
            ELSE 'flat' END AS trend
FROM agg"""


@register("overview", "WITH " + _OVERVIEW_SQL)
def q_overview(spark, sf):
    return S.overview(events_readings(spark, sf), E_SENSORS, TICK)


@register("pond_detail", "WITH " + e_cursor(TICK) + f""",
win AS (
  SELECT *, CASE WHEN pos < start + 100 THEN 'history' ELSE 'horizon' END AS segment,
         pos = start + 99 AS is_latest
  FROM cursored WHERE pond_id = '{DETAIL_POND}' AND pos >= start AND pos < start + 110)
SELECT pond_id, segment, pos, created_at, entry_id, is_latest, 'value' AS sensor,
       CAST(value AS DOUBLE) AS reading FROM win
UNION ALL
SELECT pond_id, segment, pos, created_at, entry_id, is_latest, 'k', CAST(k AS DOUBLE) FROM win""")
def q_pond_detail(spark, sf):
    return S.pond_detail(events_readings(spark, sf), DETAIL_POND, E_SENSORS, TICK)
