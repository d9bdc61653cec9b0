"""Cross-pond queries (JON-1, AGG-1..4) over fixtures E and D."""

from __future__ import annotations

from pondlake.fixtures import (E_BASE_POND, E_RANGES, E_SENSORS, events_readings,
                               labelled_documents)
from pondlake.operators import crosspond as C
from pondlake.operators.series import row_position, unpivot_sensors
from pondlake.plans.catalog import register
from pondlake.plans.queries_series import TICK
from pondlake.plans.sqltext import E, E_POS, e_cursor

_ALIGN_SQL = e_cursor(TICK) + f""",
axis AS (
  SELECT pos, created_at AS axis_time FROM cursored
  WHERE pond_id = '{E_BASE_POND}' AND pos >= start AND pos < start + 100),
ponds AS (SELECT DISTINCT pond_id FROM readings),
grid AS (SELECT p.pond_id, a.pos, a.axis_time FROM ponds p CROSS JOIN axis a),
aligned AS (
  SELECT g.pos, g.axis_time AS created_at, g.pond_id, 'value' AS sensor, CAST(c.value AS DOUBLE) AS reading
  FROM grid g LEFT JOIN positioned c ON c.pond_id IS NOT DISTINCT FROM g.pond_id AND c.pos = g.pos
  UNION ALL
  SELECT g.pos, g.axis_time, g.pond_id, 'k', CAST(c.k AS DOUBLE)
  FROM grid g LEFT JOIN positioned c ON c.pond_id IS NOT DISTINCT FROM g.pond_id AND c.pos = g.pos)"""


@register("align_ponds", "WITH " + _ALIGN_SQL + "\nSELECT * FROM aligned")
def q_align_ponds(spark, sf):
    return C.align_ponds(events_readings(spark, sf), E_BASE_POND, E_SENSORS, TICK)


@register("aggregate_overview", "WITH " + _ALIGN_SQL + """
SELECT sensor, pos, created_at, min(reading) AS min, median(reading) AS median, max(reading) AS max
FROM aligned GROUP BY sensor, pos, created_at""")
def q_aggregate_overview(spark, sf):
    return C.aggregate_overview(events_readings(spark, sf), E_BASE_POND, E_SENSORS, TICK)


@register("cross_pond_stats", "WITH " + E_POS + """,
long AS (
  SELECT pos, 'value' AS sensor, CAST(value AS DOUBLE) AS reading FROM positioned
  UNION ALL SELECT pos, 'k', CAST(k AS DOUBLE) FROM positioned)
SELECT sensor, pos, min(reading) AS min, median(reading) AS median, max(reading) AS max
FROM long GROUP BY sensor, pos""")
def q_cross_pond_stats(spark, sf):
    # every position of the whole tables, aligned across ponds by position
    readings = events_readings(spark, sf)
    sizes = C.pond_sizes(readings)
    long = unpivot_sensors(row_position(readings, sizes=sizes), E_SENSORS, ["pos", "pond_id"])
    return C.cross_pond_stats(long, keys=["sensor", "pos"], max_ponds=sizes.count())


@register("class_counts", """
SELECT quality, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY quality""")
def q_class_counts(spark, sf):
    return C.class_counts(labelled_documents(spark, sf), "quality")


def _band_sql(sensor: str, avg: float, delta: float) -> str:
    x = f"CAST({sensor} AS DOUBLE)"
    return f"""SELECT pond_id, '{sensor}' AS sensor,
         CASE WHEN {x} IS NULL THEN 'null'
              WHEN abs({x} - {avg}) <= {delta} THEN 'normal'
              WHEN abs({x} - {avg}) <= 2 * {delta} THEN 'outlier'
              ELSE 'out_of_range' END AS band
  FROM readings"""


@register("range_profile", "WITH " + E + ",\nbanded AS (\n  " + "\n  UNION ALL\n  ".join(
    _band_sql(s, a, d) for s, a, d in E_RANGES) + """)
SELECT pond_id, sensor, band, count(*) AS n FROM banded GROUP BY pond_id, sensor, band""")
def q_range_profile(spark, sf):
    return C.range_profile(events_readings(spark, sf), E_SENSORS, E_RANGES)
