"""Requests on a stored table with a zone map (``sources.pond_files``): each writes the
fixture as a time-clustered table, maps its files and then reads only those it
needs. The oracles are those of the ordinary queries."""

from __future__ import annotations

import uuid

from pondlake.fixtures import E_BASE_POND, E_REPORT_RANGE, E_SENSORS, events_readings
from pondlake.operators import crosspond as C
from pondlake.operators import drift as D
from pondlake.operators import series as S
from pondlake.plans import queries_crosspond, queries_drift, queries_large  # noqa: F401  (their SQL is reused below)
from pondlake.plans.catalog import ORACLE, register
from pondlake.plans.queries_series import DETAIL_POND, TICK, WINDOW_START
from pondlake.session import ensure_checkpoint_dir
from pondlake.sources.pond_files import PondFiles, write_clustered

ROWS_PER_FILE = 500


def stored(spark, readings) -> PondFiles:
    """``readings`` as a stored table under the shared folder, with its zone map."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pondlake-tables/{uuid.uuid4().hex[:12]}"
    write_clustered(readings, f"{root}/rows", ROWS_PER_FILE)
    return PondFiles(spark, f"{root}/rows", f"{root}/zones").refresh()


@register("monitor_pruned", ORACLE["monitor"])
def q_monitor_pruned(spark, sf):
    return D.monitor(stored(spark, events_readings(spark, sf)), E_SENSORS, E_REPORT_RANGE)


@register("newest_n_pruned", ORACLE["newest_n_per_pond"])
def q_newest_n_pruned(spark, sf):
    return S.newest_n_per_pond(stored(spark, events_readings(spark, sf)), E_REPORT_RANGE)


@register("sliding_window_indexed", ORACLE["sliding_window"])
def q_sliding_window_indexed(spark, sf):
    return S.sliding_window(stored(spark, events_readings(spark, sf)), WINDOW_START)


@register("overview_indexed", queries_large._sql("overview"))
def q_overview_indexed(spark, sf):
    return S.overview(stored(spark, queries_large.null_pond_readings(spark, sf)), E_SENSORS, TICK)


@register("pond_detail_indexed", ORACLE["pond_detail"])
def q_pond_detail_indexed(spark, sf):
    return S.pond_detail(stored(spark, events_readings(spark, sf)), DETAIL_POND, E_SENSORS, TICK)


@register("align_ponds_indexed", queries_large._sql("align_ponds"))
def q_align_ponds_indexed(spark, sf):
    return C.align_ponds(stored(spark, queries_large.null_pond_readings(spark, sf)), E_BASE_POND, E_SENSORS, TICK)


@register("aggregate_overview_indexed", ORACLE["aggregate_overview"])
def q_aggregate_overview_indexed(spark, sf):
    return C.aggregate_overview(stored(spark, events_readings(spark, sf)), E_BASE_POND, E_SENSORS, TICK)
