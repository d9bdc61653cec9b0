"""Cross-pond operators: positional alignment, row-wise statistics across
ponds, class counts and value-range bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondlake.operators.ordinal import group_median_stats, group_sizes, join_groups
from pondlake.operators.series import POND, TIME_ORDER, _rows_at, cursor_expr, unpivot_sensors
from pondlake.schema import FORECAST_HORIZON, WINDOW_SIZE


def align_ponds(df: DataFrame, base_pond, sensors: Sequence[str], tick: int,
                size: int = WINDOW_SIZE, horizon: int = FORECAST_HORIZON,
                sizes: DataFrame | None = None) -> DataFrame:
    """JON-1: every pond's reading at the row positions of the base pond's
    window at ``tick``; the time axis is the base pond's.

    Long form ``(pos, created_at, pond_id, sensor, reading)``.  Only the rows
    at those ``size`` positions are selected from each pond (no sort of the
    whole table); the axis has exactly ``size`` rows, so it is broadcast by
    construction.  A pond too short to reach a position gets a null reading
    there (the reference raised KeyError).  The table is read twice: for the
    ponds' sizes (the key column; ``sizes`` of ``pond_sizes`` saves it), which
    give the base length, the list of ponds and the routing, and for the rows.
    Of a table with a zone map only the files that hold the positions are read.
    """
    narrow = df.select(POND, *TIME_ORDER, *sensors)
    sizes = pond_sizes(df) if sizes is None else sizes
    base_rows = F.coalesce(sizes.filter(F.col(POND).eqNullSafe(F.lit(base_pond))).select("__L").scalar(), F.lit(0))
    start = cursor_expr(base_rows, tick, size, horizon)
    first = F.when(base_rows >= size + horizon, start)
    picked = _rows_at(narrow, lambda n_rows: (first, first + size), sizes)
    axis = (picked.filter(F.col(POND).eqNullSafe(F.lit(base_pond)))
                  .select("pos", F.col("created_at").alias("axis_time")))
    # every pond at every axis position (the positions are generated per pond,
    # not paired by a join); a pond too short for a position keeps null readings
    grid = sizes.select(POND, F.explode(F.sequence(first, first + size - 1)).alias("pos"))
    readings = picked.select(POND, "pos", *[F.col(f"`{c}`") for c in sensors])
    aligned = join_groups(grid, readings, [POND, "pos"], "left").join(F.broadcast(axis), "pos")
    long = unpivot_sensors(aligned, sensors, ["pos", "axis_time", POND])
    return long.withColumnRenamed("axis_time", "created_at")


def pond_sizes(df: DataFrame) -> DataFrame:
    """Rows per pond, materialised: one row per pond (columns ``pond_id, __L``); from
    the zone map of a table that has one."""
    if hasattr(df, "sizes"):
        return df.sizes()
    return group_sizes(df.select(POND), [POND])


def cross_pond_stats(aligned: DataFrame, keys: Sequence[str] = ("sensor", "pos", "created_at"),
                     max_ponds: int | None = None) -> DataFrame:
    """AGG-1: min / median / max across ponds at each position and sensor;
    missing readings are ignored, all missing gives null.  One aggregate with
    the exact median for groups of ordinary size; a position shared by more
    than ``ordinal.SMALL_GROUP_ROWS`` ponds selects only its middle readings
    (``ordinal.group_median_stats``), so their readings never meet in one
    task.  ``max_ponds``, if known, bounds the groups and saves sizing them."""
    return group_median_stats(aligned, list(keys), "reading", max_rows=max_ponds)


def aggregate_overview(df: DataFrame, base_pond, sensors: Sequence[str], tick: int,
                       size: int = WINDOW_SIZE, horizon: int = FORECAST_HORIZON) -> DataFrame:
    """AGG-2: JON-1 then AGG-1 for every sensor in one job; a position has at most
    one reading per pond."""
    sizes = pond_sizes(df)
    return cross_pond_stats(align_ponds(df, base_pond, sensors, tick, size, horizon, sizes),
                            max_ponds=sizes.count())


def class_counts(df: DataFrame, label: str | Sequence[str], count_col: str = "n") -> DataFrame:
    """AGG-3: rows per class, or per any key list (partial aggregation, skew-safe)."""
    keys = [label] if isinstance(label, str) else list(label)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))


def band_expr(x, avg, delta):
    """The band of a reading against ``average ± delta``: ``null``, ``normal``
    (within delta), ``outlier`` (within twice delta) or ``out_of_range``."""
    dev = F.abs(x - avg)
    return (F.when(x.isNull(), F.lit("null"))
             .when(dev <= delta, F.lit("normal"))
             .when(dev <= 2 * delta, F.lit("outlier"))
             .otherwise(F.lit("out_of_range")))


def range_profile(df: DataFrame, sensors: Sequence[str],
                  ranges: Sequence[tuple[str, float, float]]) -> DataFrame:
    """AGG-4: per pond and sensor, rows in each band.  The ranges are a
    literal map looked up per row (no join), then one partial aggregate."""
    known = {s for s, _, _ in ranges}
    missing = [s for s in sensors if s not in known]
    if missing:
        raise ValueError(f"no range for sensors {missing}")
    avg_map = F.create_map(*[x for s, a, _ in ranges for x in (F.lit(s), F.lit(float(a)))])
    delta_map = F.create_map(*[x for s, _, d in ranges for x in (F.lit(s), F.lit(float(d)))])
    long = unpivot_sensors(df, sensors, [POND])
    banded = long.select(POND, "sensor", band_expr(
        F.col("reading"), F.element_at(avg_map, F.col("sensor")),
        F.element_at(delta_map, F.col("sensor"))).alias("band"))
    return banded.groupBy(POND, "sensor", "band").agg(F.count(F.lit(1)).alias("n"))
