"""Time-series operators over readings: sorts, newest rows, positions, sliding
windows, horizon values and trends.

A readings frame has ``pond_id``, ``created_at``, ``entry_id`` and sensor
columns.  Time order inside a pond is ``(created_at, entry_id)``; the second key
makes it total.  No window here spans a large pond: positions, leads and
window rows come from ``ordinal`` (a window per pond only for ponds of at most
``ordinal.SMALL_GROUP_ROWS`` rows), and per-pond top-N is a two-level limit
tree salted by map task, so one pond holding most rows is still split across
tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pondlake.operators.ordinal import (broadcast_if_bounded, join_groups, rows_at_positions,
                                        with_lead, with_position)
from pondlake.schema import FORECAST_HORIZON, MIN_SERIES_ROWS, TREND_EPSILON, WINDOW_SIZE
from pondlake.session import cut_lineage

POND = "pond_id"
TIME_ORDER = ["created_at", "entry_id"]


def _newest_first() -> list[Column]:
    # PostgreSQL puts nulls first under DESC; keep that for the newest-N cut.
    return [F.col("created_at").desc_nulls_first(), F.col("entry_id").desc_nulls_last()]


def _rows_at(source, bounds, sizes: DataFrame | None = None) -> DataFrame:
    """Rows at positions ``bounds(pond size)``: from the files that hold them where
    ``source`` is a table with a zone map (``sources.pond_files.PondFiles``), else
    by ``ordinal.rows_at_positions``."""
    if hasattr(source, "at_positions"):
        return source.at_positions(bounds)
    return rows_at_positions(source, [POND], "created_at", ["entry_id"], bounds, sizes=sizes)


# --------------------------------------------------------------------------- PRJ


def select_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """PRJ-10: keep ``keys`` + ``columns``; an unknown name raises (AnalysisException)."""
    return df.select(*keys, *[F.col(f"`{c}`") for c in columns])


def unpivot_sensors(df: DataFrame, sensors: Sequence[str], ids: Sequence[str],
                    name_col: str = "sensor", value_col: str = "reading") -> DataFrame:
    """PRJ-14: one ``(ids..., sensor, reading)`` row per sensor value.

    Sensors are cast to double first so mixed integer/float sensors unpivot."""
    cast = df.select(*ids, *[F.col(f"`{s}`").cast("double").alias(s) for s in sensors])
    return cast.unpivot(list(ids), list(sensors), name_col, value_col)


def format_reading(df: DataFrame, cols: Sequence[str], suffix: str = "_text") -> DataFrame:
    """PRJ-13: a two-decimal text rendering next to each reading."""
    return df.select("*", *[F.format_string("%.2f", F.col(f"`{c}`")).alias(c + suffix)
                            for c in cols])


# --------------------------------------------------------------------------- SRT


def sort_by_time(df: DataFrame) -> DataFrame:
    """SRT-1: ascending time order (range-partitioned global sort)."""
    return df.orderBy(POND, *TIME_ORDER)


def newest_n(df: DataFrame, n: int) -> DataFrame:
    """SRT-2: the newest ``n`` rows of the whole table (nulls first, as the
    database does under DESC).  Two levels: each map task keeps its own newest
    ``n``, salts of them are merged, and the last merge gets ``n`` rows per salt
    however many tasks there are. Of a table with a zone map only the files that
    can hold them are read."""
    if hasattr(df, "newest"):
        df = df.newest(n, per_pond=False)
    salts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = salted.withColumn("_rn0", F.row_number().over(
        Window.partitionBy("_salt").orderBy(*_newest_first()))).filter(F.col("_rn0") <= n)
    return first.drop("_salt", "_rn0").orderBy(*_newest_first()).limit(n)


def newest_n_per_pond(df: DataFrame, n: int, salt_buckets: int | None = None,
                      rn_col: str = "rn") -> DataFrame:
    """SRT-3: the newest ``n`` rows of every pond, ``rn`` = 1 for the newest.

    A two-level top-N tree.  Each map task first keeps its own newest ``n``
    rows per pond (the partial ``WindowGroupLimit`` before the shuffle); the
    salt is the map task's partition id modulo ``S``, so level one merges the
    survivors of ``M/S`` tasks per (pond, salt) and level two at most ``S * n``
    rows per pond.  ``S`` defaults to the shuffle-partition count: level one
    then receives ``M/S * n`` rows per (pond, salt) and level two ``S * n``
    rows per pond, both independent of how large the pond is.  Of a table with a
    zone map (``PondFiles``) only the files that can hold them are read.
    """
    if hasattr(df, "newest"):
        df = df.newest(n)
    if salt_buckets is None:
        salt_buckets = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salt_buckets)))
    first = (salted.withColumn("_rn0", F.row_number().over(
                Window.partitionBy(POND, "_salt").orderBy(*_newest_first())))
                   .filter(F.col("_rn0") <= n).drop("_rn0", "_salt"))
    final = first.withColumn(rn_col, F.row_number().over(
        Window.partitionBy(POND).orderBy(*_newest_first())).cast("bigint"))
    return final.filter(F.col(rn_col) <= n)


def drift_halves(df: DataFrame, n: int, rn_col: str = "rn", half_col: str = "half") -> DataFrame:
    """SRT-4: newest ``n`` rows per pond split in two.  The first ``h`` rows
    (newest) are ``current``, the rest ``reference``; ``h`` is half the requested
    ``n`` rounded up, so a short table gets a short or empty reference half."""
    h = (n + 1) // 2
    top = newest_n_per_pond(df, n, rn_col=rn_col)
    return top.withColumn(half_col, F.when(F.col(rn_col) <= h, F.lit("current"))
                          .otherwise(F.lit("reference")))


def latest_per_pond(df: DataFrame) -> DataFrame:
    """SRT-5: the newest row of each pond, as a partial (map-side) aggregate."""
    cols = [c for c in df.columns if c != POND]
    picked = df.groupBy(POND).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]),
                 F.struct(*[F.col(c) for c in TIME_ORDER])).alias("_row"))
    return picked.select(POND, *[F.col("_row").getField(c).alias(c) for c in cols])


# --------------------------------------------------------------------------- WIN


def row_position(df: DataFrame, pos_col: str = "pos", count_col: str | None = None,
                 sizes: DataFrame | None = None) -> DataFrame:
    """WIN-1: 0-based position in time order within each pond."""
    return with_position(df, [POND], TIME_ORDER, pos_col=pos_col, count_col=count_col, sizes=sizes)


def cursor_expr(n_rows: Column, tick: int, size: int = WINDOW_SIZE,
                horizon: int = FORECAST_HORIZON) -> Column:
    """WIN-3: the window start after ``tick`` refreshes: it advances by one per
    refresh and wraps to 0 past ``L - (size + horizon)``."""
    return F.pmod(F.lit(tick), n_rows - F.lit(size + horizon - 1))


def cursor_position(df: DataFrame, tick: int, size: int = WINDOW_SIZE,
                    horizon: int = FORECAST_HORIZON) -> DataFrame:
    """WIN-3 as a table: ``(pond_id, n_rows, start)`` for ponds long enough."""
    counts = df.groupBy(POND).agg(F.count(F.lit(1)).alias("n_rows"))
    counts = counts.filter(F.col("n_rows") >= size + horizon)
    return counts.withColumn("start", cursor_expr(F.col("n_rows"), tick, size, horizon))


def length_guard(df: DataFrame, min_rows: int = MIN_SERIES_ROWS) -> DataFrame:
    """FLT-6: drop ponds with fewer than ``min_rows`` rows.  The per-pond counts
    are a map-side aggregate (materialised, one row per pond); the kept keys are
    broadcast when counted small, so the rows are not shuffled; a table with a
    zone map counts by that."""
    if hasattr(df, "at_least"):
        return df.at_least(min_rows)
    counts = df.groupBy(POND).agg(F.count(F.lit(1)).alias("_n"))
    keep = cut_lineage(counts.filter(F.col("_n") >= min_rows).select(POND), small=True)
    return join_groups(df, broadcast_if_bounded(keep), [POND], "left_semi")


def length_report(df: DataFrame, min_rows: int = MIN_SERIES_ROWS) -> DataFrame:
    """FLT-6 messages: ``(pond_id, n_rows, status)`` with ``kept`` / ``skipped``."""
    counts = df.groupBy(POND).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("status", F.when(F.col("n_rows") >= min_rows, F.lit("kept"))
                             .otherwise(F.lit("skipped")))


def window_rows(df: DataFrame, tick: int, first: int, last: int, size: int = WINDOW_SIZE,
                horizon: int = FORECAST_HORIZON) -> DataFrame:
    """Rows at positions ``start+first .. start+last`` of every pond long
    enough, ``start`` being the cursor at ``tick``; adds ``pos``, ``n_rows`` and
    ``start``.  Exact selection (``ordinal.rows_at_positions``): small ponds
    by a window per pond, large ponds by ranking only a bracket around the
    wanted positions, never the whole pond."""
    def bounds(n_rows):
        start = cursor_expr(n_rows, tick, size, horizon)
        return (F.when(n_rows >= size + horizon, start + first), start + last + 1)
    rows = _rows_at(df, bounds)
    return rows.withColumn("start", cursor_expr(F.col("n_rows"), tick, size, horizon))


def sliding_window(df: DataFrame, start: int, size: int = WINDOW_SIZE,
                   horizon: int = FORECAST_HORIZON) -> DataFrame:
    """WIN-2: rows at positions ``[start, start+size)`` (``history``) and
    ``[start+size, start+size+horizon)`` (``horizon``) of every pond."""
    win = _rows_at(df, lambda n_rows: (F.lit(start), F.lit(start + size + horizon)))
    win = win.drop("n_rows")
    return win.withColumn("segment", F.when(F.col("pos") < start + size, F.lit("history"))
                          .otherwise(F.lit("horizon")))


def horizon_value(df: DataFrame, cols: Sequence[str], h: int = FORECAST_HORIZON,
                  suffix: str = "_future") -> DataFrame:
    """WIN-4: the reading ``h`` rows later in the same pond (an observed later
    row, not a forecast); null where the series ends.  ``ordinal.with_lead``:
    a window per pond for small ponds; for large ponds a window per
    range-partition run plus a small table of run heads."""
    return with_lead(df, [POND], TIME_ORDER, cols, h, suffix=suffix)


def trend_expr(latest: Column, future: Column, eps: float = TREND_EPSILON) -> Column:
    """WIN-5: ``up`` / ``down`` / ``flat`` on ``future - latest`` with a dead band;
    a missing delta (null or NaN) is ``flat``."""
    delta = (future - latest).cast("double")
    delta = F.when(~F.isnan(delta), delta)
    return (F.when(delta > eps, F.lit("up"))
             .when(delta < -eps, F.lit("down"))
             .otherwise(F.lit("flat")))


def trend(df: DataFrame, latest: str, future: str, eps: float = TREND_EPSILON,
          out: str = "trend") -> DataFrame:
    """WIN-5 on two columns of a frame."""
    return df.select("*", (F.col(future) - F.col(latest)).alias("delta"),
                     trend_expr(F.col(latest), F.col(future), eps).alias(out))


def unpivot_pairs(df: DataFrame, sensors: Sequence[str], ids: Sequence[str],
                  suffix: str, left: str, right: str) -> DataFrame:
    """Unpivot ``sensor`` and ``sensor+suffix`` together into
    ``(ids..., sensor, left, right)`` in one pass (no join)."""
    rows = F.array(*[F.struct(F.lit(s).alias("sensor"),
                              F.col(f"`{s}`").cast("double").alias(left),
                              F.col(f"`{s}{suffix}`").cast("double").alias(right))
                     for s in sensors])
    return df.select(*ids, F.inline(rows))


def trend_all(df: DataFrame, sensors: Sequence[str], size: int = WINDOW_SIZE,
              horizon: int = FORECAST_HORIZON, eps: float = TREND_EPSILON) -> DataFrame:
    """WIN-6: the trend every cursor ``0 .. L-size-horizon`` would show, per
    pond and sensor: latest = row ``cursor+size-1``, future = ``horizon`` rows on."""
    narrow = df.select(POND, *TIME_ORDER, *sensors)
    pairs = with_lead(narrow, [POND], TIME_ORDER, sensors, horizon, suffix="_future",
                      count_col="n_rows")
    # cursors 0 .. L-size-horizon: latest at pos >= size-1 with a partner
    pairs = pairs.filter((F.col("pos") >= size - 1) & (F.col("pos") + horizon < F.col("n_rows")))
    long = unpivot_pairs(pairs, sensors, [POND, "pos", "created_at"], "_future",
                         "latest", "future")
    return long.select(
        POND, "sensor", (F.col("pos") - F.lit(size - 1)).alias("cursor"), "created_at",
        "latest", "future", (F.col("future") - F.col("latest")).alias("delta"),
        trend_expr(F.col("latest"), F.col("future"), eps).alias("trend"))


def overview(df: DataFrame, sensors: Sequence[str], tick: int, size: int = WINDOW_SIZE,
             horizon: int = FORECAST_HORIZON, eps: float = TREND_EPSILON) -> DataFrame:
    """WIN-7: per pond and sensor, the latest reading of the window at ``tick``
    and its trend against the last horizon row."""
    p = window_rows(df.select(POND, *TIME_ORDER, *sensors), tick, size - 1,
                    size + horizon - 1, size, horizon)
    last_hist = F.col("start") + F.lit(size - 1)
    last_hor = F.col("start") + F.lit(size + horizon - 1)
    two = p.filter((F.col("pos") == last_hist) | (F.col("pos") == last_hor))
    long = unpivot_sensors(two.withColumn("is_latest", F.col("pos") == last_hist), sensors,
                           [POND, "start", "pos", "created_at", "is_latest"])
    agg = long.groupBy(POND, "sensor", "start").agg(
        F.max(F.when(F.col("is_latest"), F.col("created_at"))).alias("created_at"),
        F.max(F.when(F.col("is_latest"), F.col("reading"))).alias("latest"),
        F.max(F.when(~F.col("is_latest"), F.col("reading"))).alias("future"))
    return agg.select(POND, "sensor", "start", "created_at", "latest", "future",
                      (F.col("future") - F.col("latest")).alias("delta"),
                      trend_expr(F.col("latest"), F.col("future"), eps).alias("trend"))


def pond_detail(df: DataFrame, pond, sensors: Sequence[str], tick: int,
                size: int = WINDOW_SIZE, horizon: int = FORECAST_HORIZON) -> DataFrame:
    """WIN-8: one pond's window at ``tick``: history and horizon series per
    sensor, with the latest reading flagged.  The pond filter reaches the scan (and
    the zone map, where there is one)."""
    one = df.only(pond) if hasattr(df, "only") else df.filter(F.col(POND) == F.lit(pond))
    one = one.select(POND, *TIME_ORDER, *sensors)
    win = window_rows(one, tick, 0, size + horizon - 1, size, horizon)
    win = win.select("*", F.when(F.col("pos") < F.col("start") + size, F.lit("history"))
                     .otherwise(F.lit("horizon")).alias("segment"),
                     (F.col("pos") == F.col("start") + F.lit(size - 1)).alias("is_latest"))
    return unpivot_sensors(win, sensors,
                           [POND, "segment", "pos", "created_at", "entry_id", "is_latest"])
