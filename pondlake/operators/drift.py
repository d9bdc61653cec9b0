"""Population-stability drift between the newer and older half of each pond's
newest rows, per column tests, an overall verdict and the report table.

PSI definition (ours; the reference delegates it to a library):
  * nulls are dropped per column;
  * ``k = ceil(log2(n) + 1)`` equal-width bins (Sturges) over both halves'
    min..max, ``n`` = both halves' non-null rows; the top edge falls into the
    last bin; a constant column is one bin (PSI 0);
  * shares are per half (bin rows / the half's non-null rows), floored at 1e-4;
  * ``PSI = sum((ref - cur) * ln(ref / cur))`` over bins;
  * an empty half gives null PSI and status ``INSUFFICIENT``;
  * a text column has one bin per value.

The monitor's halves hold at most ``report_range`` rows per pond and arrive
hash-partitioned by pond, so each column's range is a window aggregate per
pond (no join, no extra shuffle); for unbounded halves the range is a grouped
aggregate joined back on its key.  The bin counts and the PSI sum are grouped
aggregates that combine map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pondlake.operators.ordinal import join_groups
from pondlake.operators.series import POND, drift_halves
from pondlake.schema import (DRIFT_SHARE, MONITOR_COLUMNS, PSI_COLUMN_THRESHOLD,
                             PSI_DRIFT_CUTOFF, REPORT_RANGE)

SHARE_FLOOR = 1e-4
ROUND = 9


def _value_cols(c: str, text: bool):
    """``(x, t)``: the numeric value, or the text value of a text column."""
    raw = F.col(f"`{c}`")
    if text:
        return F.lit(None).cast("double"), raw.cast("string")
    return raw.cast("double"), F.lit(None).cast("string")


def _stats_by_window(halves: DataFrame, columns: Sequence[str], text: set[str],
                     is_cur, is_ref) -> DataFrame:
    """Per-(pond, column) stats as window aggregates over each pond's rows, in
    the wide form, then one unpivot.  Used when every pond holds a bounded
    number of rows (the newest-N halves): the input is already hash-partitioned
    and sorted by pond there, so this adds no shuffle and no join."""
    w = Window.partitionBy(POND)
    stats, rows = [], []
    for i, c in enumerate(columns):
        x, t = _value_cols(c, c in text)
        v = t if c in text else x
        stats += [x.alias(f"_x{i}"), t.alias(f"_t{i}"),
                  F.min(x).over(w).alias(f"_mn{i}"), F.max(x).over(w).alias(f"_mx{i}"),
                  F.count(F.when(is_cur, v)).over(w).alias(f"_nc{i}"),
                  F.count(F.when(is_ref, v)).over(w).alias(f"_nr{i}")]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(c in text).alias("is_text"),
                             F.col(f"_x{i}").alias("x"), F.col(f"_t{i}").alias("t"),
                             F.col(f"_mn{i}").alias("mn"), F.col(f"_mx{i}").alias("mx"),
                             F.col(f"_nc{i}").alias("n_current"), F.col(f"_nr{i}").alias("n_reference")))
    wide = halves.select(POND, "half", *stats)
    long = wide.select(POND, "half", F.inline(F.array(*rows)))
    return long.withColumn("n", F.col("n_current") + F.col("n_reference"))


def _stats_by_join(halves: DataFrame, columns: Sequence[str], text: set[str],
                   is_cur, is_ref) -> DataFrame:
    """The same stats as a grouped aggregate joined back on (pond, column):
    skew-safe for halves of any size (AQE broadcasts the stats only when their
    measured size allows)."""
    rows = []
    for c in columns:
        x, t = _value_cols(c, c in text)
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(c in text).alias("is_text"),
                             x.alias("x"), t.alias("t")))
    long = halves.select(POND, "half", F.inline(F.array(*rows)))
    v = F.coalesce(F.col("x").cast("string"), F.col("t"))
    stats = long.groupBy(POND, "column_name").agg(
        F.min("x").alias("mn"), F.max("x").alias("mx"),
        F.count(F.when(is_cur, v)).alias("n_current"),
        F.count(F.when(is_ref, v)).alias("n_reference"))
    stats = stats.withColumn("n", F.col("n_current") + F.col("n_reference"))
    return join_groups(long, stats, [POND, "column_name"])


WINDOW_ROWS = 1_000_000  # newest rows of a pond that one task may hold


def psi(halves: DataFrame, columns: Sequence[str], half_col: str = "half",
        bounded: bool = False) -> DataFrame:
    """DRF-1: ``(pond_id, column_name, n_current, n_reference, bins, psi)``.

    Numeric columns use the equal-width bins above; a text column uses one bin
    per value (``bins`` is then null).  The ranges come from an aggregate and a
    join; ``bounded=True``, for halves known to be small (the monitor's newest
    ``report_range`` rows up to ``WINDOW_ROWS``), takes a window per pond
    instead, with the same results."""
    halves = halves.withColumnRenamed(half_col, "half") if half_col != "half" else halves
    text = {f.name for f in halves.schema.fields
            if f.name in columns and isinstance(f.dataType, T.StringType)}
    is_cur = F.col("half") == "current"
    is_ref = F.col("half") == "reference"
    long = (_stats_by_window if bounded else _stats_by_join)(halves, columns, text, is_cur, is_ref)
    long = long.withColumn("bins", F.when(~F.col("is_text") & (F.col("n") > 0),
                                          F.ceil(F.log2("n") + 1)))
    scaled = (F.col("x") - F.col("mn")) / (F.col("mx") - F.col("mn")) * F.col("bins")
    numeric_bin = (F.when(F.col("x").isNull(), F.lit(None))
                    .when(F.col("mx") > F.col("mn"), F.least(F.floor(scaled), F.col("bins") - 1))
                    .otherwise(F.lit(0)))
    binned = long.select(
        POND, "column_name", "half", "n_current", "n_reference", "bins",
        F.when(F.col("is_text"), F.col("t")).otherwise(numeric_bin.cast("string")).alias("bin"))
    per_bin = binned.groupBy(POND, "column_name", "n_current", "n_reference", "bins", "bin").agg(
        F.count(F.when(is_cur, 1)).alias("c_cur"), F.count(F.when(is_ref, 1)).alias("c_ref"))
    # an empty half makes the share undefined (null), never a division error
    ref_share = F.greatest(F.try_divide("c_ref", "n_reference"), F.lit(SHARE_FLOOR))
    cur_share = F.greatest(F.try_divide("c_cur", "n_current"), F.lit(SHARE_FLOOR))
    term = F.when(F.col("bin").isNotNull(), (ref_share - cur_share) * F.ln(ref_share / cur_share))
    out = per_bin.groupBy(POND, "column_name", "n_current", "n_reference", "bins").agg(
        F.sum(term).alias("_psi"))
    value = F.when((F.col("n_current") == 0) | (F.col("n_reference") == 0), F.lit(None)) \
             .otherwise(F.round(F.coalesce(F.col("_psi"), F.lit(0.0)), ROUND))
    return out.select(POND, "column_name", "n_current", "n_reference", "bins",
                      value.cast("double").alias("psi"))


def psi_column_tests(psi_df: DataFrame, threshold: float = PSI_COLUMN_THRESHOLD) -> DataFrame:
    """DRF-2: PASS when ``psi < threshold``, FAIL otherwise, INSUFFICIENT if null."""
    status = (F.when(F.col("psi").isNull(), F.lit("INSUFFICIENT"))
               .when(F.col("psi") < threshold, F.lit("PASS"))
               .otherwise(F.lit("FAIL")))
    return psi_df.select(POND, "column_name", "psi", F.lit(float(threshold)).alias("threshold"),
                         status.alias("status"))


def drifted_columns(psi_df: DataFrame, threshold: float = PSI_DRIFT_CUTOFF) -> DataFrame:
    """DRF-3: per pond, columns with ``psi >= threshold`` and their share of all
    columns checked."""
    agg = psi_df.groupBy(POND).agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count(F.when(F.col("psi") >= threshold, 1)).alias("n_drifted"))
    return agg.withColumn("share", F.round(F.col("n_drifted") / F.col("n_columns"), ROUND))


def is_drift(drifted: DataFrame, drift_share: float = DRIFT_SHARE) -> DataFrame:
    """DRF-4: the overall test is 'share < drift_share'; FAIL means drift."""
    drift = F.col("share") >= drift_share
    return drifted.select("*", drift.alias("drift"),
                          F.when(drift, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("status"))


def drift_report(psi_df: DataFrame, columns: Sequence[str],
                 column_threshold: float = PSI_COLUMN_THRESHOLD,
                 drift_cutoff: float = PSI_DRIFT_CUTOFF,
                 drift_share: float = DRIFT_SHARE) -> DataFrame:
    """DRF-5: overall row first (``test_order`` 0), then one row per column in
    the order asked; tagged with the pond (the reference's table)."""
    overall = is_drift(drifted_columns(psi_df, drift_cutoff), drift_share).select(
        POND, F.lit(0).alias("test_order"), F.lit("drifted_columns_share").alias("metric"),
        F.lit(None).cast("string").alias("column_name"), F.col("share").cast("double").alias("value"),
        F.lit(float(drift_share)).alias("threshold"), "status")
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i + 1))])
    per_col = psi_column_tests(psi_df, column_threshold).select(
        POND, F.element_at(order, F.col("column_name")).alias("test_order"),
        F.lit("psi").alias("metric"), "column_name", F.col("psi").alias("value"),
        "threshold", "status")
    return overall.unionByName(per_col)


def monitor(readings: DataFrame, columns: Sequence[str] = MONITOR_COLUMNS,
            report_range: int = REPORT_RANGE, **thresholds) -> DataFrame:
    """DRF-6: newest ``report_range`` rows per pond -> halves -> PSI -> report,
    all ponds in one job.  Only the keys and the checked columns are read, and of a
    table with a zone map (``PondFiles``) only the files with newest rows."""
    names = list(columns) if hasattr(readings, "newest") else [F.col(f"`{c}`") for c in columns]
    narrow = readings.select(POND, "created_at", "entry_id", *names)
    halves = drift_halves(narrow, report_range)
    bounded = report_range <= WINDOW_ROWS
    return drift_report(psi(halves, columns, bounded=bounded), columns, **thresholds)


def retrain_list(report: DataFrame) -> DataFrame:
    """DRF-7: ponds whose overall test failed, i.e. whose model needs retraining."""
    return (report.filter((F.col("test_order") == 0) & (F.col("status") == "FAIL"))
                  .select(POND, F.col("value").alias("drift_share")))
