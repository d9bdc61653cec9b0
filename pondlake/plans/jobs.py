"""Named-table jobs: what the reference's programs do, on Spark tables.

* ``load_ponds``      raw CSV folder -> typed, keyed ``readings`` table
* ``monitor_table``   drift report of a table by name (optionally appended)
* ``dashboard``       overview, aggregate overview and one pond's detail
* ``train_from_table`` split, tune, score and save a model for a table

Each is a composition of the operators; tables are chosen by name through the
catalog, never formatted into SQL text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from pondlake.operators import crosspond, drift, learn, series
from pondlake.schema import MONITOR_COLUMNS, REPORT_RANGE
from pondlake.sources.catalog import conform_to_readings, pond_files, save_table, scan_table
from pondlake.sources.csv_ingest import ingest_folder
from pondlake.sources.sinks import append_report, save_model


def load_ponds(spark: SparkSession, folder: str, table: str, path: str | None = None,
               zones_root: str | None = None) -> DataFrame:
    """Ingest every raw file of ``folder`` into ``table``: the ``READINGS``
    types (population checked to fit INT), key checked before the write.  With
    ``zones_root`` files are written in time order and their zone map below it."""
    save_table(conform_to_readings(ingest_folder(spark, folder)), table, path=path, cluster=zones_root is not None)
    if zones_root:
        pond_files(spark, table, zones_root)
    return scan_table(spark, table)


def _source(spark: SparkSession, table: str, zones_root: str | None):
    return pond_files(spark, table, zones_root) if zones_root else scan_table(spark, table)


def monitor_table(spark: SparkSession, table: str, columns: Sequence[str] = MONITOR_COLUMNS,
                  report_range: int = REPORT_RANGE, reports_path: str | None = None,
                  run_id: str | None = None, zones_root: str | None = None) -> DataFrame:
    """DRF-6 on a named table, all ponds in one job; the report is appended to
    ``reports_path`` (SRC-11) when given.  With ``zones_root`` only the files with
    newest rows are read."""
    report = drift.monitor(_source(spark, table, zones_root), columns, report_range)
    if reports_path:
        append_report(report, reports_path, run_id or "manual")
    return report


def dashboard(spark: SparkSession, table: str, sensors: Sequence[str], tick: int,
              base_pond, detail_pond=None, zones_root: str | None = None) -> dict[str, DataFrame]:
    """The dashboard's three computations at one refresh count ``tick``.  With
    ``zones_root`` only the files with the cursor's rows are read."""
    readings = series.length_guard(_source(spark, table, zones_root))
    out = {"overview": series.overview(readings, sensors, tick),
           "aggregate_overview": crosspond.aggregate_overview(readings, base_pond, sensors, tick)}
    if detail_pond is not None:
        out["pond_detail"] = series.pond_detail(readings, detail_pond, sensors, tick)
    return out


def train_from_table(spark: SparkSession, table: str, label: str, id_col: str, model_name: str,
                     space: Mapping, out: str | None = None, **options):
    """ML-16 on a named table; the best model and its parameters are saved
    under ``out/<table>/<model>/`` (SRC-10) when ``out`` is given."""
    model, params, score = learn.train_table(scan_table(spark, table), label, id_col, model_name,
                                             space, **options)
    if out:
        save_model(spark, model, {**params, "balanced_accuracy": score}, out, table, model_name)
    return model, params, score
