"""Tables: load, scan by name, list, union of ponds."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondlake.operators.cleaning import assert_key
from pondlake.schema import READINGS
from pondlake.sources.pond_files import PondFiles


def conform_to_readings(df: DataFrame) -> DataFrame:
    """Cast to the ``READINGS`` types; population must fit an int (checked)."""
    cols = []
    for f in READINGS.fields:
        c = F.col(f.name)
        if f.name == "population":
            c = F.when(c.isNotNull() & ((c > 2147483647) | (c < -2147483648)),
                       F.raise_error(F.lit("population does not fit INT"))).otherwise(c)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


#: A table name is a view on one of its versions; their names carry this mark.
_VERSION = "__v_"
_POINTS = "pondlake.version"


def _checked(name: str) -> str:
    if not re.fullmatch(r"\w+(\.\w+)*", name, re.A):
        raise ValueError(f"not a table name: {name!r}")
    return name


def save_table(df: DataFrame, name: str, path: str | None = None,
               partition_by: Sequence[str] = ("pond_id",), check_key: bool = True, cluster: bool = False) -> None:
    """SRC-6 / SRC-7: replace table ``name`` with ``df``, partitioned by pond.

    ``df`` is written once, as a new version (under ``path`` in a folder of its own,
    if given), so every value has been parsed and the key (unique non-null
    ``entry_id`` per pond) is checked on what was written.  Only then does the name,
    a view, point to the new version: one replacement in the catalog, so readers see
    the old table or the new one, whenever the writer dies.  The version before stays
    for readers that have begun on it; older ones, and those of writers that died,
    are dropped.  A plain table of that name (not made here) becomes the version
    before by a rename, the one step that is not atomic.  ``cluster`` writes files
    in time order (``pond_files.write_clustered``), as a zone map wants them."""
    spark = df.sparkSession
    version = f"{_checked(name)}{_VERSION}{time.time_ns():020d}_{uuid.uuid4().hex[:6]}"
    if cluster:
        df = df.repartitionByRange("pond_id", "created_at", "entry_id").sortWithinPartitions("pond_id", "created_at", "entry_id")
    w = df.write.format("parquet").partitionBy(*partition_by)
    if path:
        w = w.option("path", f"{path.rstrip('/')}/load-{version.rpartition(_VERSION)[2]}")
    try:
        w.saveAsTable(version)
        if check_key:
            assert_key(spark.table(version), ["pond_id"], ["entry_id"])
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    before = current_version(spark, name)
    if before is None and spark.catalog.tableExists(name):
        before = f"{name}{_VERSION}{0:020d}"
        spark.sql(f"ALTER TABLE {name} RENAME TO {before.rpartition('.')[2]}")
    _point(spark, name, version)
    for old in _versions(spark, name):
        if old not in (version.lower(), (before or version).lower()):
            spark.sql(f"DROP TABLE IF EXISTS {old}")


def _point(spark: SparkSession, name: str, version: str) -> None:
    """Let ``name`` mean ``version``: one atomic change of the catalog."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{_POINTS}' = '{version}') AS SELECT * FROM {version}")


def current_version(spark: SparkSession, name: str) -> str | None:
    """The version that a name points to; None if there is none."""
    if not spark.catalog.tableExists(_checked(name)):
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
    return next((r.value for r in rows if r.key == _POINTS), None)


def _versions(spark: SparkSession, name: str) -> list[str]:
    database, _, table = name.rpartition(".")
    found = spark.catalog.listTables(database or None, f"{table}{_VERSION}*")
    return [f"{database}.{t.name}".lstrip(".").lower() for t in found]


def pond_files(spark: SparkSession, name: str, zones_root: str) -> PondFiles:
    """The files of a saved table's current version with its zone map, which is
    brought up to date under ``zones_root``."""
    version = current_version(spark, name)
    if version is None:
        raise ValueError(f"{name} was not saved by save_table")
    about = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {version}").collect()}
    return PondFiles(spark, about["Location"], f"{zones_root.rstrip('/')}/{version}", spark.table(version).schema).refresh()


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """SRC-8: every row of a table chosen by name (never formatted into SQL)."""
    return spark.table(name)


def list_tables(spark: SparkSession) -> list[str]:
    """SRC-9: user tables of the current database (temporary views and older versions
    excluded)."""
    return sorted(t.name for t in spark.catalog.listTables() if t.tableType != "TEMPORARY"
                  and not t.isTemporary and _VERSION not in t.name)


def union_ponds(frames: Sequence[DataFrame]) -> DataFrame:
    """SRC-12: several ponds' frames as one (by column name)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
