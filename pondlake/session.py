"""Session construction and lineage helpers."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "pondlake", driver_memory: str | None = None) -> SparkSession:
    """A session with AQE on, UTC time and no UI.

    On a cluster ``master`` and memory are left to spark-submit; local runs
    pass ``local[N]`` and, since a local session runs every task in the
    driver's JVM, a ``driver_memory`` for it (applies only when the JVM is
    started here).
    """
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               # checkpoints of DataFrames that are no longer referenced are deleted
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, by
    Spark's own file distribution; fits that run side by side wait for the first."""
    sc = spark.sparkContext
    with _shipping:
        if sc.applicationId in _shipped:
            return
        package = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="pondlake-package-")) / "pondlake_code.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent).as_posix())
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    A scratch folder of this machine is set only where the session names none
    and runs on this machine alone; on a cluster, executors could not read it,
    so a missing ``spark.checkpoint.dir`` is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder (master {sc.master})")
        current = tempfile.mkdtemp(prefix="pondlake-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def cut_lineage(df: DataFrame, small: bool = False) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder.

    Used where an intermediate is read by several later stages, so a lost
    executor re-reads the checkpoint instead of recomputing the lineage.
    ``small=True`` (tables of one row per group or column) persists the rows
    first, so the checkpoint write does not rescan the input a second time;
    large intermediates are not cached (building the cache costs more than
    the recomputation it would save).
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not small:
        return df.checkpoint(eager=True)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist(blocking=False)
