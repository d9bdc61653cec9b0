"""Structured Streaming: raw pond files -> readings table, and the drift report
and dashboard overview refreshed after every load.

* STR-1 ``ingest_stream``: CSV files arrive in a folder.  The stream carries
  their names; each micro-batch is read and cleaned by the batch code
  (``csv_ingest.ingest_files``: layouts, repairs, splices, strict types) and
  its rows with new keys are written under the micro-batch's own partitions,
  so a replayed batch overwrites what it wrote.
* STR-2: a row is dropped only if its ``(pond_id, entry_id)`` is stored already
  or repeated in the micro-batch: ``new_keys`` anti-joins the keys of the stored
  files whose key interval meets the batch's (``KeyIntervals``).  No row is late;
  ponds may lag one another by any time.  ``dedup_stream`` is the bounded-state variant for sources whose
  repeats come close together.
* STR-3 / STR-4 ``refresh_stream``: a second query on the table's files; for
  each micro-batch it merges the batch into a table of each pond's newest rows
  and computes the drift report and the overview from that, so the history of a
  pond is not read again.  All writes are idempotent.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pondlake.functions.parse import strict_cast, strict_ts
from pondlake.operators import drift, series
from pondlake.operators.ordinal import broadcast_if_bounded, join_groups
from pondlake.sources.csv_ingest import ingest_files
from pondlake.schema import (CANON, DAY_FIRST_FORMAT, FLOAT_COLUMNS, INTEGER_COLUMNS,
                             MIN_SERIES_ROWS, MONITOR_COLUMNS, RAW, REPORT_RANGE)
from pondlake.session import cut_lineage
from pondlake.streaming.compaction import MergedBatches, compact, key_intervals


def typed_readings(raw: DataFrame, time_format: str = DAY_FIRST_FORMAT) -> DataFrame:
    """Stateless batch rules on canonical text columns plus ``pond_id``."""
    typed = strict_cast(raw, {**{c: "bigint" for c in INTEGER_COLUMNS},
                              **{c: "double" for c in FLOAT_COLUMNS}})
    typed = typed.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)
                           if c in FLOAT_COLUMNS else F.col(c) for c in typed.columns])
    typed = typed.withColumn("created_at", strict_ts("created_at", time_format).cast("timestamp"))
    return typed.na.drop(subset=["entry_id"]).select("pond_id", *CANON)


def dedup_stream(df: DataFrame, delay: str) -> DataFrame:
    """STR-2 with bounded state: drop repeats of ``(pond_id, entry_id)`` arriving
    within ``delay`` of each other in event time.  The watermark is one for all
    ponds, so rows older than the newest by more than ``delay`` are dropped
    too: only for sources that are in time order across ponds.  Needs a zoned
    ``TIMESTAMP`` column."""
    return (df.withWatermark("created_at", delay)
              .dropDuplicatesWithinWatermark(["pond_id", "entry_id"]))


def read_file_stream(spark: SparkSession, src_dir: str, max_files: int) -> DataFrame:
    """One row per arriving CSV file: its path (at most ``max_files`` a micro-batch)."""
    return (spark.readStream.format("text").option("wholetext", True)
            .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", max_files)
            .load(src_dir).select(F.col("_metadata.file_path").alias("path")))


def _table_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


class KeyIntervals:
    """STR-2's key store: for every stored file and pond the interval of its keys.

    A micro-batch looks up the files whose interval meets that of its own keys in the
    same pond and reads the keys of those files only; where keys grow with time these
    are the files of repeats, however long the history.  The intervals of a batch are
    written after its rows, under the batch's number, so a replay writes them again;
    every ``FOLD`` batches those before are written as one folder, so that few are
    read.  A table written before (or beside) the store gets one for all its files.
    Batches that have been merged (``compaction``) are looked up in the spans' files.
    """

    FOLD = 64

    def __init__(self, spark: SparkSession, table_path: str, path: str | None = None):
        self.spark, self.table_path = spark, table_path.rstrip("/")
        self.path = path or f"{self.table_path}_keys"
        self.merged = MergedBatches(spark, table_path)

    def _folders(self) -> tuple[int, list[int]]:
        """The newest whole fold (-1: none) and the batches written after it."""
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return -1, []
        names = [f.getPath().getName() for f in fs.listStatus(p)
                 if fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        upto = max([int(n[5:]) for n in names if n.startswith("upto=")], default=-1)
        return upto, sorted(int(n[6:]) for n in names if n.startswith("batch=") and int(n[6:]) > upto)

    def _read(self, batch_id: int | None) -> DataFrame | None:
        """The intervals of all unmerged batches but this one; None if there are none."""
        upto, batches = self._folders()
        parts = [f"{self.path}/upto={upto}"] if upto >= 0 else []
        parts += [f"{self.path}/batch={b}" for b in batches if b != batch_id]
        if not parts:
            return None
        of_batch = F.regexp_extract("file", "/batch_id=([0-9]+)/", 1)
        merged = (of_batch != "") & (of_batch.cast("long") <= self.merged.upto())
        return self.spark.read.parquet(*parts).filter(~merged)

    def build(self) -> None:
        """Intervals of a table that has no store yet, as those of a fold before any batch."""
        upto, batches = self._folders()
        if upto < 0 and not batches and self.merged.exists():
            key_intervals(self.merged.live()).write.mode("overwrite").parquet(f"{self.path}/upto=0")

    def files(self, rows: DataFrame, batch_id: int | None = None) -> list[str]:
        """The stored files that can hold a key of ``rows`` (those of ``batch_id``, written
        before a replay, do not count)."""
        parts = [p for p in (self._read(batch_id), self.merged.intervals()) if p is not None]
        if not parts:
            return []
        known = reduce(DataFrame.unionByName, parts)
        spans = cut_lineage(rows.groupBy("pond_id").agg(F.min("entry_id").alias("_lo"), F.max("entry_id").alias("_hi")), small=True)
        met = join_groups(known, broadcast_if_bounded(spans), ["pond_id"]).filter("last_key >= _lo and first_key <= _hi")
        found = [r.file for r in met.select("file").distinct().collect()]
        return [f for f in found if batch_id is None or f"/batch_id={batch_id}/" not in f]

    def written(self, batch_id: int) -> None:
        """Record the files that a batch has written, and fold where it is time."""
        if batch_id not in self.merged.batches():  # it had no new rows
            return
        rows = self.merged.live().filter(F.col("batch_id") == batch_id)
        key_intervals(rows).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        upto, batches = self._folders()
        if len(batches) > self.FOLD and batches[-1] == batch_id:
            # batches before this one are complete and are not replayed any more
            fold = self._read(batch_id)  # without what has been merged since
            fold.repartition(max(1, fold.count() // 1_000_000)).write.mode("overwrite").parquet(f"{self.path}/upto={batches[-2]}")


def new_keys(spark: SparkSession, rows: DataFrame, table_path: str, batch_id: int | None = None) -> DataFrame:
    """STR-2: ``rows`` without repeats of ``(pond_id, entry_id)`` among themselves or
    in the table (what ``batch_id`` itself wrote before a replay does not count).
    Of the table only the files whose keys overlap those of ``rows`` are read."""
    rows = rows.dropDuplicates(["pond_id", "entry_id"])
    if not MergedBatches(spark, table_path).exists():
        return rows
    store = KeyIntervals(spark, table_path)
    store.build()
    files = store.files(rows, batch_id)
    if not files:
        return rows
    stored = MergedBatches(spark, table_path).read(files)
    return join_groups(rows, stored.select("pond_id", "entry_id"), ["pond_id", "entry_id"], "left_anti")


def ingest_batch(spark: SparkSession, table_path: str, time_format: str = DAY_FIRST_FORMAT,
                 compact_every: int = 0, keep_batches: int = 1000):
    """The ``foreachBatch`` body of ``ingest_stream``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        covered = MergedBatches(spark, table_path).upto()
        if batch_id <= covered:  # a stream begun anew beside an old table would be hidden by its spans
            raise ValueError(f"batch {batch_id} of {table_path} was merged already (up to {covered})")
        paths = sorted(r.path for r in batch.distinct().collect())   # bounded by max_files
        if not paths:
            return
        rows = ingest_files(spark, paths, time_format)
        # cleaned once; the key lookup and the write read the checkpoint
        rows = cut_lineage(rows.withColumn("created_at", F.col("created_at").cast("timestamp")))
        rows = new_keys(spark, rows, table_path, batch_id).withColumn("batch_id", F.lit(batch_id))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("pond_id", "batch_id").parquet(table_path))
        KeyIntervals(spark, table_path).written(batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact(spark, table_path, keep_batches)
    return run


def ingest_stream(spark: SparkSession, src_dir: str, table_path: str, checkpoint: str,
                  available_now: bool = False, max_files: int = 1000, compact_every: int = 0,
                  keep_batches: int = 1000) -> StreamingQuery:
    """STR-1: start the ingest query (partitioned by pond and micro-batch).  Every
    ``compact_every`` batches (0: never) the batches before are merged into files in
    time order, and merged ones older than ``keep_batches`` are deleted: read the
    table by ``MergedBatches.rows`` or ``stream_files`` then, and let no reader of
    the folder itself (a refresh stream) lag by more."""
    writer = (read_file_stream(spark, src_dir, max_files).writeStream
              .option("checkpointLocation", checkpoint)
              .foreachBatch(ingest_batch(spark, table_path, compact_every=compact_every, keep_batches=keep_batches)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    return writer.start()


def newest_window_overview(table: DataFrame, sensors: Sequence[str],
                           rows: int = MIN_SERIES_ROWS) -> DataFrame:
    """STR-4 core: the overview of each pond's newest ``rows`` rows (latest =
    row ``rows - horizon``, future = newest row).  The newest-N cut is the
    salted two-level top-N, so a hot pond is cut before it is positioned."""
    newest = series.newest_n_per_pond(table.select("pond_id", "created_at", "entry_id", *sensors),
                                      rows).drop("rn")
    return series.overview(newest, sensors, tick=0)


def stored_rows(spark: SparkSession, table_path: str) -> DataFrame:
    """Every row of a stream's table once, whether its batch has been merged or not."""
    return MergedBatches(spark, table_path).rows()


def refresh_batch(spark: SparkSession, table_path: str, reports_path: str, overview_path: str,
                  columns: Sequence[str], report_range: int, sensors: Sequence[str],
                  newest_path: str | None = None):
    """The ``foreachBatch`` body of ``refresh_stream``.

    ``newest_path`` (default beside the overview) holds the newest rows of each
    pond, as many as the report or the overview needs.  A micro-batch is merged
    into those of its ponds; a pond seen for the first time starts from its rows
    in the table."""
    newest_path = newest_path or f"{overview_path.rstrip('/')}_newest"
    keep = max(report_range, MIN_SERIES_ROWS)
    names = list(dict.fromkeys(["created_at", "entry_id", *columns, *sensors]))

    def run(batch: DataFrame, batch_id: int) -> None:
        ponds = batch.select("pond_id").distinct()
        rows = batch.select("pond_id", *names)
        known = None
        if _table_exists(spark, f"{newest_path}/current"):
            known = spark.read.parquet(f"{newest_path}/current").select("pond_id", *names)
            rows = rows.unionByName(known.join(ponds, "pond_id", "left_semi"))
        fresh = ponds if known is None else ponds.join(known.select("pond_id").distinct(), "pond_id", "left_anti")
        history = stored_rows(spark, table_path).select("pond_id", *names)
        rows = rows.unionByName(history.join(fresh, "pond_id", "left_semi"))
        merged = series.newest_n_per_pond(rows.dropDuplicates(["pond_id", "entry_id"]), keep).drop("rn")
        # written aside first: the rows come from the folder that they replace
        merged.write.mode("overwrite").parquet(f"{newest_path}/pending")
        newest = spark.read.schema(merged.schema).parquet(f"{newest_path}/pending")
        (newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("pond_id").parquet(f"{newest_path}/current"))
        report = drift.monitor(newest, columns, report_range)
        (report.withColumn("batch_id", F.lit(batch_id))
               .write.mode("overwrite").parquet(f"{reports_path.rstrip('/')}/batch_id={batch_id}"))
        view = newest_window_overview(newest, sensors)
        (view.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("pond_id").parquet(overview_path))
    return run


def refresh_stream(spark: SparkSession, table_path: str, checkpoint: str, reports_path: str,
                   overview_path: str, columns: Sequence[str] = MONITOR_COLUMNS,
                   report_range: int = REPORT_RANGE, sensors: Sequence[str] | None = None,
                   available_now: bool = False) -> StreamingQuery:
    """STR-3 + STR-4: re-run the monitor and the overview after each load."""
    schema = MergedBatches(spark, table_path).schema()
    source = spark.readStream.schema(schema).parquet(table_path)
    writer = (source.writeStream.option("checkpointLocation", checkpoint)
                    .foreachBatch(refresh_batch(spark, table_path, reports_path, overview_path,
                                                columns, report_range, list(sensors or columns))))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    return writer.start()
