"""A readings table on files together with its zone map, so that a request reads
only the files that can hold its rows.

The zone map has a row per (file, pond): rows, rows without time, and the bounds of
time and key. It is made by Spark from three columns of new files only, and is
appended to as files come. From it follow, without a scan of the table:

* the newest ``n`` rows (SRT-2, SRT-3, DRF-6): files in order of their first time,
  newest first, sum up to ``n`` rows at some time; a file that ends before it holds
  none of the newest ``n``;
* pond sizes, and the positions of each file's rows (WIN-2, WIN-7, WIN-8, JON-1,
  AGG-2): files whose times do not overlap hold consecutive positions, so their row
  counts, prefix-summed, say which files hold ``[a, b)``. Files that overlap form a
  run that is ranked together; in a table written in time order runs are single files;
* which stored files can hold a key (STR-2).

The answers are those of a scan, whatever the order in which files were written;
only the number of files read depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pondlake.operators.ordinal import broadcast_if_bounded, join_groups, with_position
from pondlake.operators.series import POND, TIME_ORDER
from pondlake.session import cut_lineage

TIME, KEY = TIME_ORDER
_FILE = "_zone_file"


def write_clustered(df: DataFrame, path: str, rows_per_file: int | None = None, mode: str = "append",
                    partition_by: Sequence[str] = (), files: int | None = None) -> None:
    """Write ``df`` so that a file holds a stretch of one pond's time (or several short
    ponds whole): range partitions of (pond, time, key), sorted; a large pond spans
    many partitions.  ``files``: how many partitions (default: as the session sets)."""
    keys = [POND, *TIME_ORDER]
    dealt = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    w = dealt.sortWithinPartitions(*keys).write.mode(mode)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def plain_name(file: str) -> str:
    """A file's name in one form, whether Spark listed it or wrote it beside a row."""
    return file.replace(":///", ":/", 1)


def file_of_row() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^([A-Za-z0-9]+):///", "$1:/")


class PondFiles:
    """A folder of Parquet files (partitioned or not) and the folder of its zone map."""

    #: Column of the file's name in what ``_read`` returns.
    FILE = _FILE

    def __init__(self, spark: SparkSession, path: str, zones_path: str, schema: T.StructType | None = None,
                 columns: Sequence[str] | None = None, pond: tuple | None = None, least: int = 0):
        self.spark, self.path, self.zones_path, self.pond, self.least = spark, path, zones_path, pond, least
        reader = spark.read if schema is None else spark.read.schema(schema)
        self.rows = reader.parquet(path)
        self.schema = self.rows.schema
        self.columns = list(columns or self.rows.columns)

    def files(self) -> list[str]:
        """The files that are there now (a fresh listing)."""
        return sorted(map(plain_name, self.spark.read.schema(self.schema).parquet(self.path).inputFiles()))

    # ------------------------------------------------------------------ the zone map

    def refresh(self) -> "PondFiles":
        """Add the zones of files that are new since the last refresh. The driver handles
        file names only; of the files three columns are read, once each."""
        live = set(self.files())
        old = {r.file for r in self._stored().select("file").distinct().collect()} if self._has_zones() else set()
        new = sorted(live - old)
        if new or not self._has_zones():
            timed = F.col(TIME).isNotNull()
            zones = self._read(new).select(POND, TIME, KEY, F.col(_FILE).alias("file")).groupBy("file", POND).agg(
                F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~timed, 1)).alias("n_null"),
                F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time"), F.min(KEY).alias("first_key"), F.max(KEY).alias("last_key"))
            # a file without rows has a row of the map too
            names = self.spark.createDataFrame([(f,) for f in new], "file string")
            zones = names.join(zones, "file", "left").na.fill(0, ["n_rows", "n_null"])
            zones.repartition(max(1, -(-len(new) // 10_000))).write.mode("append").parquet(self.zones_path)
        return self

    def _has_zones(self) -> bool:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.zones_path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.zones_path)

    def zones(self) -> DataFrame:
        """The zones of the files that are there now (one row a file and pond). Raises
        if a file has none: call ``refresh`` after writing."""
        live = self.files()
        names = self.spark.createDataFrame([(f,) for f in live], "file string")
        out = self._stored().dropDuplicates(["file", POND]).join(broadcast_if_bounded(names), "file", "left_semi")
        if self.pond:
            out = out.filter(F.col(POND).eqNullSafe(F.lit(self.pond[0])))
        out = cut_lineage(out, small=True)
        if not self.pond:
            known = out.select(F.count_distinct("file")).first()[0]
            if known < len(live):
                raise ValueError(f"{len(live) - known} files of the table are not in its zone map")
        out = out.filter("n_rows > 0")
        if self.least:
            long = out.withColumn("_n", F.sum("n_rows").over(Window.partitionBy(POND))).filter(F.col("_n") >= self.least)
            out = cut_lineage(long.drop("_n"), small=True)
        return out

    # ------------------------------------------------------------------ narrowing

    def select(self, *columns: str) -> "PondFiles":
        return type(self)(self.spark, self.path, self.zones_path, self.schema, [str(c) for c in columns], self.pond, self.least)

    def only(self, pond) -> "PondFiles":
        """One pond's files and rows."""
        return type(self)(self.spark, self.path, self.zones_path, self.schema, self.columns, (pond,), self.least)

    def at_least(self, rows: int) -> "PondFiles":
        """The ponds of at least so many rows (FLT-6)."""
        return type(self)(self.spark, self.path, self.zones_path, self.schema, self.columns, self.pond, rows)

    def sizes(self) -> DataFrame:
        """Rows per pond (``pond_id, __L``), from the zone map alone."""
        return cut_lineage(self.zones().groupBy(POND).agg(F.sum("n_rows").alias("__L")), small=True)

    def _read(self, files: Sequence[str]) -> DataFrame:
        """Rows of the given files, which alone are listed and planned, and the file's name.
        Names come encoded as in a URL; a reader takes them plain."""
        if not files:
            return self.rows.filter("false").withColumn(_FILE, F.lit(None).cast("string"))
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*map(unquote, sorted(files))) \
                   .withColumn(_FILE, file_of_row())

    # ------------------------------------------------------------------ requests

    def newest_files(self, n: int, per_pond: bool = True) -> list[str]:
        """The files that can hold one of the newest ``n`` rows (rows without time count
        as newest, as in ``series.newest_n``)."""
        zones, keys = self.zones(), [POND] if per_pond else []
        sure = F.sum(F.col("n_rows") - F.col("n_null")).over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("first_time")).rangeBetween(
            Window.unboundedPreceding, Window.currentRow))
        # the latest time from which on at least n rows are known to lie
        from_ = F.max(F.when(F.col("_sure") >= n, F.col("first_time"))).over(Window.partitionBy(*keys))
        marked = zones.withColumn("_sure", sure).withColumn("_from", from_)
        needed = marked.filter((F.col("n_null") > 0) | F.col("_from").isNull() | (F.col("last_time") >= F.col("_from")))
        return [r.file for r in needed.select("file").distinct().collect()]

    def newest(self, n: int, per_pond: bool = True) -> DataFrame:
        """Rows among which the newest ``n`` (of each pond) are; the caller cuts them."""
        return self._narrow(self._read(self.newest_files(n, per_pond))).select(*self.columns)

    def _narrow(self, rows: DataFrame) -> DataFrame:
        if self.least:
            rows = join_groups(rows, broadcast_if_bounded(self.sizes().select(POND)), [POND], "left_semi")
        return rows.filter(F.col(POND).eqNullSafe(F.lit(self.pond[0]))) if self.pond else rows

    def stretches(self) -> DataFrame:
        """``file, pond_id, timed, run, base, size, n_rows``: a file's rows with time (or
        without) lie among positions ``[base, base + size)`` of their pond."""
        zones = self.zones()
        parts = zones.select("file", POND, "first_time", "last_time", F.explode(F.array(
            F.struct(F.lit(False).alias("timed"), F.col("n_null").alias("n")),
            F.struct(F.lit(True).alias("timed"), (F.col("n_rows") - F.col("n_null")).alias("n")))).alias("part"))
        parts = parts.select("file", POND, "first_time", "last_time", "part.timed", "part.n").filter("n > 0")
        order = Window.partitionBy(POND, "timed").orderBy("first_time", "last_time", "file")
        before = F.max("last_time").over(order.rowsBetween(Window.unboundedPreceding, -1))
        # a run begins where no earlier file reaches; rows without time are one run, the first
        begins = F.when(F.col("timed") & F.col("first_time").isNotNull() & (before.isNull() | (F.col("first_time") > before)), 1).otherwise(0)
        runs = parts.withColumn("_begins", begins).withColumn("run", F.when(F.col("timed"), F.sum("_begins").over(order)).otherwise(0))
        sizes = runs.groupBy(POND, "run").agg(F.sum("n").alias("size"))
        up = Window.partitionBy(POND).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("base", F.coalesce(F.sum("size").over(up), F.lit(0))) \
                     .withColumn("n_rows", F.sum("size").over(Window.partitionBy(POND)))
        return join_groups(runs.select("file", POND, "timed", "run"), sizes, [POND, "run"])

    def at_positions(self, bounds: Callable[[Column], tuple[Column, Column]], pos_col: str = "pos", count_col: str = "n_rows") -> DataFrame:
        """Rows at positions ``[a, b)`` of their pond (time order, rows without time
        first), ``(a, b) = bounds(pond size)``; adds ``pos`` and the pond's size.
        Only the files whose stretch meets ``[a, b)`` are read."""
        a, b = bounds(F.col("n_rows"))
        wanted = self.stretches().withColumn("_a", a.cast("bigint")).withColumn("_b", b.cast("bigint")) \
                     .filter((F.col("base") < F.col("_b")) & (F.col("base") + F.col("size") > F.col("_a")))
        wanted = cut_lineage(wanted, small=True)
        files = [r.file for r in wanted.select("file").distinct().collect()]
        read = self._narrow(self._read(files)).select(
            *dict.fromkeys([POND, *TIME_ORDER, *self.columns]), _FILE, F.col(TIME).isNotNull().alias("_timed"))
        wanted = wanted.select(F.col("file").alias(_FILE), POND, F.col("timed").alias("_timed"), "run", "base", F.col("n_rows").alias("_n"), "_a", "_b")
        met = join_groups(read, broadcast_if_bounded(wanted), [_FILE, POND, "_timed"])
        placed = with_position(met, [POND, "run"], TIME_ORDER, pos_col="_place")
        return placed.withColumn(pos_col, F.col("base") + F.col("_place")).filter(
            (F.col(pos_col) >= F.col("_a")) & (F.col(pos_col) < F.col("_b"))).select(*self.columns, pos_col, F.col("_n").alias(count_col))

    def files_with_keys(self, keys: DataFrame) -> list[str]:
        """The files whose key interval meets that of ``keys`` (``pond_id`` and the key
        column) in the same pond."""
        spans = keys.groupBy(POND).agg(F.min(KEY).alias("_lo"), F.max(KEY).alias("_hi"))
        met = join_groups(self.zones(), broadcast_if_bounded(cut_lineage(spans, small=True)), [POND])
        met = met.filter((F.col("last_key") >= F.col("_lo")) & (F.col("first_key") <= F.col("_hi")))
        return [r.file for r in met.select("file").distinct().collect()]

    def stored_keys(self, keys: DataFrame) -> DataFrame:
        """``pond_id`` and key of the stored rows among which any of ``keys`` must be."""
        return self._read(self.files_with_keys(keys)).select(POND, KEY)
