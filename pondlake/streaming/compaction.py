"""Compaction of the stream's table (STR-1): the small files of (pond, batch) folders
are merged into files in time order, whose number is bounded by the data.

Layout, beside the table that the stream writes (``<table>/pond_id=../batch_id=..``):

* ``<table>_merged/rows/<a>-<b>``: all rows of the batches ``a`` to ``b``, a file holding a
  stretch of one pond's time or several short ponds whole;
* ``<table>_merged/keys/<a>-<b>``: the key interval of each of those files and ponds (STR-2).
  It is written last, and a span counts only once it is complete.

A span takes the place of its batches and of the spans inside it, so readers that
use ``rows`` see every row once, before a merge, after it and wherever a merge has
died. New batches are merged with those newest spans that are not more than twice
their size, so that spans grow geometrically: there are at most about log2(rows) of
them, and a row is rewritten as often at most.

Only batches older than the newest are merged: those are committed, so the stream
does not replay them. One process at a time may merge. What a merge has replaced is
deleted by ``expire``, which the caller holds back until all readers of the table's
own folder (a refresh stream, queries that run) are past those batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pondlake.operators.series import POND, TIME_ORDER
from pondlake.sources.pond_files import PondFiles, file_of_row, plain_name, write_clustered

BATCH = "batch_id"
#: Rows of a merged file, a stretch that one task sorts.
ROWS_PER_FILE = 4_000_000


def key_intervals(rows: DataFrame) -> DataFrame:
    """``file, pond_id, first_key, last_key`` of rows read from files."""
    key = TIME_ORDER[1]
    return rows.select(POND, key, F.col("_metadata.file_path").alias("file")).groupBy("file", POND).agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"))


class MergedBatches:
    """The table of a stream together with its merged spans."""

    def __init__(self, spark: SparkSession, table_path: str):
        self.spark, self.table_path = spark, table_path.rstrip("/")
        self.root = f"{self.table_path}_merged"

    # ------------------------------------------------------------------ what is there

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.table_path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _glob(self, pattern: str) -> list:
        return [f.getPath() for f in self._fs().globStatus(self._path(pattern)) or []]

    def _complete(self) -> list[tuple[int, int]]:
        names = [p.getParent().getName() for p in self._glob(f"{self.root}/keys/*/_SUCCESS")]
        return sorted(tuple(map(int, n.split("-"))) for n in names)

    def spans(self) -> list[tuple[int, int]]:
        """The spans that count, oldest first: complete and inside no other."""
        known = self._complete()
        return [s for s in known if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in known)]

    def upto(self) -> int:
        """The newest batch that a span covers (-1: none)."""
        return max((b for _, b in self.spans()), default=-1)

    def batches(self) -> list[int]:
        """The batches in the table's own folder that no span covers."""
        upto = self.upto()
        found = {int(p.getName().split("=")[1]) for p in self._glob(f"{self.table_path}/{POND}=*/{BATCH}=*")}
        return sorted(b for b in found if b > upto)

    def exists(self) -> bool:
        """Whether anything has been written."""
        return bool(self.spans() or self._glob(f"{self.table_path}/[^_.]*"))

    def _folder(self, kind: str, span: tuple[int, int]) -> str:
        return f"{self.root}/{kind}/{span[0]}-{span[1]}"

    # ------------------------------------------------------------------ reading

    def schema(self) -> T.StructType:
        """Of the newest span if there is one, else of the table's own folder."""
        spans = self.spans()
        return self.spark.read.parquet(self._folder("rows", spans[-1]) if spans else self.table_path).schema

    def live(self, schema: T.StructType | None = None) -> DataFrame:
        """The rows of the table's own folder that no span covers."""
        rows = self.spark.read.schema(schema or self.schema()).parquet(self.table_path)
        upto = self.upto()
        if upto < 0:
            return rows
        return rows.filter(F.col(BATCH) > upto)

    def rows(self) -> DataFrame:
        """Every row once."""
        schema = self.schema()
        parts = [self.spark.read.schema(schema).parquet(self._folder("rows", s)) for s in self.spans()]
        return reduce(DataFrame.unionByName, [*parts, self.live(schema)])

    def read(self, files: Sequence[str]) -> DataFrame:
        """The rows of the given files of the table or of spans."""
        return StreamFiles(self.spark, self.table_path, "", self.schema())._read(files)

    def intervals(self) -> DataFrame | None:
        """Key intervals of the spans' files; None if there are none."""
        paths = [self._folder("keys", s) for s in self.spans()]
        return self.spark.read.parquet(*paths) if paths else None

    # ------------------------------------------------------------------ merging

    def merge(self, before: int | None = None, rows_per_file: int = ROWS_PER_FILE) -> tuple[int, int] | None:
        """Merge the batches before ``before`` (default: before the newest one) into a
        new span and return it; None if there is nothing to merge."""
        live = self.batches()
        newest = live[-1] if live else -1
        ready = [b for b in live if b < (newest if before is None else min(before, newest))]
        if not ready:
            return None
        schema, upto = self.schema(), self.upto()
        rows = self.live(schema).filter(F.col(BATCH) <= ready[-1])
        count, first = rows.count(), upto + 1
        for span in reversed(self.spans()):
            older = self.spark.read.schema(schema).parquet(self._folder("rows", span))
            size = older.count()  # from the files' footers
            if size > 2 * count:
                break
            rows, count, first = rows.unionByName(older), count + size, span[0]
        span = (first, ready[-1])
        write_clustered(rows.select(*schema.names), self._folder("rows", span), mode="overwrite", files=-(-count // rows_per_file))
        written = self.spark.read.schema(schema).parquet(self._folder("rows", span))
        key_intervals(written).coalesce(1).write.mode("overwrite").parquet(self._folder("keys", span))
        return span

    def expire(self, before: int) -> int:
        """Delete the folders of batches before ``before`` that a span covers, and spans
        inside others or left by a merge that died; the number of folders deleted."""
        spans, fs = set(self.spans()), self._fs()
        last = min(self.upto(), before - 1)
        old = [p for p in self._glob(f"{self.table_path}/{POND}=*/{BATCH}=*") if int(p.getName().split("=")[1]) <= last]
        # keys go first: rows without keys do not count
        for kind in ("keys", "rows"):
            old += [p for p in self._glob(f"{self.root}/{kind}/*") if tuple(map(int, p.getName().split("-"))) not in spans]
        for p in old:
            fs.delete(p, True)
        return len(old)


class StreamFiles(PondFiles):
    """A stream's table as a table with a zone map: the files of its spans and of the
    batches that no span covers. Newest rows and cursors read only their files."""

    def files(self) -> list[str]:
        merged = MergedBatches(self.spark, self.path)
        found = [p for s in merged.spans() for p in merged._glob(f"{merged._folder('rows', s)}/*.parquet")]
        upto = merged.upto()
        found += [p for p in merged._glob(f"{merged.table_path}/{POND}=*/{BATCH}=*/*.parquet")
                  if int(p.getParent().getName().split("=")[1]) > upto]
        # encoded, as Spark names the file of a row
        return sorted(plain_name(p.toUri().toString()) for p in found)

    def _read(self, files: Sequence[str]) -> DataFrame:
        merged = MergedBatches(self.spark, self.path)
        mark = f"{merged._path(merged.root).toUri().getPath()}/rows/"
        merged = [f for f in files if mark in unquote(f)]
        own = [f for f in files if mark not in unquote(f)]
        parts = [super()._read(own)] if own or not merged else []
        if merged:
            parts.append(self.spark.read.schema(self.schema).parquet(*map(unquote, sorted(merged))).withColumn(self.FILE, file_of_row()))
        return reduce(DataFrame.unionByName, parts)


def stream_files(spark: SparkSession, table_path: str, zones_path: str) -> StreamFiles:
    """The table of a stream with an up-to-date zone map."""
    return StreamFiles(spark, table_path, zones_path, MergedBatches(spark, table_path).schema()).refresh()


def compact(spark: SparkSession, table_path: str, keep_batches: int = 1000) -> tuple[int, int] | None:
    """Merge what can be merged and delete what was merged before the newest
    ``keep_batches`` batches; readers of the table's own folder must not lag by more."""
    merged = MergedBatches(spark, table_path)
    span = merged.merge()
    newest = max([merged.upto(), *merged.batches()])
    merged.expire(newest - keep_batches + 1)
    return span
