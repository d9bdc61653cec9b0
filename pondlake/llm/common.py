"""Helpers shared by the corpus operators: scratch tables in the cluster's shared
folder, joins that broadcast only a counted small side, names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pondlake.session import ensure_checkpoint_dir

#: ASCII white space that separates words, as one regular-expression class.
WS = r"[\x20\x09-\x0D]"
#: The same characters, for trim().
WS_CHARS = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast only when its counted rows times its stated row
#: width stay under this many bytes; a shuffle join does the same work beyond it.
BROADCAST_BYTES = 32 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, by
    Spark's own file distribution."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="pondlake-ship-")) / "pondlake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


class Scratch:
    """Tables written once to the shared folder and read back, so that a lost
    executor re-reads them instead of recomputing their lineage."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "pondlake", spark.sparkContext.applicationId,
                              f"{name}-{uuid.uuid4().hex[:12]}"])
        self.made = 0

    def write(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scratch that nothing reads any more."""
        for df in tables:
            self._delete(df._scratch_path)

    def clear(self) -> None:
        """Delete all of this scratch, once nothing reads from it any more."""
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: Sequence[str], base: str) -> str:
    """A column name that no input column has (Spark compares without case)."""
    low, name = {c.lower() for c in taken}, base
    while name.lower() in low:
        name += "_"
    return name


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> bool:
    """Whether a materialised table is proven small enough to broadcast."""
    return (df.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """Null-safe equi-join of ``left`` with a materialised ``right`` whose key
    columns are renamed apart; ``right`` is broadcast only if counted small."""
    keys = [fresh([*left.columns, *right.columns], f"_k{i}") for i in range(len(on))]
    right = right.withColumnsRenamed(dict(zip(on, keys)))
    if small(right, row_bytes):
        right = F.broadcast(right)
    cond = [left[a].eqNullSafe(right[b]) for a, b in zip(on, keys)]
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*keys)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space, in order."""
    trimmed = F.trim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, WS + "+"))


def text_key(text: Column) -> Column:
    """32 bytes that name a text when its rows are found again; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str, text_col: str, spent: Scratch | None = None,
              named: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose (id, text) pair is kept by ``verdict`` (columns
    ``doc_id, text_key, kept``); of rows repeated with the same id and text one
    stays. All columns of ``docs`` are returned unchanged. ``spent`` holds what the
    verdict was made from; it is deleted as soon as the verdict is read. ``named`` is
    what ``text_key`` stands for where that is more than the text."""
    scratch = Scratch(docs.sparkSession, "keep")
    pairs = scratch.write(verdict.groupBy("doc_id", "text_key").agg(
        F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"))
    if spent:
        spent.clear()
    key = fresh(docs.columns, "_text_key")
    keyed = docs.withColumn(key, text_key(F.col(text_col)) if named is None else named)
    gone = pairs.filter("not kept").select(F.col("doc_id").alias(id_col), F.col("text_key").alias(key))
    left = sized_join(keyed, gone, [id_col, key], "left_anti", 64)
    again = pairs.filter("kept").select(F.col("doc_id").alias(id_col), F.col("text_key").alias(key))
    if again.isEmpty():
        return left.select(*docs.columns)
    once = sized_join(left, again, [id_col, key], "left_anti", 64).select(*docs.columns)
    repeated = sized_join(left, again, [id_col, key], "left_semi", 64)
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = repeated.groupBy(id_col, key).agg(F.first(row).alias("row")).select("row.*")
    return once.unionByName(one)
