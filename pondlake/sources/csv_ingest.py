"""Raw pond CSV files -> conformed, typed, de-duplicated readings.

Raw files differ in header layout, and the conforming is positional, so files
are grouped by layout: each layout is one multi-file scan, conformed once;
a pond with its own repair or splice rule gets a scan of its own.  The
conformed frames are unioned by name into one plan.  Header lines are found by
tasks, one job for all files; the driver handles file names and headers only.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pondlake.functions.columns import (add_null_column, drop_optional, first_n_columns,
                                        lower_columns, normalise_header, q, rename_positional)
from pondlake.functions.parse import (lenient_numeric, lenient_ts, missing_to_null,
                                      pond_id_from_name,
                                      repair_literal, strict_cast, strict_ts)
from pondlake.operators.cleaning import dedup_rows, drop_all_null, drop_null_key, drop_null_ts
from pondlake.schema import (CANON, DASHBOARD_SENSORS, DAY_FIRST_FORMAT, FLOAT_COLUMNS,
                             INTEGER_COLUMNS, LITERAL_REPAIRS, NULL_COLUMN_RULES)

_FILE = "_file_name"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Paths of the files in ``folder`` (content is pruned: only names are read)."""
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
               .load(folder).select("path"))
    return sorted(r.path for r in listing.collect())


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one CSV (reads its first line only)."""
    return spark.read.option("header", True).csv(path).columns


def _plain_path(path: str) -> str:
    return path.replace(":///", ":/", 1)


def header_names(line: str) -> list[str]:
    """Column names of a header line as Spark's CSV reader gives them: an empty name
    becomes ``_c<i>``, and names that are alike but for case get their place."""
    names = next(csv.reader([line], escapechar="\\", doublequote=False))
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Column names of every file, by one job: a task is a block of one file, gives
    its first line that is not blank and stops, so of a file no more than the first
    lines are read.  A file without such a line raises ``ValueError``."""
    # settings of this read alone: no two files share a task, and lines come in small batches
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", own.conf.get("spark.sql.files.maxPartitionBytes"))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (line, start) in enumerate(zip(batch.column("value").to_pylist(), batch.column("start").to_pylist())):
                if start:  # not the file's first block
                    return
                if line and line.strip():
                    yield batch.slice(k, 1).select(["path", "value"])
                    return

    lines = own.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("start"))
    found = {_plain_path(unquote(r.path)): r.value for r in lines.mapInArrow(first, "path string, value string").collect()}
    layouts = {line: header_names(line) for line in set(found.values())}
    missing = [p for p in paths if _plain_path(p) not in found]
    if missing:
        raise ValueError(f"no header line in {missing[:5]}")
    return {p: layouts[found[_plain_path(p)]] for p in paths}


def read_raw_csv(spark: SparkSession, paths: str | Sequence[str],
                 header: Sequence[str] | None = None) -> DataFrame:
    """SRC-1 / SRC-2: CSV files sharing one header layout, every column as text
    (blank and missing-value tokens -> null), plus the file name.  A missing path raises
    ``AnalysisException``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = list(header) if header is not None else read_header(spark, paths[0])
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(paths)
    df = df.select("*", F.col("_metadata.file_name").alias(_FILE))
    return missing_to_null(df, skip=[_FILE])


def conform(df: DataFrame, pond: int | None, repairs=LITERAL_REPAIRS,
            null_rules=NULL_COLUMN_RULES, names: Sequence[str] = CANON) -> DataFrame:
    """PRJ-1..5 for raw files of one layout: splice a missing ``population``,
    lower names, drop ``date``, keep 11 columns, rename by position.

    ``pond`` is the pond number when the files belong to one pond with rules of
    its own; ``None`` takes each row's pond from its file name (SRC-4).  The
    pond id leads the columns, so the positional steps count one more."""
    pond_expr = F.lit(pond) if pond is not None else pond_id_from_name(F.col(_FILE))
    body = df.select(pond_expr.alias("pond_id"), *[F.col(q(c)) for c in df.columns if c != _FILE])
    rules = [(None, t, v) for p, t, v in repairs if pond is not None and p == pond]
    if rules:
        body = repair_literal(body, rules, pond_col="pond_id")
    for p, anchor, offset in null_rules:
        if pond is not None and p == pond:
            body = add_null_column(body, "population", anchor, offset, dtype="string")
    body = lower_columns(body)
    body = drop_optional(body, "date")
    body = first_n_columns(body, len(names) + 1)
    return rename_positional(body, ["pond_id", *names])


def clean_typed(df: DataFrame) -> DataFrame:
    """Type and clean conformed text in the reference's order: numbers are
    typed (strictly) before duplicates are dropped, the time stays text until
    after, then rows without a key go."""
    typed = strict_cast(df, {**{c: "bigint" for c in INTEGER_COLUMNS},
                             **{c: "double" for c in FLOAT_COLUMNS}})
    typed = typed.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)
                           if c in FLOAT_COLUMNS else F.col(c) for c in typed.columns])
    return drop_null_key(dedup_rows(typed), "entry_id")


def _rule_ponds(repairs, null_rules) -> set[int]:
    return {p for p, _, _ in repairs} | {p for p, _, _ in null_rules}


def ingest_folder(spark: SparkSession, folder: str, time_format: str = DAY_FIRST_FORMAT,
                  repairs=LITERAL_REPAIRS, null_rules=NULL_COLUMN_RULES) -> DataFrame:
    """SRC-1 + SRC-4 + PRJ-1..6 + FLT-1/2 + SRC-7: every raw file of ``folder``
    as one readings frame; a bad value anywhere fails the job.

    The driver handles file names and headers, never rows."""
    paths = list_files(spark, folder)
    if not paths:
        raise ValueError(f"no CSV files in {folder}")
    return ingest_files(spark, paths, time_format, repairs, null_rules)


def ingest_files(spark: SparkSession, paths: Sequence[str], time_format: str = DAY_FIRST_FORMAT,
                 repairs=LITERAL_REPAIRS, null_rules=NULL_COLUMN_RULES) -> DataFrame:
    """``ingest_folder`` for the given files: one read (one scan, many files in
    parallel) per header layout, and a read of its own only for a pond with
    repair or splice rules."""
    special = _rule_ponds(repairs, null_rules)
    groups: dict[tuple, list[str]] = {}
    headers = read_headers(spark, paths)
    for path in paths:
        digits = re.search(r"\d+", path.rsplit("/", 1)[-1])
        if digits is None:
            raise ValueError(f"no pond number in file name: {path}")
        pond = int(digits.group(0))
        header = tuple(headers[path])
        groups.setdefault((header, pond if pond in special else None), []).append(path)
    frames = [clean_typed(conform(read_raw_csv(spark, paths, header), pond, repairs, null_rules))
              for (header, pond), paths in groups.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("created_at", strict_ts("created_at", time_format)) \
              .select("pond_id", *CANON)


def load_dashboard_csv(spark: SparkSession, path: str, formats=(DAY_FIRST_FORMAT,),
                       sensors: Sequence[str] = DASHBOARD_SENSORS) -> DataFrame:
    """Lenient dashboard read: normalise headers, parse day-first times (bad ->
    null), drop rows without time, parse the present sensors (bad -> null),
    drop rows where all sensors are missing."""
    df = missing_to_null(normalise_header(spark.read.option("header", True).csv(path)))
    df = drop_null_ts(lenient_ts(df, "created_at", formats))
    df = lenient_numeric(df, sensors)
    return drop_all_null(df, list(sensors))


def write_clean_csv(df: DataFrame, out: str) -> None:
    """SRC-5: one folder per pond, header row, no index column."""
    df.write.mode("overwrite").partitionBy("pond_id").option("header", True).csv(out)
