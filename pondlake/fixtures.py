"""The test tables re-shaped as pond readings (codes as in FIXTURES.md).

Every fixture is a Spark plan over the given parquet tables, so its work grows
with them; nothing here is generated on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondlake.schema import DAY_FIRST_FORMAT

E_SENSORS = ["value", "k"]
E_BASE_POND = "click"
E_REPORT_RANGE = 1000
# Bands for the E fixture: (sensor, average, delta).
E_RANGES = [("value", 50.0, 50.0), ("k", 50.0, 25.0)]
L_SENSORS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: events as readings. pond = event_type, created_at = ts,
    entry_id = event_id, sensors ``value`` and ``k`` (the number in props)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("pond_id"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("entry_id"),
        F.col("value"),
        F.regexp_extract("props", "[0-9]+", 0).try_cast("double").alias("k"),
    )


def drifting_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E with drift: ``value`` of ponds ``click`` and ``error`` grows by 10 a day,
    and pond ``signup`` keeps one row in 40, too few for a reference half."""
    r = events_readings(spark, sf_dir)
    days = F.datediff(F.col("created_at").cast("date"), F.lit("2020-01-01").cast("date"))
    grown = F.when(F.col("pond_id").isin("click", "error"), F.col("value") + days * F.lit(10.0)) \
             .otherwise(F.col("value"))
    return r.withColumn("value", grown).filter((F.col("pond_id") != "signup") | (F.col("entry_id") % 40 == 0))


def dirty_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X: E rendered as raw text with injected dirt, keyed by event_id.

    id % 10 = 0 -> value null; % 20 = 0 -> k null too; % 17 = 0 -> value text
    'Jan-00'; % 37 = 0 -> value text 'NaN'; % 41 = 0 -> k text 'NA'; % 23 = 0 -> key null; % 29 = 0 -> time text 'not a date'; rows
    with id % 31 = 0 appear twice.  Times are day-first text cut to seconds.
    """
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    k = F.regexp_extract("props", "[0-9]+", 0)
    base = ev.select(
        F.col("event_type").alias("pond_id"),
        F.when(i % 29 == 0, F.lit("not a date"))
         .otherwise(F.date_format("ts", DAY_FIRST_FORMAT)).alias("created_at"),
        F.when(i % 23 == 0, F.lit(None).cast("string"))
         .otherwise(i.cast("string")).alias("entry_id"),
        F.when(i % 10 == 0, F.lit(None).cast("string"))
         .when(i % 17 == 0, F.lit("Jan-00"))
         .when(i % 37 == 0, F.lit("NaN"))
         .otherwise(F.col("value").cast("string")).alias("value"),
        F.when(i % 20 == 0, F.lit(None).cast("string")).when(i % 41 == 0, F.lit("NA"))
         .otherwise(k).alias("k"),
        i.alias("event_id"),
    )
    times = F.when(F.col("event_id") % 31 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return base.withColumn("copy", F.explode(times)).drop("copy")


def text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E rendered as clean raw text (no dirt): input for the strict operators.
    Times of ids divisible by 3 are in ISO order, the others day first; ``big``
    is an integer beyond 2^53 as text."""
    r = events_readings(spark, sf_dir)
    return r.select(
        "pond_id",
        F.when(F.col("entry_id") % 3 == 0, F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
         .otherwise(F.date_format("created_at", DAY_FIRST_FORMAT)).alias("created_at"),
        (F.col("entry_id") + F.lit(9007199254740993)).cast("string").alias("big"),
        F.col("entry_id").cast("string").alias("entry_id"),
        F.col("value").cast("string").alias("value"),
        F.col("k").cast("bigint").cast("string").alias("k"),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: lineitem, 11 positional columns."""
    return table(spark, sf_dir, "lineitem")


def raw_header(name: str) -> str:
    """Raw-file style header for a clean name: upper case, spaced, with a unit."""
    return name.upper().replace("_", " ", 1) + " (u)"


def lineitem_raw_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lineitem(spark, sf_dir)
    return li.toDF(*[raw_header(c) for c in li.columns])


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: documents joined to labels: n_chars numeric, lang/source text, quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: raw file names IoTPond<id % 9 + 1>.csv built from events."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.format_string("IoTPond%d.csv", F.col("event_id") % 9 + 1)
                     .alias("file_name"))
