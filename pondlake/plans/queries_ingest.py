"""Ingest queries (SRC-3/4/7/8/12, PRJ-1..9, FLT-1..5) over fixtures X, L, P and E."""

from __future__ import annotations

from pyspark.sql import functions as F

from pondlake.fixtures import (E_SENSORS, dirty_readings, events_readings, file_names, lineitem,
                               lineitem_raw_headers, raw_header, table, text_readings)
from pondlake.functions import columns as C
from pondlake.functions import parse as P
from pondlake.operators import cleaning as K
from pondlake.plans.catalog import register
from pondlake.plans.sqltext import E
from pondlake.schema import CANON, DAY_FIRST_FORMAT
from pondlake.sources import catalog as T
from pondlake.sources.csv_ingest import conform

REPAIR = [("click", "Jan-00", "12.45")]
_FMT = "%d/%m/%Y %H:%M:%S"

# X: dirty raw text (see fixtures.dirty_readings)
X = f"""x0 AS (
  SELECT event_type AS pond_id,
         CASE WHEN event_id % 29 = 0 THEN 'not a date' ELSE strftime(ts, '{_FMT}') END AS created_at,
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS entry_id,
         CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'Jan-00'
              WHEN event_id % 37 = 0 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS value,
         CASE WHEN event_id % 20 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'NA'
              ELSE regexp_extract(props, '[0-9]+', 0) END AS k,
         event_id
  FROM events),
x AS (SELECT * FROM x0 UNION ALL SELECT * FROM x0 WHERE event_id % 31 = 0)"""

# T: clean raw text of E
TXT = f"""t AS (
  SELECT event_type AS pond_id,
         CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '{_FMT}') END AS created_at,
         CAST(event_id + 9007199254740993 AS VARCHAR) AS big,
         CAST(event_id AS VARCHAR) AS entry_id, CAST(value AS VARCHAR) AS value,
         CAST(CAST(try_cast(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS BIGINT) AS VARCHAR) AS k
  FROM events)"""

LENIENT_NUM = "SELECT pond_id, created_at, entry_id, try_cast(nullif(value, 'NaN') AS DOUBLE) AS value, " \
              "try_cast(nullif(k, 'NA') AS DOUBLE) AS k, event_id FROM x"


@register("repair_literal", "WITH " + X + """
SELECT pond_id,
       CASE WHEN pond_id = 'click' THEN replace(created_at, 'Jan-00', '12.45') ELSE created_at END AS created_at,
       CASE WHEN pond_id = 'click' THEN replace(entry_id, 'Jan-00', '12.45') ELSE entry_id END AS entry_id,
       CASE WHEN pond_id = 'click' THEN replace(value, 'Jan-00', '12.45') ELSE value END AS value,
       CASE WHEN pond_id = 'click' THEN replace(k, 'Jan-00', '12.45') ELSE k END AS k,
       event_id
FROM x""")
def q_repair_literal(spark, sf):
    return P.repair_literal(dirty_readings(spark, sf), REPAIR)


@register("pond_id_from_name", r"""
SELECT event_id, printf('IoTPond%d.csv', event_id % 9 + 1) AS file_name,
       CAST(regexp_extract(printf('IoTPond%d.csv', event_id % 9 + 1), '\d+', 0) AS INTEGER) AS pond_id
FROM events""")
def q_pond_id_from_name(spark, sf):
    p = file_names(spark, sf)
    return p.withColumn("pond_id", P.pond_id_from_name(F.col("file_name")))


_STRICT_TYPES = {"big": "bigint", "entry_id": "bigint", "value": "double", "k": "double"}
_STRICT_SQL = ("CAST(big AS BIGINT) AS big, CAST(entry_id AS BIGINT) AS entry_id, CAST(value AS DOUBLE) AS value, "
               "CAST(k AS DOUBLE) AS k")


@register("strict_cast", "WITH " + TXT + f"\nSELECT pond_id, created_at, {_STRICT_SQL} FROM t")
def q_strict_cast(spark, sf):
    return P.strict_cast(text_readings(spark, sf), _STRICT_TYPES)


@register("strict_load", "WITH " + TXT + f"""
SELECT pond_id, coalesce(try_strptime(created_at, '%Y-%m-%d %H:%M:%S'), try_strptime(created_at, '{_FMT}')) AS created_at,
       {_STRICT_SQL} FROM t""")
def q_strict_load(spark, sf):
    df = P.strict_cast(text_readings(spark, sf), _STRICT_TYPES)
    return df.withColumn("created_at", P.strict_ts("created_at", DAY_FIRST_FORMAT))


@register("lenient_ts", "WITH " + X + f"""
SELECT pond_id, try_strptime(created_at, '{_FMT}') AS created_at, entry_id, value, k, event_id FROM x""")
def q_lenient_ts(spark, sf):
    return P.lenient_ts(dirty_readings(spark, sf), "created_at")


@register("lenient_numeric", "WITH " + X + "\n" + LENIENT_NUM)
def q_lenient_numeric(spark, sf):
    return P.lenient_numeric(dirty_readings(spark, sf), E_SENSORS)


@register("dedup_rows", "WITH " + X + f", typed AS ({LENIENT_NUM})\nSELECT DISTINCT * FROM typed")
def q_dedup_rows(spark, sf):
    return K.dedup_rows(P.lenient_numeric(dirty_readings(spark, sf), E_SENSORS))


@register("drop_null_key", "WITH " + X + "\nSELECT * FROM x WHERE entry_id IS NOT NULL")
def q_drop_null_key(spark, sf):
    return K.drop_null_key(dirty_readings(spark, sf), "entry_id")


@register("drop_null_ts", "WITH " + X + f"""
SELECT * FROM (SELECT pond_id, try_strptime(created_at, '{_FMT}') AS created_at, entry_id, value, k,
                      event_id FROM x)
WHERE created_at IS NOT NULL""")
def q_drop_null_ts(spark, sf):
    return K.drop_null_ts(P.lenient_ts(dirty_readings(spark, sf), "created_at"))


@register("drop_all_null", "WITH " + X + f"""
SELECT * FROM ({LENIENT_NUM}) WHERE value IS NOT NULL OR k IS NOT NULL""")
def q_drop_all_null(spark, sf):
    return K.drop_all_null(P.lenient_numeric(dirty_readings(spark, sf), E_SENSORS), E_SENSORS)


@register("lenient_clean", "WITH " + X + f"""
SELECT * FROM (
  SELECT pond_id, try_strptime(created_at, '{_FMT}') AS created_at, entry_id,
         try_cast(nullif(value, 'NaN') AS DOUBLE) AS value, try_cast(k AS DOUBLE) AS k, event_id FROM x)
WHERE created_at IS NOT NULL AND (value IS NOT NULL OR k IS NOT NULL)""")
def q_lenient_clean(spark, sf):
    """The dashboard's lenient read as one plan: time parse, drop missing
    time, numeric parse, drop all-missing sensors."""
    df = K.drop_null_ts(P.lenient_ts(dirty_readings(spark, sf), "created_at"))
    return K.drop_all_null(P.lenient_numeric(df, E_SENSORS), E_SENSORS)


@register("key_violations", """
SELECT l_returnflag AS pond_id, l_orderkey, l_linenumber, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_orderkey, l_linenumber
HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""")
def q_key_violations(spark, sf):
    li = lineitem(spark, sf).withColumnRenamed("l_returnflag", "pond_id")
    return K.key_violations(li, ["pond_id"], ["l_orderkey", "l_linenumber"])


_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("add_null_column", "SELECT " + ", ".join(
    _LI_COLS[:8] + ["CAST(NULL AS BIGINT) AS population"] + _LI_COLS[8:]) + " FROM lineitem")
def q_add_null_column(spark, sf):
    return C.add_null_column(lineitem(spark, sf), "population", "l_tax", 1)


@register("add_null_column_before", "SELECT " + ", ".join(
    _LI_COLS[:7] + ["CAST(NULL AS BIGINT) AS population"] + _LI_COLS[7:]) + " FROM lineitem")
def q_add_null_column_before(spark, sf):
    # the shape of the reference's second rule: index of the anchor minus one
    return C.add_null_column(lineitem(spark, sf), "population", "l_tax", -1)


def _aliased(fn) -> str:
    return "SELECT " + ", ".join(f'{c} AS "{fn(c)}"' for c in _LI_COLS) + " FROM lineitem"


@register("lower_columns", _aliased(lambda c: raw_header(c).lower()))
def q_lower_columns(spark, sf):
    return C.lower_columns(lineitem_raw_headers(spark, sf))


@register("normalise_header", _aliased(
    lambda c: raw_header(c).lower().replace(" ", "").replace("(", "").replace(")", "")))
def q_normalise_header(spark, sf):
    return C.normalise_header(lineitem_raw_headers(spark, sf))


@register("drop_optional", "SELECT * FROM lineitem")
def q_drop_optional(spark, sf):
    li = lineitem(spark, sf)
    return C.drop_optional(li.withColumn("date", F.to_date("l_shipdate")), "date")


@register("first_n_columns", "SELECT * FROM lineitem")
def q_first_n_columns(spark, sf):
    li = lineitem(spark, sf)
    wide = li.withColumn("extra_1", F.col("l_quantity") * 2).withColumn("extra_2", F.lit(1))
    return C.first_n_columns(wide, 11)


@register("rename_positional", "SELECT " + ", ".join(
    f"{a} AS {b}" for a, b in zip(_LI_COLS, CANON)) + " FROM lineitem")
def q_rename_positional(spark, sf):
    return C.rename_positional(lineitem(spark, sf), CANON)


@register("conform", "SELECT " + ", ".join(
    f"{a} AS {b}" for a, b in zip(_LI_COLS, CANON)) + ", 1 AS pond_id FROM lineitem")
def q_conform(spark, sf):
    """PRJ-1..5 chain on a raw-style lineitem: upper/spaced names, a ``Date``
    column, two surplus columns; pond 1 has no repair or splice rule."""
    raw = lineitem_raw_headers(spark, sf)
    cols = raw.columns
    raw = raw.select(F.to_date(F.col(f"`{cols[-1]}`")).alias("Date"), *[F.col(f"`{c}`") for c in cols],
                     F.lit("x").alias("Extra A"), F.lit(2).alias("Extra B"))
    # the date column leads here, so it must go by name before the first-11 cut
    return conform(raw, 1)


@register("scan_all", "WITH " + E + "\nSELECT * FROM readings")
def q_scan_all(spark, sf):
    events_readings(spark, sf).createOrReplaceTempView("readings_e")
    return T.scan_table(spark, "readings_e")


_POND_TABLES = [("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"),
                ("part", "p_partkey", "p_retailprice")]


@register("union_ponds", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS pond_id, {key} AS entry_id, CAST({value} AS DOUBLE) AS value FROM {t}"
    for t, key, value in _POND_TABLES))
def q_union_ponds(spark, sf):
    """Each table is a pond of its own, read once."""
    return T.union_ponds([table(spark, sf, t).select(
        F.lit(t).alias("pond_id"), F.col(key).alias("entry_id"), F.col(value).cast("double").alias("value"))
        for t, key, value in _POND_TABLES])


@register("newest_n_dirty", "WITH " + X + f"""
SELECT * FROM (SELECT pond_id, try_strptime(created_at, '{_FMT}') AS created_at,
                      try_cast(entry_id AS BIGINT) AS entry_id, event_id FROM x)
ORDER BY created_at DESC NULLS FIRST, entry_id DESC NULLS LAST, event_id DESC LIMIT 400""")
def q_newest_n_dirty(spark, sf):
    """SRT-2 on X: unparseable times are null and come first under DESC, as
    the database orders them; the cut is at 400 rows, past every null."""
    from pondlake.operators.series import newest_n
    df = P.lenient_ts(dirty_readings(spark, sf), "created_at").select(
        "pond_id", "created_at", F.col("entry_id").try_cast("bigint").alias("entry_id"), "event_id")
    return newest_n(df, 400)


@register("range_profile_dirty", "WITH " + X + f""",
typed AS ({LENIENT_NUM}),
banded AS (
  SELECT pond_id, 'value' AS sensor,
         CASE WHEN value IS NULL THEN 'null' WHEN abs(value - 50.0) <= 50.0 THEN 'normal'
              WHEN abs(value - 50.0) <= 100.0 THEN 'outlier' ELSE 'out_of_range' END AS band
  FROM typed
  UNION ALL
  SELECT pond_id, 'k',
         CASE WHEN k IS NULL THEN 'null' WHEN abs(k - 50.0) <= 25.0 THEN 'normal'
              WHEN abs(k - 50.0) <= 50.0 THEN 'outlier' ELSE 'out_of_range' END
  FROM typed)
SELECT pond_id, sensor, band, count(*) AS n FROM banded GROUP BY pond_id, sensor, band""")
def q_range_profile_dirty(spark, sf):
    """AGG-4 on X: missing and unparseable readings fall in the null band."""
    from pondlake.fixtures import E_RANGES
    from pondlake.operators.crosspond import range_profile
    return range_profile(P.lenient_numeric(dirty_readings(spark, sf), E_SENSORS), E_SENSORS, E_RANGES)
