"""Row filters: duplicates, missing keys and times, all-missing sensors, key checks.

``dropDuplicates`` and the key check are aggregates with a map-side partial
step, so a row copied a billion times is reduced to one copy per task before
any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondlake.functions.columns import q


def dedup_rows(df: DataFrame) -> DataFrame:
    """FLT-1: drop exact duplicate rows (null equals null)."""
    return df.dropDuplicates()


def drop_null_key(df: DataFrame, key: str = "entry_id") -> DataFrame:
    """FLT-2."""
    return df.na.drop(subset=[key])


def drop_null_ts(df: DataFrame, col: str = "created_at") -> DataFrame:
    """FLT-3."""
    return df.na.drop(subset=[col])


def drop_all_null(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """FLT-4: drop rows where every listed sensor is null; an absent sensor
    column raises, as the reference does."""
    missing = [s for s in sensors if s not in df.columns]
    if missing:
        raise KeyError(f"sensor columns not found: {missing}")
    return df.filter(F.coalesce(*[F.col(q(s)) for s in sensors]).isNotNull()) if len(sensors) > 1 \
        else df.filter(F.col(q(sensors[0])).isNotNull())


def key_violations(df: DataFrame, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    """FLT-5: keys that are null or not unique within ``group`` (a table);
    empty means the key holds.  ``(group..., key..., n)``."""
    counts = df.groupBy(*group, *key).agg(F.count(F.lit(1)).alias("n"))
    any_null = F.lit(False)
    for k in key:
        any_null = any_null | F.col(k).isNull()
    return counts.filter((F.col("n") > 1) | any_null)


def assert_key(df: DataFrame, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Fail the job if the key does not hold; otherwise return ``df``.

    One bounded action (``limit(1)`` over the violations) runs before any write."""
    bad = key_violations(df, group, key).limit(1).collect()
    if bad:
        raise ValueError(f"key {list(key)} violated, e.g. {bad[0].asDict()}")
    return df
