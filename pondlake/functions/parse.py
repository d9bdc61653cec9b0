"""Value parsing: literal repairs, strict and lenient casts and time parsing.

Strict functions fail the job on the first bad value (so nothing half-loaded is
committed) whatever ``spark.sql.ansi.enabled`` says; lenient ones turn bad
text into null.  All are built-in expressions inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pondlake.functions.columns import q
from pondlake.schema import DAY_FIRST_FORMAT, MISSING_TOKENS

_INTEGRAL = {"tinyint", "smallint", "int", "integer", "bigint", "long"}


def repair_literal(df: DataFrame, rules: Sequence[tuple[object, str, str]],
                   pond_col: str = "pond_id") -> DataFrame:
    """SRC-3: replace literal text in every string column of the ponds named
    by each ``(pond, text, replacement)`` rule (``pond=None``: every pond)."""
    out = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, T.StringType) and f.name != pond_col:
            for pond, text, value in rules:
                fixed = F.replace(c, F.lit(text), F.lit(value))
                c = fixed if pond is None else F.when(F.col(pond_col) == F.lit(pond), fixed).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def pond_id_from_name(name: Column) -> Column:
    """SRC-4: the first run of digits in a file name as the pond id; a name
    without digits fails the load (it would otherwise borrow another id)."""
    digits = F.regexp_extract(name, r"\d+", 0)
    return F.when(digits == "", F.raise_error(F.concat(F.lit("no pond number in file name: "), name))) \
            .otherwise(digits.cast("int"))


def _fail(message: str, raw: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message + ": "), raw.cast("string")))


def strict_value(col: str, dtype: str) -> Column:
    """PRJ-6 for one column: cast, failing on bad text; integer types also fail
    on non-integral numbers (a plain cast would truncate 1.5 to 1)."""
    raw = F.col(q(col))
    if dtype.lower() in _INTEGRAL:
        d = raw.cast("string").try_cast("decimal(38,10)")   # exact: a double would round above 2^53
        v = d.try_cast(dtype)
        bad = raw.isNotNull() & (v.isNull() | (d != F.floor(d)))
        return F.when(bad, _fail(f"cannot cast {col} to {dtype}", raw)).otherwise(v)
    v = raw.try_cast(dtype)
    return F.when(raw.isNotNull() & v.isNull(), _fail(f"cannot cast {col} to {dtype}", raw)).otherwise(v)


def strict_cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """PRJ-6: strict casts of the named columns, others untouched."""
    return df.select(*[strict_value(c, types[c]).alias(c) if c in types else F.col(q(c))
                       for c in df.columns])


def strict_ts(col: str, fmt: str = DAY_FIRST_FORMAT) -> Column:
    """SRC-7: parse text to a timestamp (without zone), in ``fmt`` or ISO order
    (year first); bad text fails."""
    raw = F.col(q(col))
    iso = F.when(raw.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]|\s*$)"), raw.try_cast("timestamp_ntz"))
    v = F.coalesce(F.try_to_timestamp(raw, F.lit(fmt)).cast("timestamp_ntz"), iso)
    return F.when(raw.isNotNull() & v.isNull(), _fail(f"cannot parse time {col}", raw)).otherwise(v)


def lenient_ts_value(col: str, formats: Sequence[str] = (DAY_FIRST_FORMAT,)) -> Column:
    """PRJ-8: first format that parses wins; bad text gives null."""
    raw = F.col(q(col))
    tries = [F.try_to_timestamp(raw, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return tries[0] if len(tries) == 1 else F.coalesce(*tries)


def lenient_ts(df: DataFrame, col: str = "created_at",
               formats: Sequence[str] = (DAY_FIRST_FORMAT,)) -> DataFrame:
    return df.withColumn(col, lenient_ts_value(col, formats))


def lenient_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-9: parse the listed columns that exist as double; bad text and ``NaN``
    -> null."""
    present = set(cols) & set(df.columns)
    return nan_to_null(df.select(*[F.col(q(c)).try_cast("double").alias(c) if c in present
                                   else F.col(q(c)) for c in df.columns]), list(present))


def missing_to_null(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """SRC-1: text that stands for a missing value becomes null in every string column."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)} - set(skip)
    return df.select(*[F.when(~F.col(q(c)).isin(MISSING_TOKENS), F.col(q(c))).alias(c) if c in text
                       else F.col(q(c)) for c in df.columns])


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN and null are one notion upstream; keep only null downstream."""
    return df.select(*[F.nanvl(F.col(q(c)), F.lit(None).cast("double")).alias(c) if c in cols
                       else F.col(q(c)) for c in df.columns])
