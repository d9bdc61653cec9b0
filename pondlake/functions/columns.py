"""Column-layout functions: splice, rename, keep and pick columns.

These touch only the plan's schema (names and positions); no row moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> str:
    """Back-quote a column name (names may hold '/', '(' or spaces)."""
    return "`" + name.replace("`", "``") + "`"


def add_null_column(df: DataFrame, name: str, anchor: str, offset: int,
                    dtype: str = "bigint") -> DataFrame:
    """PRJ-1: insert a typed null column at ``index(anchor) + offset``.

    ``offset=1`` puts it right after the anchor, ``offset=-1`` one place before
    the anchor's left neighbour's slot, as positional inserts do."""
    cols = df.columns
    if anchor not in cols:
        raise ValueError(f"anchor column {anchor!r} not found")
    at = cols.index(anchor) + offset
    if not 0 <= at <= len(cols):
        raise ValueError(f"insert position {at} out of range")
    new = F.lit(None).cast(dtype).alias(name)
    return df.select(*[F.col(q(c)) for c in cols[:at]], new, *[F.col(q(c)) for c in cols[at:]])


def lower_columns(df: DataFrame) -> DataFrame:
    """PRJ-2: lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def drop_optional(df: DataFrame, name: str) -> DataFrame:
    """PRJ-3: drop ``name`` if present (no-op otherwise)."""
    return df.drop(name) if name in df.columns else df


def first_n_columns(df: DataFrame, n: int) -> DataFrame:
    """PRJ-4: keep the first ``n`` columns."""
    return df.select(*[F.col(q(c)) for c in df.columns[:n]])


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """PRJ-5: rename by position; a width mismatch raises."""
    if len(names) != len(df.columns):
        raise ValueError(f"expected {len(names)} columns, found {len(df.columns)}")
    return df.toDF(*names)


def normalise_header(df: DataFrame) -> DataFrame:
    """PRJ-7: lower-case and remove spaces and parentheses from every name."""
    def clean(c: str) -> str:
        return c.lower().replace(" ", "").replace("(", "").replace(")", "")
    return df.toDF(*[clean(c) for c in df.columns])


def columns_by_type(df: DataFrame, kinds: Sequence[str]) -> list[str]:
    """PRJ-12: names of columns of the given kinds: ``text`` and/or ``numeric``."""
    out = []
    for f in df.schema.fields:
        is_text = isinstance(f.dataType, T.StringType)
        is_num = isinstance(f.dataType, (T.IntegralType, T.FractionalType))
        if ("text" in kinds and is_text) or ("numeric" in kinds and is_num):
            out.append(f.name)
    return out


def target_split(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """PRJ-11: features without the target, and the target alone; a missing
    target raises."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return df.drop(target), df.select(target)
