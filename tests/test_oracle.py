"""Every keyed query equals its DuckDB oracle (sf0.001): names, rows, values."""

import pytest

import __spark_entry__ as E
from pondlake.plans import catalog
from tests.conftest import SF_SMALL
from tools.check_oracle import rows_of

ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(scols, srows) == rows_of(dcols, drows)


# Spark type -> DuckDB type of the same values
_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
          "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "array<double>": "DOUBLE[]"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_types_match_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    spark_types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    rel = duck.sql(ORACLE[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types


def test_every_query_has_oracle_or_is_declared_rows_only():
    E.queries()
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"pond_id", "metric", "status"}


def test_entry_schema_is_stable(spark):
    assert E.entry(spark).schema == E.entry(spark).schema
