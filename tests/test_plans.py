"""Plan shapes that matter at scale: pushdown, pruning, no joins where none
are needed, partial limits before shuffles, shared exchanges."""

import contextlib
import io

from pyspark.sql import functions as F

import __spark_entry__ as E
from pondlake.fixtures import events_readings
from tests.conftest import SF_SMALL


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def final_plan(df) -> str:
    df.collect()
    return plan(df, "simple")


def test_pond_filter_and_columns_reach_the_scan(spark):
    r = events_readings(spark, SF_SMALL).filter(F.col("pond_id") == "click").select(
        "pond_id", "created_at", "entry_id", "value")
    p = plan(r)
    assert "EqualTo(event_type,click)" in p
    assert "user_id" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_select_prunes_read_schema(spark):
    p = plan(E.queries()["select_columns"](spark, SF_SMALL))
    schema = p.split("ReadSchema:")[1].split("\n")[0]
    assert "user_id" not in schema and "ts" not in schema


def test_newest_n_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(E.queries()["newest_n"](spark, SF_SMALL))


def test_newest_per_pond_limits_before_each_shuffle(spark):
    p = plan(E.queries()["newest_n_per_pond"](spark, SF_SMALL))
    assert p.count("WindowGroupLimit") >= 4 and "Partial" in p
    assert "SPARK_PARTITION_ID()" in p


def test_monitor_has_no_join_and_shares_its_shuffles(spark):
    df = E.queries()["monitor"](spark, SF_SMALL)
    assert "Join" not in plan(df)
    fp = final_plan(df)
    assert "ReusedExchange" in fp


def test_range_profile_has_no_join(spark):
    p = plan(E.queries()["range_profile"](spark, SF_SMALL))
    assert "Join" not in p and "HashAggregate" in p


def test_small_tables_are_broadcast_after_a_count(spark):
    # axis (100 rows), per-pond bounds and run tables: all counted, then broadcast
    fp = final_plan(E.queries()["aggregate_overview"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in fp
    assert "SortMergeJoin" not in fp


def test_positions_route_large_groups_to_range_partitions(spark, monkeypatch):
    from pondlake.operators import ordinal
    small = plan(E.queries()["row_position"](spark, SF_SMALL))
    assert "rangepartitioning" not in small          # ~200-row ponds: a window per pond
    monkeypatch.setattr(ordinal, "SMALL_GROUP_ROWS", 50)
    large = plan(E.queries()["row_position"](spark, SF_SMALL))
    assert "Scan ExistingRDD" in large               # the checkpointed range-sorted rows


def test_pond_filter_prunes_partitions_of_the_table(spark, tmp_path):
    from pondlake.operators.series import pond_detail
    r = events_readings(spark, SF_SMALL).withColumn(
        "pond_id", F.when(F.col("pond_id") == "click", 1).otherwise(2))
    r.write.partitionBy("pond_id").parquet(str(tmp_path / "readings"))
    table = spark.read.parquet(str(tmp_path / "readings"))
    p = plan(table.filter(F.col("pond_id") == 1).select("pond_id", "created_at", "value"))
    assert "PartitionFilters: [isnotnull(pond_id" in p and "(pond_id#" in p
    assert pond_detail(table, 1, ["value"], tick=3).count() == 110
