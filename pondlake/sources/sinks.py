"""Sinks: drift reports and trained models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_report(report: DataFrame, path: str, run_id: str) -> None:
    """SRC-11: append one drift report, tagged with the run and partitioned by
    the table (pond) it describes."""
    (report.withColumn("run_id", F.lit(run_id))
           .write.mode("append").partitionBy("pond_id").parquet(path))


def save_model(spark: SparkSession, model, params: dict, out: str, table: str, name: str) -> str:
    """SRC-10: ``<out>/<table>/<name>/model`` (Spark ML persistence) and
    ``.../params`` (one JSON row)."""
    base = f"{out.rstrip('/')}/{table}/{name}"
    model.write().overwrite().save(f"{base}/model")
    row = spark.createDataFrame([(json.dumps(params, sort_keys=True, default=str),)], "params string")
    row.coalesce(1).write.mode("overwrite").text(f"{base}/params")
    return base
