"""Append-only run history with retention on read."""

from pyspark.sql import DataFrame, SparkSession

from granulith.operators.curve import keep_newest


def append_run(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def load_history(spark: SparkSession, path: str, scope: list[str]) -> DataFrame:
    """The newest 40 records of each scope."""
    return keep_newest(spark.read.parquet(path), scope, "ts")
