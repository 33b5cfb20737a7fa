"""Cached scale readings; only those of the current reader count."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from granulith import constants as K, schema


def read_scales(spark: SparkSession, path: str, version: int = K.READER_VERSION) -> DataFrame:
    return spark.read.schema(schema.SCALE_READINGS).json(path).where(F.col("version") == version)


def write_scales(readings: DataFrame, path: str, version: int = K.READER_VERSION) -> None:
    readings.withColumn("version", F.lit(version)).write.mode("overwrite").json(path)
