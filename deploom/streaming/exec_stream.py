"""Build-step records as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.execlog import records
from ..schema import EXEC_LOG


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EXEC_LOG).json(path)


def per_window(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """CPU time per command and window of step starts; the watermark bounds the state."""
    return records(stream.withWatermark("start", late)).groupBy(F.window("start", window), "command").agg(F.count("*").alias("steps"), F.sum("user_ns").alias("user_ns"))
