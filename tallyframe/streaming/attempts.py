"""An extension: attempts as a stream. Sums by case and configuration are additive, so they are kept incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_attempts(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def running_rates(attempts: DataFrame) -> DataFrame:
    """Counts of each configuration, for update or complete output."""
    return attempts.where(~F.col("smoke_only")).groupBy("config_id").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("passed")).alias("passes"), F.sum("cost_micro").alias("cost_micro"))


def windowed_rates(attempts: DataFrame, time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The same in tumbling windows; rows later than the watermark are dropped."""
    return attempts.withWatermark(time, late).groupBy(F.window(time, width), "config_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("passed")).alias("passes"))
