"""Log rows (timestamp, logger_name, level, message; all non-null) and the
level roll-up.  Appends are batched DataFrame writes, never one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("logger_name", T.StringType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
])

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


def log_rows(df: DataFrame, ts: str, logger: str, level, message) -> DataFrame:
    """Shape any DataFrame into the log schema (level/message are Columns)."""
    return df.select(F.col(ts).cast("timestamp").alias("timestamp"),
                     F.col(logger).cast("string").alias("logger_name"),
                     level.alias("level"), message.alias("message")).filter(
        F.col("timestamp").isNotNull() & F.col("logger_name").isNotNull()
        & F.col("level").isin(*LEVELS) & F.col("message").isNotNull())


def append_logs(logs: DataFrame, path: str) -> None:
    """Batch append (parquet; the folder is the log table)."""
    logs.write.mode("append").parquet(path)


def log_levels(logs: DataFrame) -> DataFrame:
    """Count of log rows per (logger, level)."""
    return logs.groupBy("logger_name", "level").agg(F.count(F.lit(1)).alias("n"))
