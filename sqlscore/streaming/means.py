"""Structured Streaming forms: de-duplicated appends and running scorer
means per time bucket.  Both read a file source, use an event-time
watermark (the column must be TIMESTAMP, not TIMESTAMP_NTZ), keep their
state in the shared checkpoint folder and run with ``availableNow`` so a
restart resumes from the checkpoint after a lost executor or driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dedup_stream(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """L1: drop rows whose key was already seen within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def running_means(stream: DataFrame, ts: str, group: str, value: str, window: str, delay: str) -> DataFrame:
    """L2: mean and count per (window, group); rows later than the watermark
    are dropped; in append mode a window is emitted once it is closed."""
    return (stream.withWatermark(ts, delay)
            .groupBy(F.window(ts, window).alias("w"), F.col(group))
            .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    group, "mean", "n"))


def replay(spark: SparkSession, arrivals: list[DataFrame], source: str, out_path: str, checkpoint: str,
           plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Let ``arrivals`` come in one after the other: each is added to the source folder and the
    stream ``plan`` is started anew on the same checkpoint, so state, watermark and offsets
    outlive every stop.  Rows older than the watermark of the runs before are late."""
    for rows in arrivals:
        rows.write.mode("append").parquet(source)
        run_to_parquet(spark, plan(spark.readStream.schema(rows.schema).parquet(source)), out_path, checkpoint)
    return spark.read.parquet(out_path)


def run_to_parquet(spark: SparkSession, df: DataFrame, out_path: str, checkpoint: str,
                   mode: str = "append") -> DataFrame:
    """Drain everything available into a parquet folder and read it back."""
    q = (df.writeStream.format("parquet").outputMode(mode)
         .option("path", out_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_path)
