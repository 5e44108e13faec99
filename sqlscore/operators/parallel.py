"""Parallelism of CPU-heavy per-row work (tokenizing, sectioning, model calls).

A small input file is read as one partition, which runs all of that work in
one task.  Whoever knows the input says how many partitions the rows are to
be spread over; nothing is decided from the plan and no job is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SETTING = "spark.sqlscore.inputPartitions"


def spread(df: DataFrame, partitions: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Round-robin (or hash on ``keys``) over ``partitions``; without a number, ``df`` as it is."""
    return df.repartition(partitions, *keys) if partitions else df


def asked_partitions(spark) -> int | None:
    """The number of input partitions that the session asks for (unset: none, no shuffle)."""
    n = spark.conf.get(SETTING, None)
    return int(n) if n else None


def partitions(spark) -> int:
    """The number asked for, else four tasks a core: for queries whose work is in the rows, not in reading them."""
    return asked_partitions(spark) or 4 * spark.sparkContext.defaultParallelism
