"""Run-table operators: run selection, parent names, column clean-up,
schema snapshots and drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def runs_under(runs: DataFrame, roots: DataFrame, root_col: str = "root_run_id") -> DataFrame:
    """Runs whose root is in ``roots`` (semi join; a literal id is a filter
    that reaches the scan)."""
    return runs.join(roots.select(F.col(roots.columns[0]).alias(root_col)), root_col, "left_semi")


def runs_by_root(runs: DataFrame, root_id: str) -> DataFrame:
    return runs.filter(F.col("root_run_id") == root_id)


def underscore_columns(df: DataFrame) -> DataFrame:
    """Blanks in column names -> '_'; refuses names that would collide."""
    new = [c.replace(" ", "_") for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"renaming would create duplicate columns: {new}")
    return df.toDF(*new)


def add_column(df: DataFrame, name: str, transform: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Derived column from a Column or a function of the DataFrame."""
    return df.withColumn(name, transform(df) if callable(transform) and not isinstance(transform, Column)
                         else transform)


def with_parent_name(runs: DataFrame) -> DataFrame:
    """C4: parent run name by a self left join (shuffle join on the run id)."""
    parents = runs.select(F.col("run_id").alias("parent_run_id"), F.col("run_name").alias("parent_run_name"))
    return runs.join(parents, "parent_run_id", "left")


DDL_SCHEMA = T.StructType([
    T.StructField("snapshot", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("col_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("comment", T.StringType()),
])


def schema_snapshot(spark: SparkSession, tables: dict[str, DataFrame], snapshot: str) -> DataFrame:
    """A10: column inventory (one row per column) of the given tables.
    Metadata only: built from schemas on the driver, size = number of columns."""
    rows = [(snapshot, name, f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment"))
            for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, DDL_SCHEMA)


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added / dropped / retyped / recommented columns between snapshots."""
    b = before.select("table_name", "col_name", F.col("data_type").alias("old_type"),
                      F.col("comment").alias("old_comment"))
    a = after.select("table_name", "col_name", F.col("data_type").alias("new_type"),
                     F.col("comment").alias("new_comment"))
    j = b.join(a, ["table_name", "col_name"], "full")
    change = (F.when(F.col("old_type").isNull(), F.lit("added"))
              .when(F.col("new_type").isNull(), F.lit("dropped"))
              .when(~F.col("old_type").eqNullSafe(F.col("new_type")), F.lit("retyped"))
              .when(~F.col("old_comment").eqNullSafe(F.col("new_comment")), F.lit("recommented")))
    return j.withColumn("change", change).filter(F.col("change").isNotNull())
