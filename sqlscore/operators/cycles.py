"""Cycle-over-cycle views.  Every window is partitioned by run, so no
window ever runs in a single partition; frames are bounded (last k)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlscore.session import materialize


def _join_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which a null equals a null."""
    renamed = right.select(*[F.col(k).alias("__r_" + k) if k in keys else F.col(k) for k in right.columns])
    on = [left[k].eqNullSafe(renamed["__r_" + k]) for k in keys]
    return left.join(renamed, on, "left").drop(*["__r_" + k for k in keys])


def number_cycles(df: DataFrame, run: str = "run_id", started: str = "started_at",
                  out: str = "cycle", skew_safe: bool = False) -> DataFrame:
    """Cycles 1..n per run in start order; equal start times share a number.
    ``skew_safe`` numbers the distinct start times of a run by a chunked running
    count instead of a window over the whole run."""
    if skew_safe:
        starts = df.select(run, started).distinct().withColumn("__one", F.lit(1))
        counted = cumsum_safe(starts, run, started, "__one", out).select(run, started, F.col(out).cast("int").alias(out))
        return _join_safe(df, counted, [run, started]).select(*df.columns, out)
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(run).orderBy(started)))


def previous_current(df: DataFrame, cols, run: str = "run_id", cycle: str = "cycle",
                     by=(), skew_safe: bool = False) -> DataFrame:
    """``prev_<c>`` next to each column (null in the first cycle).
    ``skew_safe`` uses ``lag_safe`` (no run is held by one task)."""
    if skew_safe:
        return lag_safe(df, [run, *by], cycle, list(cols))
    w = Window.partitionBy(run, *by).orderBy(cycle)
    for c in cols:
        df = df.withColumn(f"prev_{c}", F.lag(c, 1).over(w))
    return df


def drift(df: DataFrame, value: str = "value", run: str = "run_id", cycle: str = "cycle",
          by=("metric",), skew_safe: bool = False) -> DataFrame:
    """Difference to the previous cycle and relative change."""
    if skew_safe:
        df = lag_safe(df, [run, *by], cycle, [value], prefix="__p_").withColumnRenamed("__p_" + value, "prev_value")
    else:
        df = df.withColumn("prev_value", F.lag(value, 1).over(Window.partitionBy(run, *by).orderBy(cycle)))
    return (df
            .withColumn("diff", F.col(value) - F.col("prev_value"))
            .withColumn("rel_change", F.try_divide(F.col("diff"), F.col("prev_value"))))


def lookback(df: DataFrame, k: int, value: str = "value", run: str = "run_id",
             cycle: str = "cycle", skew_safe: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The last k cycles (current included) as an ordered array of
    (cycle, value, and the ``carry`` columns: feedback, instructions) plus the
    mean value.  ``skew_safe`` builds the frame from
    range-partitioned chunks instead of one window per run: the in-chunk frame
    comes from a window over (run, chunk), and the rows missing at a chunk's
    start come from the last k-1 items of the run's previous chunks (a table
    with one row per chunk, at most k-1 items each)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    item = F.struct(F.col(cycle).alias("cycle"), F.col(value).alias("value"), *carry)
    if not skew_safe:
        w = Window.partitionBy(run).orderBy(cycle).rowsBetween(-(k - 1), 0)
        return (df.withColumn("context", F.collect_list(item).over(w))
                .withColumn("context_mean", F.avg(value).over(w)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = materialize(df.repartitionByRange(n, run, cycle)).withColumn("__chunk", F.spark_partition_id())
    inner = m.withColumn("__in", F.collect_list(item).over(
        Window.partitionBy(run, "__chunk").orderBy(cycle).rowsBetween(-(k - 1), 0)))
    last = (m.withColumn("__rn", F.row_number().over(Window.partitionBy(run, "__chunk").orderBy(F.col(cycle).desc())))
            .filter(F.col("__rn") <= k - 1)
            .groupBy(run, "__chunk").agg(F.array_sort(F.collect_list(item)).alias("__tail")))
    carried = (last.withColumn("__prev", F.flatten(F.collect_list("__tail").over(
        Window.partitionBy(run).orderBy("__chunk").rowsBetween(-(k - 1), -1))))
        .select(run, "__chunk", "__prev"))
    j = _join_safe(inner, carried, [run, "__chunk"]).withColumn(
        "__prev", F.coalesce(F.col("__prev"), F.array().cast(inner.schema["__in"].dataType)))
    need = F.lit(k) - F.size("__in")
    take = F.least(need, F.size("__prev"))
    head = F.when(take > 0, F.slice("__prev", F.size("__prev") - take + 1, take)).otherwise(
        F.array().cast(inner.schema["__in"].dataType))
    ctx = F.concat(head, F.col("__in"))
    total = F.aggregate(ctx, F.lit(0.0), lambda acc, x: acc + x["value"].cast("double"))
    return (j.withColumn("context", ctx).withColumn("context_mean", total / F.size("context"))
            .select(*df.columns, "context", "context_mean"))


def latest(df: DataFrame, content: str, run: str = "run_id", cycle: str = "cycle") -> DataFrame:
    """Content of the latest cycle per run."""
    return df.groupBy(run).agg(F.max(cycle).alias(cycle), F.max_by(content, cycle).alias(content))


def best_per_run(df: DataFrame, score: str, run: str = "run_id", cycle: str = "cycle") -> DataFrame:
    """best cycle of each run; ties go to the earliest cycle.  An
    aggregate (max_by ordered by (score, -cycle)) with map-side partials,
    not a window: a run with many cycles is never held by one task."""
    others = [c for c in df.columns if c != run]
    best = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(F.col(score), -F.col(cycle)))
    return df.groupBy(run).agg(best.alias("__b")).select(run, *[F.col("__b")[c].alias(c) for c in others])


def best_overall(df: DataFrame, score: str, k: int, run: str = "run_id", cycle: str = "cycle") -> DataFrame:
    """global top-k (run, cycle) by score; a top-k, not a full sort."""
    return df.orderBy(F.col(score).desc(), F.col(run).asc(), F.col(cycle).asc()).limit(k)


def lag_safe(df: DataFrame, key, order: str, cols: list[str], prefix: str = "prev_",
             partitions: int | None = None) -> DataFrame:
    """``lag(c, 1)`` over (partition by key order by order) for each of
    ``cols``, without putting a whole key into one task.  ``key`` is a column
    name or a list of names.

    The rows are range-partitioned on (key, order) and checkpointed, so a hot
    key is spread over consecutive partitions ("chunks").  Lag is taken inside
    each (key, chunk) - groups no larger than a partition - and the first row
    of a chunk takes the last row of the key's previous chunk from a small
    table of chunk tails (one row per chunk).  ``order`` must be unique per key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = materialize(df.repartitionByRange(n, *keys, order)).withColumn("__chunk", F.spark_partition_id())
    packed = F.struct(*[F.col(c) for c in cols])
    inner = m.withColumn("__prev", F.lag(packed, 1).over(Window.partitionBy(*keys, "__chunk").orderBy(order)))
    tails = (m.groupBy(*keys, "__chunk").agg(F.max_by(packed, F.col(order)).alias("__tail"))
             .withColumn("__tail_prev", F.lag("__tail", 1).over(Window.partitionBy(*keys).orderBy("__chunk")))
             .select(*keys, "__chunk", "__tail_prev"))
    out = _join_safe(inner, tails, [*keys, "__chunk"]).withColumn(
        "__prev", F.coalesce(F.col("__prev"), F.col("__tail_prev")))
    return out.select(*df.columns, *[F.col("__prev")[c].alias(prefix + c) for c in cols])


def cumsum_safe(df: DataFrame, key, order: str, col: str, out: str = "cum") -> DataFrame:
    """Running sum of ``col`` per key in ``order`` (inclusive), with the same
    chunking as ``lag_safe``: sums inside each (key, chunk) plus the totals of
    the key's earlier chunks from a table with one row per chunk."""
    keys = [key] if isinstance(key, str) else list(key)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = materialize(df.repartitionByRange(n, *keys, order)).withColumn("__chunk", F.spark_partition_id())
    inner = m.withColumn("__in", F.sum(col).over(
        Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    offsets = (m.groupBy(*keys, "__chunk").agg(F.sum(col).alias("__tot"))
               .withColumn("__off", F.coalesce(F.sum("__tot").over(
                   Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
               .select(*keys, "__chunk", "__off"))
    return (_join_safe(inner, offsets, [*keys, "__chunk"])
            .select(*df.columns, (F.col("__in") + F.col("__off")).alias(out)))


def token_diff(texts: DataFrame, run: str, cycle: str, text: str) -> DataFrame:
    """Word-token count change between consecutive texts of a run.

    The previous text of each text comes from ``lag_safe`` (no window holds a
    whole run).  Each text's counts are emitted as the current counts of its
    own cycle and, re-keyed through the (run, previous cycle) -> cycle link,
    as the previous counts of its successor; one aggregate sums both - a full
    outer join without the join.  Texts without a predecessor are skipped.
    """
    linked = lag_safe(texts.select(run, cycle), run, cycle, [cycle], prefix="prev_")  # no texts in the checkpoint
    succ = linked.filter(F.col("prev_" + cycle).isNotNull()).select(
        run, F.col("prev_" + cycle).alias("__from"), F.col(cycle).alias("__to"))
    toks = texts.select(run, cycle, F.explode_outer(
        F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[^ \t\n\r]+"), F.lit(0))).alias("token")
    ).filter(F.col("token").isNotNull())
    counts = toks.groupBy(run, cycle, "token").agg(F.count(F.lit(1)).alias("n"))
    of = succ.withColumnRenamed(run, "__run")
    same = counts[run].eqNullSafe(of["__run"])
    cur = (counts.join(of, same & (counts[cycle] == of["__to"]), "left_semi")
           .select(run, cycle, "token", F.col("n").alias("curr_n"), F.lit(0).cast("long").alias("prev_n")))
    prev = (counts.join(of, same & (counts[cycle] == of["__from"]))
            .select(counts[run].alias(run), F.col("__to").alias(cycle), "token",
                    F.lit(0).cast("long").alias("curr_n"), F.col("n").alias("prev_n")))
    return (cur.unionByName(prev).groupBy(run, cycle, "token")
            .agg(F.sum("curr_n").alias("curr_n"), F.sum("prev_n").alias("prev_n"))
            .withColumn("diff", F.col("curr_n") - F.col("prev_n"))
            .filter(F.col("diff") != 0))
