"""Feedback roll-ups: per-run means, weighted quality, composite score,
ordered feedback text, quality gate and baseline comparison.

Weights are small parameter dicts, so they are applied as a literal map
lookup inside the projection: no join and nothing to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlscore.functions.sqltext import metric_rename

# Weights of the built-in scorers in the composite score
# (the later of the two maps in the reference wins).
CORE_WEIGHTS = {
    "sql_results_equivalence/mean": 0.50,
    "sql_accuracy/mean": 0.25,
    "correctness/mean": 0.0625,
    "sql_clauses_distribution_equivalence/mean": 0.0625,
    "relevance_to_query/mean": 0.0625,
    "count_joins/mean": 0.0625,
}
CORE_SHARE = 0.70
CUSTOM_SHARE = 0.30


def check_weights(weights: dict[str, float], tol: float = 1e-9) -> None:
    if abs(sum(weights.values()) - 1.0) > tol:
        raise ValueError(f"weights must sum to 1.0, got {sum(weights.values())}")


def weight_of(metric: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(None).cast("double")
    m = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.element_at(m, metric)


def metric_means(feedback: DataFrame, keys=("run_id", "cycle"), scorer: str = "scorer",
                 value: str = "value") -> DataFrame:
    """Mean of each scorer per run; metric '<scorer>/mean' and its 'avg_' name."""
    return (feedback.groupBy(*keys, scorer)
            .agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))
            .withColumn("metric", F.concat(F.col(scorer), F.lit("/mean")))
            .withColumn("metric_name", metric_rename(F.col("metric"))))


def quality_score(metrics: DataFrame, weights: dict[str, float], keys=("run_id", "cycle"),
                  metric: str = "metric", value: str = "value", normalise: bool = False) -> DataFrame:
    """sum(value * weight) / number of ALL metrics in the group; metrics
    without a weight add 0 but still count.  ``normalise`` divides by the sum
    of the weights present instead."""
    check_weights(weights)
    w = weight_of(F.col(metric), weights)
    num = F.sum(F.col(value) * F.coalesce(w, F.lit(0.0)))
    den = F.sum(F.coalesce(w, F.lit(0.0))) if normalise else F.count(F.lit(1))
    return metrics.groupBy(*keys).agg(F.try_divide(num, den).alias("quality"),
                                      F.count(F.lit(1)).alias("n_metrics"))


def composite_score(metrics: DataFrame, core_weights: dict[str, float] | None = None,
                    keys=("run_id", "cycle"), metric: str = "metric", value: str = "value",
                    core_share: float = CORE_SHARE, custom_share: float = CUSTOM_SHARE) -> DataFrame:
    """core_share * quality(core weights) + custom_share * quality(1/n over
    the other metrics), both divided by the number of all metrics.  No custom
    metric -> the custom term is 0."""
    sums = composite_sums(F.lit(True), F.col(metric), F.col(value), core_weights)
    return metrics.groupBy(*keys).agg(*sums).select(*keys, *composite_columns(core_share, custom_share))


def composite_sums(is_metric: Column, metric: Column, value: Column, core_weights: dict[str, float] | None = None) -> list[Column]:
    """Aggregates of a group's rows (those that are a metric) for ``composite_columns``."""
    core_weights = CORE_WEIGHTS if core_weights is None else core_weights
    check_weights(core_weights)
    w = weight_of(metric, core_weights)
    is_core = w.isNotNull()
    return [F.count_if(is_metric).alias("n_metrics"),
            F.count_if(is_metric & ~is_core).alias("n_custom"),
            F.sum(F.when(is_metric, value * F.coalesce(w, F.lit(0.0)))).alias("core_sum"),
            F.coalesce(F.sum(F.when(is_metric & ~is_core, value)), F.lit(0.0)).alias("custom_sum")]


def composite_columns(core_share: float = CORE_SHARE, custom_share: float = CUSTOM_SHARE) -> list[Column]:
    """The scores of a group with ``composite_sums``; null without any metric."""
    core_q = F.col("core_sum") / F.col("n_metrics")
    custom_q = F.when(F.col("n_custom") == 0, F.lit(0.0)).otherwise(
        F.col("custom_sum") / F.col("n_custom") / F.col("n_metrics"))
    given = lambda c: F.when(F.col("n_metrics") > 0, c)
    return [given(F.col("n_metrics")).alias("n_metrics"), given(F.col("n_custom")).alias("n_custom"),
            given(F.lit(core_share) * core_q).alias("core_score"),
            given(F.lit(custom_share) * custom_q).alias("custom_score"),
            given(F.lit(core_share) * core_q + F.lit(custom_share) * custom_q).alias("composite")]


def ordered_text(df: DataFrame, keys, order: str, text: str, sep: str = "\n",
                 out: str = "text", max_chars: int | None = None) -> DataFrame:
    """Texts of a group joined in ``order``.

    With ``max_chars`` a group is cut into consecutive parts (``part`` =
    0, 1, ...) at text boundaries, each starting a new part once the texts
    before it reach a multiple of ``max_chars``: every text is kept, no task
    collects more than about ``max_chars`` (plus one text), and the running
    lengths come from a skew-safe running sum, so a hot group is split too."""
    keys = list(keys)
    if max_chars is not None:
        from sqlscore.operators.cycles import cumsum_safe
        if max_chars <= 0:
            raise ValueError("max_chars must be > 0")
        sized = df.withColumn("__len", F.coalesce(F.length(text), F.lit(0)))
        key = keys if len(keys) > 1 else keys[0]
        df = cumsum_safe(sized, key, order, "__len", "__cum").withColumn(
            "part", F.floor((F.col("__cum") - F.col("__len")) / F.lit(max_chars)).cast("long"))
        keys = keys + ["part"]
    return df.groupBy(*keys).agg(joined_text(F.col(order), F.col(text), sep).alias(out), F.count(F.lit(1)).alias("n_items"))


def joined_text(order: Column, text: Column, sep: str = "\n") -> Column:
    """Aggregate: a group's texts in order, joined."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), sep)


def quality_gate(df: DataFrame, threshold: float, score: str = "quality") -> DataFrame:
    """Flag rows that reach the threshold."""
    return df.withColumn("passes", F.col(score) >= F.lit(threshold))


def versus_baseline(metrics: DataFrame, baseline: DataFrame, keys=("run_id",), metric: str = "metric",
                    value: str = "value") -> DataFrame:
    """Each metric next to the baseline run's value of the same metric."""
    b = baseline.select(*keys, metric, F.col(value).alias("baseline"))
    return (metrics.join(b, [*keys, metric], "left")
            .withColumn("delta", F.col(value) - F.col("baseline")))


def union_feedback(*frames: DataFrame) -> DataFrame:
    """Union of scorer outputs by name; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def run_feedback(feedback: DataFrame, run_ids: DataFrame | list, run: str = "run_id") -> DataFrame:
    """All feedback rows of the given runs (a literal list is a filter that
    reaches the scan; a DataFrame of run ids is a semi join)."""
    if isinstance(run_ids, DataFrame):
        return feedback.join(run_ids.select(F.col(run_ids.columns[0]).alias(run)), run, "left_semi")
    return feedback.filter(F.col(run).isin(list(run_ids)))


def flatten_assessments(traces: DataFrame, col: str = "assessments", keys=("trace_id",)) -> DataFrame:
    """D3: per-trace lists of assessments -> one long feedback table (one row per
    assessment, struct fields as columns).  ``explode`` keeps the work on the
    executors instead of concatenating lists on the driver.  A trace without
    assessments keeps one row of nulls."""
    keys = list(keys)
    exploded = traces.select(*keys, F.explode_outer(col).alias("__a"))
    fields = traces.schema[col].dataType.elementType.fieldNames()
    return exploded.select(*keys, *[F.col("__a")[f].alias(f) for f in fields])
