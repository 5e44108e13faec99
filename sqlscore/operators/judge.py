"""Guidelines judged by a model, and everything a row has been told.

A request for each (row, guideline) goes to a judge, a user function as in
``model``; its reply is parsed into typed feedback, with an ``error`` where there
is none to be had.  ``row_scores`` gives each row its composite score with the
joined feedback, ``row_context`` the joined view that an optimiser reads.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlscore.functions.sqltext import render
from sqlscore.operators import metrics
from sqlscore.operators.evalset import guideline_requests
from sqlscore.operators.model import apply_model, ask_stored
from sqlscore.operators.replies import parse_json

TEMPLATE = "Guideline: {guideline_text}\nExpected SQL: {gold_sql}\nCandidate SQL: {candidate_sql}"
JUDGEMENT = T.StructType([T.StructField("value", T.StringType()), T.StructField("score", T.StringType()),
                          T.StructField("rationale", T.StringType())])
YES, NO = ("true", "yes", "pass"), ("false", "no", "fail")


def parse_judgement(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Typed columns of a judge's JSON reply: ``value`` (from true/false, yes/no,
    pass/fail), ``score`` from 0 to 1, ``rationale`` and ``error``: ``no_reply``, ``parse`` (no
    JSON object), ``no_judgement`` (neither value nor score), ``value`` (none of the words) or
    ``score`` (no number from 0 to 1).  A row with an error has no value and no score; without a
    value a score of one half or more counts as yes, without a score a yes is 1 and a no 0."""
    said = F.col("__r")
    word = F.lower(F.trim(said["value"]))
    yes = F.when(word.isin(*YES), True).when(word.isin(*NO), False)
    number = said["score"].try_cast("double")
    error = (F.when(F.col(reply).isNull(), "no_reply").when(F.col("parse_error"), "parse")
             .when(word.isNull() & said["score"].isNull(), "no_judgement")
             .when(word.isNotNull() & yes.isNull(), "value")
             .when(said["score"].isNotNull() & ~F.coalesce(number.between(0.0, 1.0), F.lit(False)), "score"))
    parsed = parse_json(df, reply, JUDGEMENT, "__r").withColumn("error", error)
    good = F.col("error").isNull()
    return (parsed.withColumn("value", F.when(good, F.coalesce(yes, number >= 0.5)))
            .withColumn("score", F.when(good, F.coalesce(number, yes.cast("double"))))
            .withColumn("rationale", said["rationale"]).drop("__r", "parse_error"))


def judge(df: DataFrame, guidelines: dict, fn: Callable[[pd.Series], pd.Series], template: str = TEMPLATE,
          store: str | None = None, model: str = "judge", **how) -> DataFrame:
    """Feedback (``eval_id``, ``scorer``, ``value``, ``score``, ``rationale``, ``error``) of a
    judge on every row and guideline.  With ``store`` equal requests are asked once and a
    restart asks only what is missing (``model.ask_stored``)."""
    asked = guideline_requests(df, guidelines).select("eval_id", F.col("guideline").alias("scorer"), render(
        template, {c: F.col(c) for c in ("guideline_text", "gold_sql", "candidate_sql", "question") if "{" + c + "}" in template}).alias("request"))
    replied = (ask_stored(asked, "request", fn, store, model, "reply", **how) if store
               else apply_model(asked, "request", fn, "reply", **how)).withColumnRenamed("error", "call_error")
    told = parse_judgement(replied)
    return told.select("eval_id", "scorer", "value", "score", "rationale", F.coalesce("call_error", "error").alias("error"))


def row_metrics(feedback: DataFrame) -> DataFrame:
    """One metric per row and scorer: its score, or 1 and 0 for a verdict.  Feedback without
    either (not compared, failed) is no metric."""
    metric, value = _metric(feedback)
    return feedback.select("eval_id", metric.alias("metric"), value.alias("value")).filter(F.col("value").isNotNull())


def _metric(feedback: DataFrame) -> tuple[Column, Column]:
    score = F.col("score") if "score" in feedback.columns else F.lit(None).cast("double")
    return F.concat("scorer", F.lit("/mean")), F.coalesce(score, F.col("value").cast("double"))


def row_scores(feedback: DataFrame, core_weights: dict[str, float] | None = None) -> DataFrame:
    """Per row the composite score over its own feedback (null without any metric) and all
    feedback as one text, a line per scorer in order of names.  Both come from one grouping,
    so that the feedback is worked out and shuffled once."""
    error = F.col("error") if "error" in feedback.columns else F.lit(None).cast("string")
    metric, value = _metric(feedback)
    rows = feedback.select("eval_id", "scorer", F.concat(F.col("scorer"), F.lit(": "), F.coalesce(
        F.col("rationale"), error, F.lit(""))).alias("line"), metric.alias("metric"), value.alias("value"))
    is_metric = F.col("value").isNotNull() & F.col("eval_id").isNotNull()  # feedback on no known row has no score
    sums = metrics.composite_sums(is_metric, F.col("metric"), F.col("value"), core_weights)
    grouped = rows.groupBy("eval_id").agg(metrics.joined_text(F.col("scorer"), F.col("line")).alias("feedback"),
                                          F.count(F.lit(1)).alias("n_items"), *sums)
    return grouped.select("eval_id", "feedback", "n_items", *metrics.composite_columns())


def row_context(evals: DataFrame, feedback: DataFrame) -> DataFrame:
    """The optimiser's view: each row of ``evals`` with ``assessments``, the list of its feedback in
    order of scorers (empty without any).  A list has as many items as there are scorers."""
    parts = [c for c in ("scorer", "value", "score", "rationale", "error") if c in feedback.columns]
    lists = feedback.groupBy("eval_id").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("assessments"))
    kind = lists.schema["assessments"].dataType
    return evals.join(lists, "eval_id", "left").withColumn("assessments", F.coalesce("assessments", F.array().cast(kind)))
