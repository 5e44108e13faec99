"""User model functions applied to rows in Arrow batches.

``apply_model`` runs a user-given ``fn(pd.Series) -> pd.Series`` inside
``mapInPandas``: Spark partitions the rows and each task calls the function
batch by batch.  Answers are taken by position and their number is checked.
A call that still fails after its attempts is halved, down to single rows, so
only the rows that fail on their own get a null output and an ``error``.

``ask_stored`` keeps answers in a table, so that a job that fails late does not ask
everything again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def call_rows(fn: Callable[[pd.Series], pd.Series], values: pd.Series, attempts: int,
              delay: float) -> list[tuple[object, str | None]]:
    """(answer, error) for each value, in order."""
    error = ""
    for attempt in range(attempts):
        try:
            out = list(fn(values))
            if len(out) != len(values):
                raise ValueError(f"{len(out)} answers for {len(values)} rows")
            return [(None if pd.isna(x) else x, None) for x in out]
        except Exception as exc:  # noqa: BLE001 - user code
            error = f"{type(exc).__name__}: {exc}"
            if attempt + 1 < attempts and delay:
                time.sleep(delay * (attempt + 1))
    if len(values) == 1:
        return [(None, error)]
    half = len(values) // 2
    return call_rows(fn, values.iloc[:half], attempts, delay) + call_rows(fn, values.iloc[half:], attempts, delay)


def apply_model(df: DataFrame, input_col: str, fn: Callable[[pd.Series], pd.Series],
                output_col: str = "output", attempts: int = 3, delay: float = 0.0,
                partitions: int | None = None, batch_size: int | None = None) -> DataFrame:
    """``output_col`` = fn(input_col) per row; ``error`` set on final failure.
    Rows whose input is null are passed through (null output) without a call.
    ``partitions`` spreads the rows over so many tasks first (a shuffle)."""
    schema = T.StructType(df.schema.fields + [T.StructField(output_col, T.StringType()),
                                              T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            size = batch_size or max(1, len(pdf))
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at:at + size].reset_index(drop=True)
                todo = part[input_col][part[input_col].notna()]
                answers = call_rows(fn, todo, max(1, attempts), delay) if len(todo) else []
                found = dict(zip(todo.index, answers))
                part[output_col] = pd.Series([found.get(i, (None, None))[0] for i in part.index], dtype="object")
                part["error"] = pd.Series([found.get(i, (None, None))[1] for i in part.index], dtype="object")
                yield part

    return (df.repartition(partitions) if partitions else df).mapInPandas(run, schema)


ANSWERS = "digest string, answer string, error string, asked_at timestamp"


def prompt_digest(prompt: Column, model: str) -> Column:
    """Key of an answer: the model's name and the whole prompt."""
    return F.sha2(F.concat(F.lit(model), F.lit("\n"), prompt), 256)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """All calls recorded in a store (an empty table before the first)."""
    try:
        return spark.read.schema(ANSWERS).parquet(store)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWERS)


def ask_missing(df: DataFrame, input_col: str, fn: Callable[[pd.Series], pd.Series], store: str, model: str,
                portions: int = 8, max_portions: int | None = None, attempts: int = 3, delay: float = 0.0,
                partitions: int | None = None, batch_size: int | None = None) -> None:
    """Ask what the store has no answer for, each different prompt once, and append
    the calls to the store.

    Prompts are cut into ``portions`` by their digest, one job each; a portion is in the
    store as a whole or not at all.  After a crash, or a stop after ``max_portions``,
    another call goes on with what an anti join finds unanswered.  Failed calls are
    recorded with their error and asked again next time."""
    prompts = df.select(F.col(input_col).alias("prompt")).filter(F.col("prompt").isNotNull()).distinct()
    prompts = prompts.withColumn("digest", prompt_digest(F.col("prompt"), model))
    for portion in range(portions if max_portions is None else min(portions, max_portions)):
        have = stored_answers(df.sparkSession, store).filter(F.col("error").isNull()).select("digest")
        mine = prompts.filter(F.pmod(F.xxhash64("digest"), F.lit(portions)) == portion).join(have, "digest", "left_anti")
        asked = apply_model(mine, "prompt", fn, "answer", attempts, delay, partitions, batch_size)
        asked.select("digest", "answer", "error", F.current_timestamp().alias("asked_at")).write.mode("append").parquet(store)


def ask_stored(df: DataFrame, input_col: str, fn: Callable[[pd.Series], pd.Series], store: str, model: str,
               output_col: str = "output", **how) -> DataFrame:
    """``apply_model`` with a store of answers (a folder): ``output_col`` and ``error``
    for each row, asked before or now (``how``: options of ``ask_missing``).  Rows without a
    prompt and rows not yet asked have neither."""
    ask_missing(df, input_col, fn, store, model, **how)
    # two jobs that ask at once may both record a prompt: the least answer counts for all rows alike
    calls = stored_answers(df.sparkSession, store).groupBy("digest").agg(
        F.min(F.when(F.col("error").isNull(), F.struct(F.lit(1), F.col("answer").alias("answer")))).alias("good"),
        F.max_by("error", "asked_at").alias("failed"))
    answers = calls.select(F.col("digest").alias("__digest"), F.col("good.answer").alias(output_col),
                           F.when(F.col("good").isNull(), F.col("failed")).alias("error"))
    keyed = df.withColumn("__digest", prompt_digest(F.col(input_col), model))
    return keyed.join(answers, "__digest", "left").drop("__digest")


def ai_query(df: DataFrame, column: str, instruction: str, fn: Callable[[pd.Series], pd.Series],
             output_col: str) -> DataFrame:
    """Model call on ``instruction + column`` as a new column."""
    prompt = df.withColumn("__prompt", F.concat(F.lit(instruction), F.col(column)))
    return apply_model(prompt, "__prompt", fn, output_col).drop("__prompt", "error")


def answer_followups(replies: DataFrame, evals: DataFrame, helper: Callable[[pd.Series], pd.Series],
                     model: Callable[[pd.Series], pd.Series],
                     help_template: str = "Question: {question}\nThe service asks: {followup}\nReference SQL: {gold_sql}",
                     ask_template: str = "{question}\n{answer}") -> DataFrame:
    """Replies that asked a follow-up are asked again.

    ``helper`` sees the question, the service's follow-up text (column
    ``followup``) and the gold SQL and answers the follow-up; ``model``, the
    service under test, then gets the question with that answer, never the
    gold, and its output is the candidate.  All other replies pass through:
    only follow-ups get a prompt, and functions are called for non-null
    prompts only.  A failed call of either gives status ``model_error``."""
    from sqlscore.functions.sqltext import render
    from sqlscore.operators.evalset import gold_lookup
    follow = F.col("status") == "followup"
    ctx = gold_lookup(replies, evals).withColumn("__prompt", F.when(follow, render(
        help_template, {c: F.col(c) for c in ("question", "followup", "gold_sql")})))
    helped = apply_model(ctx, "__prompt", helper, "__answer").withColumnRenamed("error", "__error")
    asked = helped.withColumn("__ask", F.when(follow & F.col("__error").isNull(), render(
        ask_template, {"question": F.col("question"), "answer": F.col("__answer")})))
    out = apply_model(asked, "__ask", model, "__sql")
    failed = F.coalesce("__error", "error").isNotNull()
    return (out.withColumn("candidate_sql", F.when(follow, F.col("__sql")).otherwise(F.col("candidate_sql")))
            .withColumn("status", F.when(follow & ~failed, F.lit("answered"))
                        .when(follow, F.lit("model_error")).otherwise(F.col("status")))
            .drop("__prompt", "__answer", "__error", "__ask", "__sql", "error", "gold_eval_id", "gold_sql", "followup"))
