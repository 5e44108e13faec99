"""Evaluation-set operators: prefix, term replacement, replication, split,
limit, request shaping and gold look-up.  All lazy DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscore.functions.sqltext import escape_replacement
from sqlscore.session import materialize


def keep_original(df: DataFrame) -> DataFrame:
    """B2: remember the untouched question once."""
    if "original_question" in df.columns:
        return df
    return df.withColumn("original_question", F.col("question"))


def with_null_issues(df: DataFrame) -> DataFrame:
    """Typed null ``issues`` (never a void column)."""
    return df.withColumn("issues", F.lit(None).cast("string"))


def prefix_questions(df: DataFrame, instruction: str, accumulate: bool = False) -> DataFrame:
    """B1: ``instruction + '\\n' + question``.  By default it starts from
    ``original_question`` each time; ``accumulate=True`` prefixes the current
    (already prefixed) question, as repeated cycles in the reference do."""
    base = F.col("question") if accumulate else F.col("original_question")
    return keep_original(df).withColumn("question", F.concat(F.lit(instruction), F.lit("\n"), base))


def replace_terms(df: DataFrame, pairs: list[tuple[str, str]], source: str = "gold_sql",
                  target: str = "updated_gold_sql", chain: bool = True) -> DataFrame:
    """Regex replacement of terms in gold SQL.  ``chain=True`` applies all
    pairs in order; ``chain=False`` keeps the reference's last-pair-wins result.
    Replacement texts are literal ($ and backslash escaped)."""
    out: Column = F.col(source)
    for pattern, repl in pairs:
        step = F.regexp_replace(F.col(source) if not chain else out, pattern, escape_replacement(repl))
        out = step
    return df.withColumn(target, out)


def replicate(df: DataFrame, n: int, col: str = "replica") -> DataFrame:
    """Every row n times with a 0-based replica number (n=0 -> no rows)."""
    if n < 0:
        raise ValueError("n must be >= 0")
    return df.select("*", F.posexplode(F.array_repeat(F.lit(0), F.lit(n))).alias(col, "__rep")).drop("__rep")


def split(df: DataFrame, test_fraction: float = 0.30, seed: int = 42, key: str = "eval_id",
          key_expr: Column | None = None) -> DataFrame:
    """Stable train/test label from a hash of the key (per mille buckets).

    Unlike ``randomSplit`` the label does not depend on partitioning or
    ordering.  ``key_expr`` may supply the bucket (0..999) explicitly."""
    if not 0.0 <= test_fraction <= 1.0:
        raise ValueError("test_fraction must be in [0, 1]")
    # eight hex digits of an MD5: every engine has it, and it never overflows
    digits = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8)
    bucket = key_expr if key_expr is not None else F.conv(digits, 16, 10).cast("long") % 1000
    return df.withColumn("split", F.when(bucket < int(round(test_fraction * 1000)), F.lit("test"))
                         .otherwise(F.lit("train")))


HASH_BUCKETS = 4096


def split_stratified(df: DataFrame, label: str, test_fraction: float = 0.30, seed: int = 42, key: str = "eval_id") -> DataFrame:
    """I2 with label coverage: of the n rows of each label round(n * test_fraction) are
    ``test``, but at least one and at most n - 1 where n is two or more; a single row is
    ``train``.  Within a label the rows with the least hashes of the key are taken.

    Rows are counted by label and part of the hash range, so the place where a label's quota ends
    is known without sorting the label: only rows of the part it ends in are ranked, a
    ``HASH_BUCKETS``-th of a label, however large it is.  A null label is a label; rows that share a key
    are told apart by their other columns."""
    if not 0.0 <= test_fraction <= 1.0:
        raise ValueError("test_fraction must be in [0, 1]")
    digits = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8)
    cells = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*cells).alias("row"), F.col(label).alias("label"), F.conv(digits, 16, 10).cast("long").alias("h"))
    rows = rows.withColumn("part", F.expr(f"h div {(1 << 32) // HASH_BUCKETS}"))
    counts = rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("label")  # at most HASH_BUCKETS rows
    total = F.sum("n").over(own)
    quota = F.floor(total * F.lit(test_fraction) + F.lit(0.5)).cast("long")
    quota = F.when(total == 1, F.lit(0).cast("long")).otherwise(F.least(F.greatest(quota, F.lit(1)), total - 1))
    wanted = quota - (F.sum("n").over(own.orderBy("part")) - F.col("n"))  # of this part, if the parts before are full
    parts = counts.select(F.col("label").alias("of"), F.col("part").alias("at"), "n", wanted.alias("wanted"))
    joined = rows.join(parts, F.col("label").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    whole = (F.col("wanted") <= 0) | (F.col("wanted") >= F.col("n"))
    sure = joined.filter(whole).select("row", (F.col("wanted") > 0).alias("test"))
    order = Window.partitionBy("label", "part").orderBy("h", F.col(f"row.`{key}`"), F.xxhash64("row"))
    cut = joined.filter(~whole).select("row", (F.row_number().over(order) <= F.col("wanted")).alias("test"))
    return sure.union(cut).select("row.*", F.when(F.col("test"), F.lit("test")).otherwise(F.lit("train")).alias("split"))


def materialise(df: DataFrame) -> tuple[DataFrame, int]:
    """The frame cut off from its plan by a checkpoint in the shared folder, so that
    several actions reuse it and survive lost executors, and its number of rows."""
    kept = materialize(df)
    return kept, kept.count()


def limit(df: DataFrame, n: int | None, order_by: str = "eval_id") -> DataFrame:
    """first n by a stable key; None or 0 means no limit.  Top-k, not a sort."""
    if not n:
        return df
    return df.orderBy(order_by).limit(n)


def prepare(df: DataFrame, n: int | None, replicas: int, order_by: str = "eval_id") -> DataFrame:
    """Limit, then replicate (lazy)."""
    return replicate(limit(df, n, order_by), replicas)


def questions(df: DataFrame, n: int | None = None) -> DataFrame:
    """Question columns only, optionally limited."""
    return limit(df.select("eval_id", "question", "original_question"), n)


def requests(df: DataFrame) -> DataFrame:
    """Nested evaluation requests, one per row, no collect."""
    return df.select(
        "eval_id",
        F.struct(F.struct(F.col("question").alias("question")).alias("inputs")).alias("inputs"),
        F.struct(
            F.when(F.col("issues").isNull(), F.array().cast("array<string>"))
            .otherwise(F.array(F.col("issues"))).alias("guidelines"),
            F.col("gold_sql").alias("expected_response"),
        ).alias("expectations"),
    )


def gold_lookup(cands: DataFrame, evals: DataFrame, on: str = "question") -> DataFrame:
    """Attach gold SQL to each candidate by question text (left join).

    Gold is de-duplicated first, keeping the lowest eval_id per question, so
    a repeated question never multiplies candidate rows.  The join is left to
    the optimiser: the gold side grows with the eval set, so it is shuffled,
    or broadcast by AQE only when its measured size is under the threshold.
    """
    gold = (evals.groupBy(F.col("original_question").alias(on))
            .agg(F.min_by(F.struct("eval_id", "gold_sql"), F.col("eval_id")).alias("g"))
            .select(on, F.col("g.eval_id").alias("gold_eval_id"), F.col("g.gold_sql").alias("gold_sql")))
    return cands.join(gold, on, "left")


def batches(df: DataFrame, size: int, order_by: str = "eval_id", out: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows in ``order_by`` order.  The
    position comes from a distributed zip-with-index over the sorted rows
    (range-partitioned sort, per-partition offsets), never a global
    ``row_number`` window in one partition."""
    from sqlscore.operators.equivalence import dense_index
    if size <= 0:
        raise ValueError("size must be > 0")
    ranked = dense_index(df.orderBy(order_by), "__pos")
    return ranked.withColumn(out, F.floor(F.col("__pos") / F.lit(size)).cast("long")).drop("__pos")


def guideline_requests(df: DataFrame, guidelines: dict[str, str], first_only: bool = True) -> DataFrame:
    """One judge request per (row, guideline).  The guidelines are a small
    parameter (a literal array exploded per row), so no join is involved.
    Versioned guideline lists keep only their first text, as the reference does."""
    items = F.array(*[F.struct(F.lit(k).alias("guideline"),
                               F.lit(v[0] if first_only and isinstance(v, (list, tuple)) else v).alias("guideline_text"))
                      for k, v in guidelines.items()])
    return df.select("*", F.inline(items))
