"""Keyword-distribution scorer: per-text keyword histograms, their
difference over the union of keys (missing = 0) and the verdict.

Counting is inside one row: each side's tokens become a map keyword -> count,
and only the results are exploded, so no job here shuffles.  Row ids are to be
unique, as nothing is summed over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlscore.functions.sqltext import LEXICON, count_map, sql_tokens

PASS = "Keyword counts of the candidate and the gold query are equal."
FAIL = "Keyword counts differ; see metadata (gold minus candidate, per keyword)."
NO_GOLD = "Not compared: there is no gold query."
NO_CANDIDATE = "Not compared: there is no candidate query."


def _counts(df: DataFrame, col: str) -> Column:
    return count_map(F.col(col + "__tokens") if col + "__tokens" in df.columns else sql_tokens(F.col(col)))


def keyword_histogram(df: DataFrame, id_col: str, text_cols: dict[str, str]) -> DataFrame:
    """(id, side, keyword, n) for each text column; ``text_cols`` maps side -> column."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), _counts(df, col).alias("counts"))
                      for side, col in text_cols.items()])
    return (df.select(F.col(id_col), F.inline(sides))
            .select(id_col, "side", F.explode_outer("counts").alias("keyword", "n"))
            .filter(F.col("keyword").isNotNull()).withColumn("n", F.col("n").cast("long")))


def missing_text(gold: Column, cand: Column) -> Column:
    """Why a pair cannot be compared; null if both texts are there."""
    return F.when(gold.isNull(), F.lit(NO_GOLD)).when(cand.isNull(), F.lit(NO_CANDIDATE))


def keyword_differences(df: DataFrame, id_col: str, gold: str = "gold_sql", cand: str = "candidate_sql") -> DataFrame:
    """Row form: id, ``missing`` and ``d``, a map keyword -> (gold_n, cand_n) over the union of keys."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counted = df.select(id_col, missing_text(F.col(gold), F.col(cand)).alias("missing"),
                        _counts(df, gold).alias("g"), _counts(df, cand).alias("c"))
    return counted.select(id_col, "missing", F.map_zip_with("g", "c", lambda _, g, c: F.struct(
        zero(g).alias("gold_n"), zero(c).alias("cand_n"))).alias("d"))


def keyword_diff(df: DataFrame, id_col: str, gold: str = "gold_sql", cand: str = "candidate_sql") -> DataFrame:
    """(id, keyword, gold_n, cand_n, diff) over the union of keywords."""
    return (keyword_differences(df, id_col, gold, cand)
            .select(id_col, F.explode_outer("d").alias("keyword", "n")).filter(F.col("keyword").isNotNull())
            .select(id_col, "keyword", "n.gold_n", "n.cand_n", (F.col("n.gold_n") - F.col("n.cand_n")).alias("diff")))


def keyword_verdict(df: DataFrame, id_col: str, gold: str = "gold_sql", cand: str = "candidate_sql") -> DataFrame:
    """(id, value, n_diff_keywords, metadata, rationale) for every eval row
    (texts with no keywords at all are equal).  The metadata map keeps all
    keys, zeros included, only when the verdict is false.  A row without a gold or a
    candidate text has a null verdict and the reason as its rationale."""
    diffs = keyword_differences(df, id_col, gold, cand).select(
        id_col, "missing", F.transform_values("d", lambda _, n: (n["gold_n"] - n["cand_n"]).cast("int")).alias("difference"))
    n = F.size(F.filter(F.map_values("difference"), lambda x: x != 0)).cast("long")
    value = F.col("n_diff_keywords") == 0
    return diffs.withColumn("n_diff_keywords", F.when(F.col("missing").isNull(), n)).select(
        id_col, value.alias("value"), "n_diff_keywords",
        F.when(~value, F.col("difference")).alias("metadata"),
        F.coalesce("missing", F.when(value, F.lit(PASS)).otherwise(F.lit(FAIL))).alias("rationale"))


def keywords_equal(gold_tokens: Column, cand_tokens: Column) -> Column:
    """Row form of the verdict: equal histograms <=> equal sorted keyword lists; null without one of the texts."""
    kg = F.sort_array(F.filter(gold_tokens, lambda t: t.isin(LEXICON)))
    kc = F.sort_array(F.filter(cand_tokens, lambda t: t.isin(LEXICON)))
    return kg == kc
