"""Scorer registry and ``evaluate``.

A column scorer names the parts it needs of a row's texts, and gives a value
and a rationale as columns over these parts.  Tokens, parts and values of all
chosen scorers are three projections of one pass, so a text is read and
tokenized once however many scorers there are; the result is unpivoted to the
long feedback form.  A frame scorer (such as the executed-result scorer) makes its feedback
rows with jobs of its own; ``evaluate`` unions both kinds by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from itertools import count, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlscore.functions.sqltext import strip_to_names
from sqlscore.operators import equivalence, keywords, metrics, rules
from sqlscore.session import scratch_path, stash

ColumnScorer = Callable[[dict], tuple[dict[str, Column], Column, Column]]  # options -> parts, value, rationale
FrameScorer = Callable[[DataFrame, dict], DataFrame]    # rows, options -> eval_id, value, rationale
_COLUMNS: dict[str, ColumnScorer] = {}
_FRAMES: dict[str, FrameScorer] = {}


def scorer(name: str, frame: bool = False):
    """Register a scorer under ``name`` (decorator)."""
    def deco(fn):
        (_FRAMES if frame else _COLUMNS)[name] = fn
        return fn
    return deco


def registered() -> list[str]:
    return [*_COLUMNS, *_FRAMES]


def load_scorers(names: list[str]) -> list[str]:
    """Scorers chosen by name (e.g. from a config list)."""
    missing = [n for n in names if n not in registered()]
    if missing:
        raise KeyError(f"unknown scorers: {missing}")
    return list(names)


NAMES = "__names"  # texts without literals and comments, names kept
ALL = "__all"  # tokens of all statements; those of the first have the suffix of ``rules``


def _gold(suffix: str = rules.SUFFIX) -> Column:
    return F.col("gold_sql" + suffix)


def _cand(suffix: str = rules.SUFFIX) -> Column:
    return F.col("candidate_sql" + suffix)


@scorer("sql_clauses_distribution_equivalence")
def keyword_scorer(options: dict):
    same = F.col("same_keywords")
    return ({"same_keywords": keywords.keywords_equal(_gold(), _cand()),
             "no_candidate": F.col("gold_sql").isNotNull() & F.col("candidate_sql").isNull()}, same,
            F.when(same, F.lit(keywords.PASS)).when(~same, F.lit(keywords.FAIL))
            .when(F.col("no_candidate"), F.lit(keywords.NO_CANDIDATE)).otherwise(F.lit(keywords.NO_GOLD)))


@scorer("count_joins")
def count_joins_scorer(options: dict):
    g, c = F.col("gold_joins"), F.col("cand_joins")
    return ({"gold_joins": rules.join_count_tokens(_gold(ALL)), "cand_joins": rules.join_count_tokens(_cand(ALL))}, g == c,
            F.concat_ws(" ", F.lit("joins:"), g.cast("string"), F.lit("and"), c.cast("string")))


@scorer("has_select")
def has_select_scorer(options: dict):
    return {"gold_has_select": rules.has_select_tokens(_gold(ALL))}, F.col("gold_has_select"), F.lit(None).cast("string")


@scorer("dimension_ambiguity")
def tables_scorer(options: dict):
    parts = {"gold_tables": rules.tables_named(_gold(NAMES)), "cand_tables": rules.tables_named(_cand(NAMES))}
    less = lambda a, b: F.array_join(F.array_except(a, b), ",")
    missing, extra = less("gold_tables", "cand_tables"), less("cand_tables", "gold_tables")
    return (parts, (missing == "") & (extra == ""),
            F.concat_ws(" ", F.lit("missing:"), missing, F.lit("extra:"), extra))


@scorer("required_dims")
def required_dims_scorer(options: dict):
    missing = F.col("missing_dims")
    return ({"missing_dims": rules.missing_dims(rules.dims_named(_cand(NAMES)), options.get("required_dims", []))},
            missing == "", F.when(missing != "", F.concat(F.lit("missing: "), missing)))


@scorer("sql_results_equivalence", frame=True)
def results_scorer(df: DataFrame, options: dict) -> DataFrame:
    keep = {k: options[k] for k in ("group_size", "mode", "order_key", "views", "samples", "threads") if k in options}
    return score_results(df.sparkSession, df, **keep).select("eval_id", "value", "rationale")


def evaluate(df: DataFrame, names: list[str], **options) -> DataFrame:
    """Long feedback (eval_id, scorer, value, rationale) of the named scorers."""
    load_scorers(names)
    outs = []
    columns = [n for n in names if n in _COLUMNS]
    if columns:
        made = [(n, *_COLUMNS[n](options)) for n in columns]
        texts = ("gold_sql", "candidate_sql")
        first = rules.tokenize(df, *texts)
        every = [F.when(F.col(c).contains(";"), rules.sql_tokens(F.col(c), only_first_statement=False))
                 .otherwise(F.col(c + rules.SUFFIX)).alias(c + ALL) for c in texts]
        every += [strip_to_names(F.col(c)).alias(c + NAMES) for c in texts]
        parts = first.select("*", *every).select(
            "eval_id", *(c.alias(name) for _, own, _, _ in made for name, c in own.items()))
        wide = parts.select("eval_id", F.array(*(
            F.struct(F.lit(n).alias("scorer"), v.alias("value"), r.alias("rationale")) for n, _, v, r in made)).alias("f"))
        # the outer form: no filter on the array's size that would work out everything again
        outs.append(wide.select("eval_id", F.inline_outer("f")))
    outs += [_FRAMES[n](df, options).withColumn("scorer", F.lit(n)) for n in names if n in _FRAMES]
    return metrics.union_feedback(*outs)


def score_results(spark: SparkSession, df: DataFrame, group_size: int = 25, mode: str = "bag",
                  order_key: str | None = None, views: set[str] | None = None, samples: int = 5,
                  threads: int = 4) -> DataFrame:
    """Executed-result verdict for every row of an eval set with gold_sql and
    candidate_sql, with a rationale and up to ``samples`` differing rows a side,
    by the rules of ``mode`` (in ordered mode with the row's place).

    Equal pairs of texts run once.  Each pair needs a plan of its own, made on the
    driver, so ``threads`` driver threads plan and run groups of ``group_size`` pairs at once, each group
    as one job in a scheduler pool of its own (shared out fairly where the session has
    ``spark.scheduler.mode=FAIR``).  The driver holds these groups and no more; a
    group's verdicts are a table in the shared folder, and the tables are joined back to the rows."""
    text = lambda c: F.coalesce(F.sha2(F.col(c), 256), F.lit("-"))
    keyed = stash(df.withColumn("pair_id", F.sha2(F.concat_ws(":", text("gold_sql"), text("candidate_sql")), 256)), "pairs")
    distinct = keyed.select("pair_id", "gold_sql", "candidate_sql").dropDuplicates(["pair_id"]).toLocalIterator()
    path = scratch_path(spark, "verdicts")
    spark.createDataFrame([], VERDICT_TEXT).write.parquet(f"{path}/group=-1")

    def score(nth: int, group: list[equivalence.Pair]) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"verdicts-{nth % threads}")
        rows = equivalence.report_pairs(spark, group, samples, mode, group_size, order_key=order_key, views=views)
        spark.createDataFrame(rows, VERDICT_TEXT).coalesce(1).write.parquet(f"{path}/group={nth}")

    _run_threads(threads, score, iter(lambda: [equivalence.Pair(r["pair_id"], r["gold_sql"], r["candidate_sql"])
                                               for r in islice(distinct, group_size)], []))
    v = spark.read.schema(VERDICT_TEXT).parquet(path).drop("group")
    return keyed.join(v, "pair_id", "left").select(*df.columns, *[c for c in v.columns if c != "pair_id"])


def _run_threads(threads: int, work: Callable[[int, list], None], groups: Iterator[list]) -> None:
    """``work(number, group)`` for all groups, ``threads`` at a time; a group is drawn when a thread is free."""
    with ThreadPoolExecutor(threads) as pool:
        running = set()
        for nth, group in zip(count(), groups):
            running.add(pool.submit(work, nth, group))
            if len(running) == threads:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                for d in done:
                    d.result()
        for d in running:
            d.result()


VERDICT_TEXT = equivalence.VERDICT_TEXT
