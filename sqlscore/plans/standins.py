"""Framework tables derived from the driver tables by fixed rules.

The reference keeps evaluation sets, candidate replies, runs, per-cycle
metrics and logs in its own tables; the driver ships TPC-H-like tables
instead.  Each function here derives one framework table from whole
driver tables (no sampling, no id subsets), so every job built on it grows
with the data.  ``oracle.py`` holds the same rules in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlscore.operators.parallel import asked_partitions, spread
from sqlscore.sources.tables import load


def _pick(key: Column, options: list[Column]) -> Column:
    sel = F.pmod(key, F.lit(len(options)))
    out = options[-1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(sel == i, options[i]).otherwise(out)
    return out


def eval_set(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """One question per order: eval_id, question, original_question, gold_sql, issues.

    Four question templates (order key mod 4); questions repeat for a customer,
    so gold look-ups must de-duplicate.  Every 97th gold is missing.
    """
    # a one-file input is one partition: a session may ask for more of them, so that
    # text building and all scoring downstream run on every core
    o = spread(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), partitions or asked_partitions(spark))
    k = F.col("o_custkey").cast("string")
    question = _pick(F.col("o_orderkey"), [
        F.concat(F.lit("How many orders per priority does customer "), k, F.lit(" have?")),
        F.concat(F.lit("What is the total spend of customer "), k, F.lit(" by order status?")),
        F.concat(F.lit("Which are the three largest orders of customer "), k, F.lit("?")),
        F.concat(F.lit("What is the average order value of customer "), k, F.lit(" per year?")),
    ])
    gold = _pick(F.col("o_orderkey"), [
        F.concat(F.lit("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_custkey = "), k,
                 F.lit(" GROUP BY o_orderpriority ORDER BY n DESC")),
        F.concat(F.lit("SELECT o_orderstatus, SUM(o_totalprice) AS total FROM orders WHERE o_custkey = "), k,
                 F.lit(" GROUP BY o_orderstatus")),
        F.concat(F.lit("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = "), k,
                 F.lit(" ORDER BY o_totalprice DESC LIMIT 3")),
        F.concat(F.lit("WITH o AS (SELECT YEAR(o_orderdate) AS y, o_totalprice FROM orders WHERE o_custkey = "), k,
                 F.lit(") SELECT y, AVG(o_totalprice) AS avg_total FROM o GROUP BY y ORDER BY y")),
    ])
    return o.select(
        F.col("o_orderkey").alias("eval_id"),
        question.alias("question"),
        question.alias("original_question"),
        F.when(F.pmod(F.col("o_orderkey"), F.lit(97)) == 0, F.lit(None).cast("string")).otherwise(gold).alias("gold_sql"),
        F.when(F.pmod(F.col("o_orderkey"), F.lit(7)) == 0, F.lit("Use the order date, not the ship date"))
        .otherwise(F.lit(None).cast("string")).alias("issues"),
    )


def candidates(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """One candidate reply per eval row: eval_id, question, candidate_sql.

    Variant (order key mod 5): 0 = the gold text, 1 = lower-cased with a
    trailing comment that mentions keywords, 2 = wrapped in a join with a
    string literal that mentions keywords, 3 = back-quoted names, a comma join, an
    escaped quote and a column that ends in "join", 4 = a CTE with a column
    list, EXTRACT ... FROM and IS DISTINCT FROM.
    """
    e = eval_set(spark, sf_dir, partitions)
    g = F.coalesce(F.col("gold_sql"), F.lit("SELECT 1"))
    cust = F.regexp_extract(g, r"o_custkey = ([0-9]+)", 1)
    cand = _pick(F.col("eval_id"), [
        g,
        F.concat(F.lower(g), F.lit(" -- group by customer; order by nothing")),
        F.concat(F.lit("SELECT t.* FROM ("), g, F.lit(") t JOIN customer c ON c.c_custkey = "), cust,
                 F.lit(" WHERE c.c_name <> 'GROUP BY x'")),
        F.concat(F.lit("SELECT `o_custkey`, last_join FROM `db`.`orders` o, customer AS c "
                       "WHERE c_name = 'it\\'s GROUP BY' AND `o_custkey` = "), F.col("eval_id").cast("string")),
        F.concat(F.lit("WITH RECURSIVE y (a, b) AS (SELECT EXTRACT(YEAR FROM o_orderdate), o_custkey FROM orders) "
                       "SELECT * FROM y WHERE a IS DISTINCT FROM b AND b = "), F.col("eval_id").cast("string")),
    ])
    return e.select("eval_id", F.col("original_question").alias("question"), "gold_sql",
                    cand.alias("candidate_sql"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service replies as JSON text: reply_id, question, reply.

    Shape (eval id mod 5): 0 = no query attached (follow-up), 1 = two
    attachments, 2 = not JSON (of these, every third is valid JSON without the
    keys, and every third is missing), 3 and 4 = one attachment with a query.
    """
    c = candidates(spark, sf_dir)
    # JSON string literal of the SQL text: to_json of a one-element array minus the brackets
    q = F.expr("substr(to_json(array(candidate_sql)), 2, length(to_json(array(candidate_sql))) - 2)")
    one = F.concat(F.lit('{"conversation_id": "c'), F.col("eval_id").cast("string"),
                   F.lit('", "created_timestamp": '), (F.col("eval_id") * 1000).cast("string"),
                   F.lit(', "attachments": [{"query": {"query": '), q,
                   F.lit(', "description": "answer"}, "row_count": '), F.pmod(F.col("eval_id"), F.lit(50)).cast("string"),
                   F.lit("}]}"))
    reply = _pick(F.col("eval_id"), [
        F.concat(F.lit('{"conversation_id": "c'), F.col("eval_id").cast("string"),
                 F.lit('", "created_timestamp": 0, "attachments": [{"text": "Which customer do you mean?"}]}')),
        F.concat(F.lit('{"conversation_id": "c'), F.col("eval_id").cast("string"),
                 F.lit('", "created_timestamp": 0, "attachments": [{"query": {"query": "SELECT 1"}}, {"text": "x"}]}')),
        F.when(F.col("eval_id") % 3 == 0, F.lit("{}")).when(F.col("eval_id") % 3 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("service unavailable for "), F.col("eval_id").cast("string"))),
        one,
        one,
    ])
    return c.select(F.col("eval_id").alias("reply_id"), "question", reply.alias("reply"))


def cycle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-cycle scorer means from ``events``: run_id (user), cycle (day number
    1..n of the event date), metric ('<event_type>/mean'), value, n."""
    ev = load(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("run_id"),
                       (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("cycle"),
                       F.concat(F.col("event_type"), F.lit("/mean")).alias("metric"))
            .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")))


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form feedback rows from ``events``: run_id, cycle, scorer, score, value."""
    ev = load(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("run_id"),
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("cycle"),
        F.col("event_id").alias("item_id"),
        F.col("event_type").alias("scorer"),
        F.col("value").alias("score"),
        (F.col("value") >= 100).alias("value"),
        F.col("ts"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-level run tree from ``events``: root run per user, one cycle run
    per (user, day), one child run per event.  Names contain blanks."""
    ev = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    root = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    day = F.date_format("ts", "yyyyMMdd")
    cyc = F.concat(root, F.lit("-d"), day)
    children = ev.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("run_id"),
        cyc.alias("parent_run_id"), root.alias("root_run_id"),
        F.concat(F.col("event_type"), F.lit(" run "), F.col("event_id").cast("string")).alias("run_name"),
        F.lit("optimization").alias("mode"), F.col("value").alias("score"))
    cycles = ev.groupBy(cyc.alias("run_id"), root.alias("root_run_id"), day.alias("day")).agg(
        F.avg("value").alias("score")).select(
        "run_id", F.col("root_run_id").alias("parent_run_id"), "root_run_id",
        F.concat(F.lit("cycle "), F.col("day")).alias("run_name"), F.lit("cycle").alias("mode"), "score")
    roots = ev.groupBy(root.alias("run_id")).agg(F.avg("value").alias("score")).select(
        "run_id", F.lit(None).cast("string").alias("parent_run_id"), F.col("run_id").alias("root_run_id"),
        F.concat(F.lit("experiment "), F.col("run_id")).alias("run_name"),
        F.lit("root").alias("mode"), "score")
    return children.unionByName(cycles).unionByName(roots)
