"""Hot keys: one question / one row value holding a third of the rows must
give exactly the same answers as the uniform case (AQE skew handling and
partial aggregation must not change results)."""

from pyspark.sql import functions as F

from sqlscore.operators import evalset, keywords
from sqlscore.operators.equivalence import results_equal


def test_hot_question_gold_lookup(spark):
    n = 3000
    evals = spark.range(n).select(
        F.col("id").alias("eval_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("q"), F.col("id").cast("string")))
        .alias("original_question"),
        F.concat(F.lit("SELECT "), F.col("id").cast("string")).alias("gold_sql"))
    cands = evals.select(F.col("eval_id"), F.col("original_question").alias("question")).repartition(7)
    out = evalset.gold_lookup(cands, evals)
    hot = out.filter("question = 'hot'")
    assert out.count() == n and hot.count() == n // 3
    assert hot.select("gold_eval_id").distinct().collect()[0][0] == 0
    assert hot.select("gold_sql").distinct().collect()[0][0] == "SELECT 0"


def test_hot_row_value_in_result_diff(spark):
    base = spark.range(30000).select((F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))).alias("v"))
    fewer = base.filter("NOT (v = 0 AND rand(1) < 0)")  # same rows, another plan
    one_less = base.exceptAll(spark.createDataFrame([(0,)], "v long"))
    assert results_equal(base, fewer).first()["value"] is True
    r = results_equal(base, one_less).first()
    assert r["value"] is False and r["only_in_gold"] == 1 and r["only_in_candidate"] == 0


def test_hot_keyword_counts(spark):
    rows = [(i, "SELECT a FROM t WHERE x IN (SELECT b FROM u)" if i % 3 == 0 else f"SELECT {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "eval_id int, gold_sql string")
    h = keywords.keyword_histogram(df, "eval_id", {"gold": "gold_sql"})
    tot = {r["keyword"]: r["t"] for r in h.groupBy("keyword").agg(F.sum("n").alias("t")).collect()}
    assert tot["SELECT"] == 900 + 300 and tot["FROM"] == 600 and tot["IN"] == 300 and tot["WHERE"] == 300


def test_spread_only_when_asked(spark):
    from sqlscore.operators.parallel import SETTING, asked_partitions, spread
    df = spark.range(0, 1000, numPartitions=3)
    assert spread(df) is df and asked_partitions(spark) is None
    assert spread(df, 5).rdd.getNumPartitions() == 5
    assert spread(df, 5, keys=("id",)).count() == 1000
    spark.conf.set(SETTING, "6")
    try:
        assert asked_partitions(spark) == 6
    finally:
        spark.conf.unset(SETTING)


def test_null_keys_and_ties_in_skew_safe_windows(spark):
    from sqlscore.operators import cycles
    rows = [(None if i % 2 else "a", i // 2, float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "run_id string, cycle int, value double").repartition(4)
    plain = cycles.previous_current(df, ["value"]).collect()
    safe = cycles.previous_current(df, ["value"], skew_safe=True).collect()
    assert sorted(map(str, plain)) == sorted(map(str, safe))
    ctx = lambda s: sorted(str((r["run_id"], r["cycle"], r["context"])) for r in
                           cycles.lookback(df, 3, skew_safe=s).collect())
    assert ctx(False) == ctx(True)
    tied = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 5), (None, 7)], "run_id string, started_at int")
    for safe in (False, True):
        assert sorted(r["cycle"] for r in cycles.number_cycles(tied, skew_safe=safe).collect()) == [1, 1, 1, 2, 2]


def test_token_diff_with_null_run(spark):
    from sqlscore.operators import cycles
    df = spark.createDataFrame([(None, 1, "a b"), (None, 2, "a c c")], "run string, cycle int, text string")
    out = {r["token"]: r["diff"] for r in cycles.token_diff(df, "run", "cycle", "text").collect()}
    assert out == {"b": -1, "c": 2}


def test_feedback_text_parts_of_a_hot_conversation(spark, tmp_path):
    """A third of all rows in one conversation: bounded parts that make up the one text."""
    from sqlscore.plans.queries import QUERIES, TEXT_PART_CHARS
    spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 7 != 0, F.repeat(F.lit("text "), 10)).alias("text")).write.parquet(f"{tmp_path}/conversations.parquet")
    whole = {(r["conv_id"], r["role"]): (r["text"], r["n_items"]) for r in QUERIES["feedback_text"](spark, str(tmp_path)).collect()}
    parts = QUERIES["feedback_text_parts"](spark, str(tmp_path)).orderBy("conv_id", "role", "part").collect()
    for key, (text, n) in whole.items():
        mine = [r for r in parts if (r["conv_id"], r["role"]) == key]
        assert "\n".join(r["text"] for r in mine) == text and sum(r["n_items"] for r in mine) == n
    assert max(len(r["text"]) for r in parts) < TEXT_PART_CHARS + 200 and sum(r["conv_id"] == 0 for r in parts) > 10
