import pytest
from pyspark.sql import functions as F

from sqlscore.operators import cycles, evalset, metrics


@pytest.fixture
def evals(spark):
    return spark.createDataFrame(
        [(i, f"q{i % 3}", f"SELECT $x FROM orders WHERE id = {i}", None) for i in range(10)],
        "eval_id int, question string, gold_sql string, issues string").withColumn(
        "original_question", F.col("question"))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_replicate(evals, n):
    r = evalset.replicate(evals, n)
    assert r.count() == 10 * n
    if n:
        assert sorted({x["replica"] for x in r.collect()}) == list(range(n))


def test_limit_none_and_zero(evals):
    assert evalset.limit(evals, None).count() == 10
    assert evalset.limit(evals, 0).count() == 10
    assert [r["eval_id"] for r in evalset.limit(evals, 3).collect()] == [0, 1, 2]
    assert evalset.prepare(evals, 4, 2).count() == 8


@pytest.mark.parametrize("frac,expect_test", [(0.0, 0), (1.0, 10)])
def test_split_extremes(evals, frac, expect_test):
    s = evalset.split(evals, frac)
    assert s.filter("split = 'test'").count() == expect_test


def test_split_stable_and_complete(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "eval_id")
    a = evalset.split(df, 0.3).filter("split='test'").select("eval_id")
    b = evalset.split(df.repartition(7), 0.3).filter("split='test'").select("eval_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    n = a.count()
    assert 500 < n < 700
    assert evalset.split(df, 0.3).count() == 2000


def test_prefix_accumulate(evals):
    once = evalset.prefix_questions(evals, "I1")
    twice = evalset.prefix_questions(once, "I2")
    assert twice.first()["question"] == "I2\nq0"
    acc = evalset.prefix_questions(once, "I2", accumulate=True)
    assert acc.first()["question"] == "I2\nI1\nq0"


def test_replace_terms_chain_and_last_wins(evals):
    pairs = [("orders", "o2"), ("id", "$key")]
    c = evalset.replace_terms(evals, pairs).first()["updated_gold_sql"]
    assert c == "SELECT $x FROM o2 WHERE $key = 0"
    last = evalset.replace_terms(evals, pairs, chain=False).first()["updated_gold_sql"]
    assert last == "SELECT $x FROM orders WHERE $key = 0"


def test_gold_lookup_dedup_lowest_id(spark, evals):
    cands = spark.createDataFrame([(100, "q1"), (101, "q9")], "eval_id int, question string")
    g = {r["eval_id"]: r for r in evalset.gold_lookup(cands, evals).collect()}
    assert g[100]["gold_eval_id"] == 1 and g[101]["gold_sql"] is None
    assert len(g) == 2


def test_requests_shape(evals):
    r = evalset.requests(evals.withColumn("issues", F.when(F.col("eval_id") == 0, "x"))).orderBy("eval_id").collect()
    assert r[0]["expectations"]["guidelines"] == ["x"] and r[1]["expectations"]["guidelines"] == []
    assert r[0]["inputs"]["inputs"]["question"] == "q0"


@pytest.fixture
def cm(spark):
    rows = [("r", 1, "a/mean", 1.0), ("r", 1, "b/mean", 3.0), ("r", 1, "c/mean", 5.0),
            ("r", 2, "a/mean", 2.0), ("r", 4, "a/mean", 4.0)]
    return spark.createDataFrame(rows, "run_id string, cycle int, metric string, value double")


def test_quality_score_counts_unweighted(cm):
    q = {r["cycle"]: r for r in metrics.quality_score(cm, {"a/mean": 0.5, "b/mean": 0.5}).collect()}
    assert q[1]["quality"] == pytest.approx((1 * 0.5 + 3 * 0.5) / 3)
    n = {r["cycle"]: r for r in metrics.quality_score(cm, {"a/mean": 0.5, "b/mean": 0.5}, normalise=True).collect()}
    assert n[1]["quality"] == pytest.approx(2.0)


def test_weights_must_sum_to_one(cm):
    with pytest.raises(ValueError):
        metrics.quality_score(cm, {"a/mean": 0.5})


def test_composite_no_custom_metric(cm):
    c = {r["cycle"]: r for r in metrics.composite_score(cm, {"a/mean": 1.0}).collect()}
    assert c[2]["n_custom"] == 0 and c[2]["custom_score"] == 0.0
    assert c[2]["composite"] == pytest.approx(0.7 * 2.0)
    assert c[1]["composite"] == pytest.approx(0.7 * 1.0 / 3 + 0.3 * ((3 + 5) / 2) / 3)


def test_metric_means_and_rename(spark):
    fb = spark.createDataFrame([("r", 1, "x/y", True), ("r", 1, "x/y", False)],
                               "run_id string, cycle int, scorer string, value boolean")
    m = metrics.metric_means(fb).first()
    assert m["mean"] == 0.5 and m["metric"] == "x/y/mean" and m["metric_name"] == "avg_x_y"


def test_cycles_first_cycle_and_gaps(cm):
    a = cm.filter("metric = 'a/mean'")
    d = {r["cycle"]: r for r in cycles.drift(a).collect()}
    assert d[1]["prev_value"] is None and d[2]["diff"] == 1.0 and d[4]["diff"] == 2.0
    lb = {r["cycle"]: r for r in cycles.lookback(a, 2).collect()}
    assert [x["cycle"] for x in lb[4]["context"]] == [2, 4]
    assert cycles.best_per_run(a, "value").first()["cycle"] == 4
    assert cycles.latest(a, "value").first()["value"] == 4.0


def test_token_diff(spark):
    t = spark.createDataFrame([("r", 1, "a a b"), ("r", 3, "a c")], "run string, cyc int, txt string")
    d = {(r["cyc"], r["token"]): r["diff"] for r in cycles.token_diff(t, "run", "cyc", "txt").collect()}
    assert d == {(3, "a"): -1, (3, "b"): -1, (3, "c"): 1}  # keyed by the later text's cycle (gaps allowed)


def test_ordered_text(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "z")], "k int, o int, t string")
    r = {x["k"]: x["text"] for x in metrics.ordered_text(df, ["k"], "o", "t").collect()}
    assert r == {1: "a\nb", 2: "z"}


def test_lag_safe_matches_window_lag_on_hot_key(spark):
    from pyspark.sql import Window
    # key 0 holds a third of the rows; 13 partitions split it into several chunks
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("o"), (F.col("id") * 7 % 101).alias("v"))
    got = cycles.lag_safe(df, "k", "o", ["v", "o"], partitions=13)
    want = df.withColumn("prev_v", F.lag("v").over(Window.partitionBy("k").orderBy("o"))) \
             .withColumn("prev_o", F.lag("o").over(Window.partitionBy("k").orderBy("o")))
    assert got.count() == 3000
    assert got.exceptAll(want.select(got.columns)).count() == 0
    assert got.filter("k = 0").select("prev_o").distinct().count() > 900


def test_ordered_text_parts_keep_every_text(spark):
    rows = [(1, i, "x" * 10) for i in range(10)] + [(2, 0, "y")]
    df = spark.createDataFrame(rows, "k int, o int, t string")
    parts = metrics.ordered_text(df, ["k"], "o", "t", sep="|", max_chars=25).collect()
    k1 = sorted((r["part"], r["text"]) for r in parts if r["k"] == 1)
    assert [p for p, _ in k1] == [0, 1, 2, 3]
    assert "|".join(t for _, t in k1) == "|".join(["x" * 10] * 10)
    assert all(len(t) <= 25 + 11 for _, t in k1)


def test_lookback_safe_matches_window_on_hot_key(spark):
    df = spark.range(0, 2000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("run_id"),
        F.col("id").alias("cycle"), (F.col("id") * 13 % 97).cast("double").alias("value"))
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = cycles.lookback(df, 3, skew_safe=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = cycles.lookback(df, 3)
    cols = ["run_id", "cycle", "context"]
    assert got.count() == 2000
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    g = {(r["run_id"], r["cycle"]): r["context_mean"] for r in got.collect()}
    w = {(r["run_id"], r["cycle"]): r["context_mean"] for r in want.collect()}
    assert all(abs(g[x] - w[x]) < 1e-9 for x in w)


def test_run_feedback_and_flatten(spark):
    fb = spark.createDataFrame([("r1", "s", True), ("r2", "s", False), ("r3", "s", True)],
                               "run_id string, scorer string, value boolean")
    assert metrics.run_feedback(fb, ["r1", "r3"]).count() == 2
    roots = spark.createDataFrame([("r2",)], "id string")
    assert metrics.run_feedback(fb, roots).first()["run_id"] == "r2"
    traces = spark.createDataFrame(
        [("t1", [("a", True, "ok"), ("b", False, "no")]), ("t2", [("a", True, None)]), ("t3", [])],
        "trace_id string, assessments array<struct<name:string,value:boolean,rationale:string>>")
    flat = metrics.flatten_assessments(traces).collect()
    assert len(flat) == 4 and {r["name"] for r in flat} == {"a", "b", None}  # a trace without assessments stays
    long = metrics.union_feedback(metrics.flatten_assessments(traces),
                                  spark.range(2).select(F.lit("x").alias("name")))  # range input selected first
    assert long.count() == 6
