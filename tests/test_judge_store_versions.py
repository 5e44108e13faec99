"""Judged guidelines, the answer store, stratified splits, late rows, versions and nested texts."""

import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sqlscore.functions.sqltext import sql_keywords
from sqlscore.operators import evalset, judge, keywords, metrics, model, rules
from sqlscore.session import scratch_path
from sqlscore.sources import evalsets
from sqlscore.streaming import means


def test_judgements_are_typed(spark):
    replies = [('{"value": "Yes", "rationale": "r"}', (True, 1.0, None)), ('{"value": false, "score": 0.25}', (False, 0.25, None)),
               ('{"score": "0.5"}', (True, 0.5, None)), ('{"score": 1.5}', (None, None, "score")), ('{"score": "NaN"}', (None, None, "score")),
               ('{"value": "maybe", "score": 1}', (None, None, "value")), ("{}", (None, None, "no_judgement")), ("text", (None, None, "parse")),
               ("", (None, None, "parse")), ("[1]", (None, None, "parse")), (None, (None, None, "no_reply"))]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(replies)], "i int, reply string")
    got = {r["i"]: (r["value"], r["score"], r["error"]) for r in judge.parse_judgement(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(replies)}


def test_judge_feedback_union_and_row_scores(spark):
    df = spark.createDataFrame([(1, "SELECT 1", "SELECT 1"), (2, None, "x"), (3, "SELECT 3", "boom")], "eval_id int, gold_sql string, candidate_sql string")

    def fn(q):
        if q.str.contains("boom").any():
            raise ValueError("down")
        return pd.Series(['{"value": "yes", "score": 0.5, "rationale": "fine"}'] * len(q))
    fb = judge.judge(df, {"g": ["first text", "second"]}, fn, attempts=1)
    assert {r["eval_id"]: (r["value"], r["score"], r["error"]) for r in fb.collect()} == {
        1: (True, 0.5, None), 2: (True, 0.5, None), 3: (None, None, "ValueError: down")}
    lexical = spark.createDataFrame([(1, "count_joins", True, "same"), (2, "count_joins", None, "no gold")], "eval_id int, scorer string, value boolean, rationale string")
    extra = spark.createDataFrame([(4, "z", 0.0)], "eval_id int, scorer string, score double")
    every = metrics.union_feedback(lexical, fb, extra)
    assert every.columns == ["eval_id", "scorer", "value", "rationale", "score", "error"] and every.count() == 6
    rows = {r["eval_id"]: r for r in judge.row_scores(every).collect()}
    assert rows[1]["feedback"] == "count_joins: same\ng: fine" and rows[3]["feedback"] == "g: ValueError: down"
    assert rows[1]["composite"] == pytest.approx(0.7 * 0.0625 / 2 + 0.3 * 0.5 / 2) and rows[3]["composite"] is None
    assert rows[2]["n_metrics"] == 1 and rows[4]["composite"] == 0.0
    view = {r["eval_id"]: [a["scorer"] for a in r["assessments"]] for r in judge.row_context(
        spark.createDataFrame([(1,), (9,)], "eval_id int"), every).collect()}
    assert view == {1: ["count_joins", "g"], 9: []}


def test_answers_survive_a_crash(spark):
    df = spark.range(60).select("id", F.concat(F.lit("p"), (F.col("id") % 20).cast("string")).alias("prompt"))
    df = df.union(spark.createDataFrame([(99, None)], "id long, prompt string"))
    store = scratch_path(spark, "answers-test")

    def dies(q):
        if (q == "p13").any():
            raise SystemExit("the machine is gone")  # not an error of the model: the job fails
        return "old " + q
    with pytest.raises(Exception):
        model.ask_missing(df, "prompt", dies, store, "m", portions=20)
    before = {r["digest"] for r in model.stored_answers(spark, store).collect()}
    assert 0 < len(before) < 20
    out = model.ask_stored(df, "prompt", lambda q: "new " + q, store, "m", portions=3).collect()
    calls = model.stored_answers(spark, store).groupBy("digest").count().collect()
    assert len(calls) == 20 and all(r["count"] == 1 for r in calls)  # nothing was asked twice
    assert {r["output"][:3] for r in out if r["prompt"]} == {"old", "new"} and len(out) == 61
    assert [r["output"] for r in out if r["prompt"] is None] == [None]
    assert sum(r["output"].startswith("old") for r in out if r["prompt"]) == 3 * len(before)
    assert model.ask_stored(df, "prompt", lambda q: "x " + q, store, "other model", portions=1).filter("output LIKE 'x %'").count() == 60


def test_failed_calls_are_asked_again(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    store = scratch_path(spark, "answers-failed")

    def picky(q):
        if (q == "b").any():
            raise ValueError("no b")
        return q
    first = {r["prompt"]: (r["output"], r["error"]) for r in model.ask_stored(df, "prompt", picky, store, "m", attempts=1).collect()}
    assert first == {"a": ("a", None), "b": (None, "ValueError: no b")}
    again = {r["prompt"]: (r["output"], r["error"]) for r in model.ask_stored(df, "prompt", lambda q: q + "!", store, "m").collect()}
    assert again == {"a": ("a", None), "b": ("b!", None)}


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 1.0])
def test_stratified_split(spark, fraction):
    rows = [(i, "hot" if i % 3 else f"l{i % 40}") for i in range(900)] + [(1000, "one"), (1001, None), (1002, None), (7, "two"), (7, "two")]
    df = spark.createDataFrame(rows, "eval_id int, label string").withColumn("split", F.lit("x")).drop("split")
    out = evalset.split_stratified(df.repartition(7), "label", fraction).collect()
    assert sorted((r["eval_id"], str(r["label"])) for r in out) == sorted((i, str(x)) for i, x in rows)
    by = {}
    for r in out:
        by.setdefault(r["label"], []).append(r["split"])
    for splits in by.values():
        n = len(splits)
        assert splits.count("test") == (0 if n == 1 else min(max(int(n * fraction + 0.5), 1), n - 1))
    again = {r["eval_id"]: r["split"] for r in evalset.split_stratified(df.repartition(2), "label", fraction).collect() if r["eval_id"] != 7}
    assert again == {r["eval_id"]: r["split"] for r in out if r["eval_id"] != 7}


def test_late_rows_are_dropped_after_restarts(spark):
    at = lambda day, hour, i: (f"2024-01-{day:02d} {hour:02d}:00:00", "a", float(i))
    arrivals = [[at(1, 1, 1), at(1, 5, 3)], [at(2, 2, 5), at(2, 20, 7)], [at(3, 9, 9)], [at(4, 12, 11), at(1, 6, 100), at(3, 10, 13)]]
    frames = [spark.createDataFrame(a, "ts string, g string, v double").withColumn("ts", F.to_timestamp("ts")) for a in arrivals]
    out = means.replay(spark, frames, *(scratch_path(spark, f"late-{x}") for x in ("in", "out", "ckpt")),
                       lambda s: means.running_means(s, "ts", "g", "v", "1 day", "1 hour"))
    got = sorted((r["window_start"].day, r["mean"], r["n"]) for r in out.collect())
    assert got == [(1, 2.0, 2), (2, 6.0, 2), (3, 11.0, 2)]  # 100.0 came after its window was closed, 13.0 did not


def test_versions_of_two_writers(spark):
    base = scratch_path(spark, "versions")
    with pytest.raises(FileNotFoundError):
        evalsets.read_version(spark, base)
    assert evalsets.write_version(spark.range(3).toDF("id"), base) == 1
    results = []

    def write(k):
        try:
            results.append((k, evalsets.write_version(spark.range(k).toDF("id"), base, expected=1)))
        except evalsets.VersionConflict:
            results.append((k, None))
    threads = [threading.Thread(target=write, args=(k,)) for k in (10, 20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [k for k, v in results if v == 2]
    assert len(results) == 2 and evalsets.read_version(spark, base).count() == winner and evalsets.current_version(spark, base) == 2
    assert evalsets.read_version(spark, base, 1).count() == 3
    for n in range(3, 8):  # a version may be made from the one that is read
        assert evalsets.write_version(evalsets.read_version(spark, base).union(spark.range(1).toDF("id")), base) == n
    assert evalsets.read_version(spark, base).count() == winner + 5 and evalsets.current_version(spark, base) == 7


def test_eval_table_is_read(spark, tmp_path):
    spark.createDataFrame([("1", "q", "SELECT 1")], "eval_id string, question string, ground_truth_query string").write.option(
        "path", str(tmp_path / "t")).saveAsTable("default.evalset_for_test")
    try:
        row = evalsets.read_eval_table(spark, "spark_catalog.default.evalset_for_test").first()
        assert (row["question"], row["gold_sql"]) == ("q", "SELECT 1")
    finally:
        spark.sql("DROP TABLE default.evalset_for_test")


TABLES = [
    ("SELECT extract(year FROM cast(d AS date)) FROM orders", ["orders"]),
    ("SELECT trim(both 'x' FROM upper(c)), substring(c FROM position('a' IN c)) FROM t", ["t"]),
    ("SELECT * FROM `my db`.`my table`, `my db` . `other`", ["my db.my table", "my db.other"]),
    ("SELECT * FROM (SELECT * FROM a) x, b, c AS d JOIN e USING (f, g) WHERE h IN (SELECT i FROM j, k)", ["a", "b", "c", "e", "j", "k"]),
    ("SELECT * FROM (WITH q AS (SELECT 1 FROM r) SELECT * FROM q) z LEFT OUTER JOIN (s CROSS JOIN u) ON 1 = 1", ["r", "s", "u"]),
    ("SELECT array(SELECT max(x) FROM n), overlay(a PLACING b FROM length(c)) FROM range(10) r, m", ["m", "n"]),
    ("SELECT a IS NOT DISTINCT FROM b FROM t1 UNION ALL SELECT 1, 2 FROM t2 ORDER BY x, y LIMIT 3", ["t1", "t2"]),
    ("SELECT 1; SELECT 2 FROM later", ["later"]), ("no query", []), ("((((", []), (")) FROM x", ["x"]),
    ("SELECT f(g(h(extract(day FROM i(j(k FROM l)))))) FROM deep", ["deep"]),
]


@pytest.mark.parametrize(("sql", "want"), TABLES)
def test_tables(spark, sql, want):
    assert spark.createDataFrame([(sql,)], "s string").select(rules.tables_used(F.col("s"))).first()[0] == want


@pytest.mark.parametrize(("sql", "want"), [
    ("select /* a /* join */ where */ 1 from t", ["SELECT", "FROM"]), ("select /* /* */ where */ 1", ["SELECT"]),
    ("select '/* /*', 1 from t", ["SELECT", "FROM"]), ("select /* ' /* \" */ */ 1 -- /* /* where\nfrom t", ["SELECT", "FROM"]),
    ("select /* /* never closed from t", ["SELECT"]), ("select `/* from /*` from t /**/ /* x */ where", ["SELECT", "FROM", "WHERE"])])
def test_comments_nest(spark, sql, want):
    assert spark.createDataFrame([(sql,)], "s string").select(sql_keywords(F.col("s"))).first()[0] == want


def test_missing_texts_have_no_verdict(spark):
    df = spark.createDataFrame([(1, None, "xyz"), (2, "SELECT 1", None), (3, "xyz", "abc"), (4, None, None)], "eval_id int, gold_sql string, candidate_sql string")
    got = {r["eval_id"]: (r["value"], r["rationale"]) for r in keywords.keyword_verdict(df, "eval_id").collect()}
    assert got == {1: (None, keywords.NO_GOLD), 2: (None, keywords.NO_CANDIDATE), 3: (True, keywords.PASS), 4: (None, keywords.NO_GOLD)}
    from sqlscore.operators.evaluate import evaluate
    fb = {r["eval_id"]: (r["value"], r["rationale"]) for r in evaluate(df, ["sql_clauses_distribution_equivalence"]).collect()}
    assert fb == got


def test_rules_see_all_statements(spark):
    from sqlscore.operators.evaluate import evaluate
    df = spark.createDataFrame([(1, "SELECT 1; SELECT * FROM a JOIN b", "SELECT 1")], "eval_id int, gold_sql string, candidate_sql string")
    fb = {r["scorer"]: (r["value"], r["rationale"]) for r in evaluate(df, ["count_joins", "sql_clauses_distribution_equivalence"]).collect()}
    assert fb["count_joins"] == (False, "joins: 1 and 0") and fb["sql_clauses_distribution_equivalence"][0] is True


def test_row_scores_shuffle_feedback_once(spark):
    """F1: text and score of a row come from one grouping; rows without a metric have no score."""
    from sqlscore.operators import judge
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(1, "count_joins", True, "a"), (1, "x", None, "b"), (2, "x", None, None), (None, "x", True, "c")]
        feedback = spark.createDataFrame(rows, "eval_id int, scorer string, value boolean, rationale string").repartition(3)
        out = judge.row_scores(feedback)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
        got = {r["eval_id"]: (r["feedback"], r["n_items"], r["n_metrics"], r["composite"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got[1][:3] == ("count_joins: a\nx: b", 2, 1) and abs(got[1][3] - 0.7 * 0.0625) < 1e-12
    assert got[2] == ("x: ", 1, None, None) and got[None] == ("x: c", 1, None, None)


def test_judged_rows_are_spread_by_cores(spark):
    """a table of one file does not keep its rows in a fixed number of tasks."""
    from conftest import SF
    from sqlscore.operators.parallel import partitions
    from sqlscore.plans import queries, standins
    n = partitions(spark)
    assert n == 4 * spark.sparkContext.defaultParallelism
    for df in (queries._result_rows(spark, SF, n), standins.candidates(spark, SF, n)):
        assert f"RoundRobinPartitioning({n})" in df._jdf.queryExecution().executedPlan().toString()
