import os

from pyspark.sql import functions as F

from sqlscore.operators import runs
from sqlscore.session import scratch_path
from sqlscore.sources import evalsets
from sqlscore.streaming import means


def test_csv_multiline_and_alt_gold_name(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text('question,ground_truth_sql,issues\n"q1","SELECT a,\n  ""b""\nFROM t",\n"q2",,\n')
    df = evalsets.read_eval_csv(spark, str(p)).orderBy("question").collect()
    assert len(df) == 2 and df[0]["gold_sql"] == 'SELECT a,\n  "b"\nFROM t' and df[1]["gold_sql"] is None


def test_json_array(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text('[{"question": "q1", "ground_truth_query": "SELECT 1"},\n {"question": "q2", "ground_truth_query": "SELECT 2"}]')
    got = {r["question"]: r["gold_sql"] for r in evalsets.read_eval_json(spark, str(p), form="array").collect()}
    assert got == {"q1": "SELECT 1", "q2": "SELECT 2"}


def test_json_lines_and_wrong_forms(spark, tmp_path):
    import pytest
    p = tmp_path / "e.jsonl"
    p.write_text('{"question": "q1", "ground_truth_query": "SELECT 1", "eval_id": "7", "original_question": "o"}\n'
                 '{"question": "q2", "ground_truth_sql": "SELECT 2"}\n{"question": "q3", "gold_sql": "SELECT 3"}\n')
    got = {r["question"]: r for r in evalsets.read_eval_json(spark, str(p)).collect()}
    assert [got[q]["gold_sql"] for q in ("q1", "q2", "q3")] == ["SELECT 1", "SELECT 2", "SELECT 3"]
    assert (got["q1"]["eval_id"], got["q1"]["original_question"], got["q2"]["original_question"]) == ("7", "o", "q2")
    with pytest.raises(Exception):
        evalsets.read_eval_json(spark, str(p), form="array").collect()
    q = tmp_path / "a.json"
    q.write_text('[{"question": "q1"},\n {"question": "q2"}] trailing')
    for form in ("array", "lines"):
        with pytest.raises(Exception):
            evalsets.read_eval_json(spark, str(q), form=form).collect()


def test_three_part_name():
    assert evalsets.is_three_part("a.b.c") and not evalsets.is_three_part("a.b")


def test_versioned_write_never_overwrites(spark):
    base = scratch_path(spark, "tbl")
    v1 = evalsets.write_table(spark.range(3), base, versioned=True)
    v2 = evalsets.write_table(evalsets.read_latest(spark, base).union(spark.range(3, 5)), base, versioned=True)
    assert v1 != v2 and evalsets.read_latest(spark, base).count() == 5
    import os
    unfinished = base.removeprefix("file:") + "/v=99999999999999999"
    os.makedirs(unfinished)
    assert evalsets.read_latest(spark, base).count() == 5


def test_append_merge(spark):
    out = evalsets.append_merge(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string"))
    assert sorted(map(tuple, out.collect())) == [(1, None), (2, "x")]


def test_append_logs(spark):
    from sqlscore.streaming import logs
    base = scratch_path(spark, "logs")
    ev = spark.createDataFrame([("2024-01-01 00:00:00", "svc", 5.0)], "ts string, who string, v double")
    for _ in range(2):
        logs.append_logs(logs.log_rows(ev, "ts", "who", F.lit("INFO"), F.lit("hello")), base)
    assert spark.read.parquet(base).count() == 2


def test_schema_snapshot_and_drift(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([(1, 2.0)], "id bigint, score double")
    d = {r["col_name"]: r["change"] for r in runs.schema_drift(
        runs.schema_snapshot(spark, {"t": a}, "s1"), runs.schema_snapshot(spark, {"t": b}, "s2")).collect()}
    assert d == {"id": "retyped", "name": "dropped", "score": "added"}


def test_underscore_columns_collision(spark):
    import pytest
    df = spark.createDataFrame([(1, 2)], "`a b` int, a_b int")
    with pytest.raises(ValueError):
        runs.underscore_columns(df)


def test_stream_dedup_and_late_rows(spark):
    src = scratch_path(spark, "src")
    rows = [(1, "2024-01-01 10:00:00", "a", 1.0), (1, "2024-01-01 10:05:00", "a", 1.0),  # duplicate id
            (2, "2024-01-02 10:00:00", "a", 3.0), (3, "2024-01-03 12:00:00", "a", 5.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    df.write.parquet(os.path.join(src, "b1"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "*"))
    out = means.run_to_parquet(spark, means.dedup_stream(stream, "event_id", "ts", "1 hour"),
                               scratch_path(spark, "o"), scratch_path(spark, "c"))
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3]
    ck, od = scratch_path(spark, "c2"), scratch_path(spark, "o2")
    agg = means.running_means(stream, "ts", "event_type", "value", "1 day", "1 hour")
    r1 = means.run_to_parquet(spark, agg, od, ck).collect()
    assert sorted(r["window_start"].day for r in r1) == [1, 2]  # day 3 still open
    late = spark.createDataFrame([(4, "2024-01-01 11:00:00", "a", 100.0), (5, "2024-01-03 13:00:00", "a", 7.0),
                                  (6, "2024-01-05 00:00:00", "a", 0.0)],
                                 "event_id long, ts string, event_type string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    late.write.parquet(os.path.join(src, "b2"))
    r2 = {r["window_start"].day: r for r in means.run_to_parquet(spark, agg, od, ck).collect()}
    assert r2[1]["n"] == 2 and r2[1]["mean"] == 1.0  # the late row for day 1 is dropped
    assert r2[3]["n"] == 2 and r2[3]["mean"] == 6.0  # within the watermark, kept


def test_score_results_dedups_and_joins_back(spark):
    from sqlscore.operators.evaluate import evaluate, load_scorers, registered, score_results
    spark.createDataFrame([(1,), (2,)], "a int").createOrReplaceTempView("t_sr")
    df = spark.createDataFrame([
        (1, "SELECT a FROM t_sr", "SELECT a FROM t_sr ORDER BY a"),
        (2, "SELECT a FROM t_sr", "SELECT a FROM t_sr ORDER BY a"),
        (3, "SELECT a FROM t_sr", "SELECT a + 1 FROM t_sr"),
        (4, None, "SELECT 1")], "eval_id int, gold_sql string, candidate_sql string")
    r = {x["eval_id"]: x for x in score_results(spark, df).collect()}
    assert r[1]["value"] and r[2]["value"] and not r[3]["value"]
    assert r[3]["only_in_gold"] == 1 and r[4]["error"] == "gold:no_gold"
    assert r[3]["sample_gold"] == ['{"_c0":1}'] and r[3]["sample_candidate"] == ['{"_c0":3}']
    assert r[1]["rationale"] == "Both queries return the same 2 rows." and "no_gold" in r[4]["rationale"]
    one = score_results(spark, df, group_size=1)
    assert sorted(str(x["value"]) for x in one.collect()) == ["False", "False", "True", "True"]
    fb = evaluate(df, load_scorers(["count_joins", "has_select"])).collect()
    assert len(fb) == 8
    every = evaluate(df, registered(), required_dims=["a"])
    assert every.count() == 4 * len(registered()) and "required_dims" in registered()
    plan = evaluate(df, ["count_joins", "has_select", "dimension_ambiguity"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_score_results_shows_rows_in_every_mode(spark):
    from sqlscore.operators.evaluate import score_results
    rows = [(1, "SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, 'c')", "SELECT * FROM VALUES (2, 'a'), (1, 'b'), (3, 'c')"),
            (2, "SELECT * FROM VALUES (1, 'a')", "SELECT * FROM VALUES (7, 'a')"),
            (3, "SELECT * FROM VALUES (1, 'a')", "SELECT * FROM VALUES (1, 'a'), (1, 'a'), (4, 'd')"),
            (4, "SELECT * FROM VALUES (1, 'a')", "SELECT * FROM VALUES (1), (2)")]
    df = spark.createDataFrame(rows, "eval_id int, gold_sql string, candidate_sql string")
    shown = lambda **k: {r["eval_id"]: (r["value"], r["sample_gold"], r["sample_candidate"])
                         for r in score_results(spark, df, **k).collect()}
    r = shown(mode="ordered", order_key="_c0")
    cells = lambda n, k, x: f'{{"place":{n},"_c0":{k},"_c1":"{x}"}}'
    assert r[1] == (False, [cells(0, 1, "a"), cells(1, 2, "b")], [cells(0, 1, "b"), cells(1, 2, "a")])
    assert r[2] == (False, [cells(0, 1, "a")], [cells(0, 7, "a")])
    r = shown(mode="set", samples=1)
    assert r[2] == (False, ['{"_c0":1,"_c1":"a"}'], ['{"_c0":7,"_c1":"a"}'])
    assert r[3] == (False, [], ['{"_c0":4,"_c1":"d"}']) and len(r[4][2]) == 1


def test_parquet_and_table_readers(spark):
    base = scratch_path(spark, "ev")
    spark.createDataFrame([("q", "SELECT 1", None)], "question string, ground_truth_query string, issues string") \
        .write.parquet(base)
    e = evalsets.read_eval_parquet(spark, base).first()
    assert e["gold_sql"] == "SELECT 1" and e["original_question"] == "q" and e["eval_id"]
    import pytest
    with pytest.raises(ValueError):
        evalsets.read_eval_table(spark, "just_a_name")


def test_to_rows_batches_entities(spark):
    from dataclasses import dataclass

    @dataclass
    class Feedback:
        name: str
        value: bool
        rationale: str | None

    df = evalsets.to_rows(spark, [Feedback("a", True, None), Feedback("b", False, "x")])
    assert df.count() == 2 and df.columns == ["name", "value", "rationale"]
    assert dict(df.dtypes) == {"name": "string", "value": "boolean", "rationale": "string"}


def test_log_rows_schema(spark):
    from sqlscore.streaming import logs
    ev = spark.createDataFrame([("2024-01-01 00:00:00", "svc", 5.0)], "ts string, who string, v double")
    out = logs.log_rows(ev, "ts", "who", F.lit("INFO"), F.lit("hello"))
    assert out.columns == ["timestamp", "logger_name", "level", "message"]
    assert logs.log_levels(out).first()["n"] == 1
    bad = logs.log_rows(ev, "ts", "who", F.lit("LOUD"), F.lit("x"))
    assert bad.count() == 0


def test_stream_means_equal_batch_on_closed_windows(spark):
    from conftest import SF
    from sqlscore.plans.queries import q_stream_scorer_means
    stream = {(r["day"], r["event_type"]): (r["mean"], r["n"]) for r in q_stream_scorer_means(spark, SF).collect()}
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    last = ev.agg(F.max("ts")).first()[0]
    import datetime as dt
    batch = {(r["day"], r["event_type"]): (round(r["mean"], 9), r["n"]) for r in
             ev.groupBy("day", "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).collect()
             if dt.datetime.fromisoformat(r["day"]) + dt.timedelta(days=1) <= last - dt.timedelta(hours=1)}
    assert stream == batch and len(stream) > 0
