import pandas as pd
import pytest
from pyspark.sql import functions as F

from sqlscore.functions.sqltext import interleave, is_three_part_name, message_id, metric_rename, render
from sqlscore.operators import corpus, model, replies


def test_sectionise_cases(spark):
    html = ("<ul><li>before</li></ul><h2>Rules:</h2><ul><li> a </li><li><b>b</b></li></ul>"
            "<h2>Empty</h2><h2>Rules</h2><li>c</li>")
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    out = {r["heading"]: r for r in corpus.sectionise(pages).collect()}
    assert set(out) == {"Rules", "Empty"}
    assert out["Rules"]["bullets"] == "c" and out["Rules"]["n_bullets"] == 1
    assert out["Empty"]["n_bullets"] == 0


def test_pack_documents(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id int, text string")
    assert corpus.group_count(docs, 10) == 5  # 10 x 2 + 10 x 3 chars
    p = corpus.pack_documents(docs, 3).collect()
    assert sum(r["n_docs"] for r in p) == 20
    with pytest.raises(ValueError):
        corpus.pack_documents(docs, 0)
    one = corpus.pack_documents(docs, 1).first()
    assert one["text"].split("\n") == [f"t{i}" for i in range(20)]


def test_user_questions(spark):
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "  "),
                                  (0, 0, "user", "first")], "conv_id long, turn long, role string, text string")
    q = corpus.user_questions(conv, limit=1).collect()
    assert [r["question"] for r in q] == ["first"] and q[0]["gold_sql"] is None
    assert corpus.user_questions(conv).count() == 2


def test_reply_status(spark):
    rows = [(1, '{"conversation_id": "c", "created_timestamp": 5000, "attachments": [{"query": {"query": "SELECT 1"}, "row_count": 3}]}'),
            (2, '{"conversation_id": "c", "attachments": [{"text": "which?"}]}'),
            (3, '{"attachments": [{"query": {"query": "a"}}, {"text": "b"}]}'),
            (4, "not json"), (5, None), (6, '{"conversation_id": "c"}'), (7, "{}"), (8, "")]
    df = spark.createDataFrame(rows, "reply_id int, reply string")
    st = {r["reply_id"]: r["status"] for r in replies.classify(df).collect()}
    assert st == {1: "ok", 2: "followup", 3: "multiple_attachments", 4: "parse_error", 5: "no_reply",
                  6: "no_attachment", 7: "no_attachment", 8: "parse_error"}
    t = {r["reply_id"]: r for r in replies.telemetry(df).collect()}
    assert t[1]["candidate_sql"] == "SELECT 1" and t[1]["row_count"] == 3
    assert t[2]["candidate_sql"] is None and t[4]["conversation_id"] is None


def test_parse_json_missing_key(spark):
    df = spark.createDataFrame([('{"ai_system_instruction": "x"}',), ('{"other": 1}',), ("oops",)], "r string")
    out = replies.parse_json(df, "r", replies.INSTRUCTION_SCHEMA).collect()
    assert out[0]["parsed"]["ai_system_instruction"] == "x" and out[0]["parse_error"] is False
    assert out[1]["parse_error"] is False and out[1]["parsed"]["ai_system_instruction"] is None
    assert out[2]["parse_error"] is True


def test_apply_model_retry_and_failure(spark):
    calls = {"n": 0}

    def flaky(s: pd.Series) -> pd.Series:
        if s.str.contains("bad").any():
            raise RuntimeError("model down")
        return s.str.upper()

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, q string").repartition(2, "id")
    out = {r["id"]: r for r in model.apply_model(df, "q", flaky, "a", attempts=2, batch_size=1).collect()}
    assert out[1]["a"] == "OK" and out[1]["error"] is None
    assert out[2]["a"] is None and "model down" in out[2]["error"]
    assert calls["n"] == 0


def test_apply_model_keeps_every_answer(spark):
    """Answers of a fresh Series, nulls in between, and one poison row in a batch."""
    def upper(s: pd.Series) -> pd.Series:
        if s.str.contains("poison").any():
            raise RuntimeError("no")
        return pd.Series([x.upper() for x in s])

    rows = [(i, None if i % 7 == 3 else "poison" if i == 10 else f"q{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, q string").coalesce(1)
    for size in (2, None):
        out = {r["id"]: r for r in model.apply_model(df, "q", upper, "a", attempts=1, batch_size=size).collect()}
        for i, q in rows:
            assert out[i]["a"] == (None if q in (None, "poison") else q.upper())
            assert (out[i]["error"] is not None) == (q == "poison")
    short = model.apply_model(df.filter("id < 2"), "q", lambda s: ["one"] if len(s) > 1 else ["x", "y"], "a", attempts=1).collect()
    assert all(r["a"] is None and "answers for" in r["error"] for r in short)


def test_apply_model_attempts():
    calls = []

    def fails(s):
        calls.append(len(s))
        raise RuntimeError("no")

    assert model.call_rows(fails, pd.Series(["a"]), 3, 0.0) == [(None, "RuntimeError: no")] and len(calls) == 3


def test_answer_followups(spark):
    evals = spark.createDataFrame([(1, "q", "SELECT 1")], "eval_id int, original_question string, gold_sql string")
    reps = spark.createDataFrame([(7, "q", "followup", None, "which?"), (8, "q", "ok", "SELECT 2", None)],
                                 "reply_id int, question string, status string, candidate_sql string, followup string")
    seen = model.answer_followups(reps, evals, lambda s: "[" + s + "]", lambda s: "SQL of " + s)
    out = {r["reply_id"]: r for r in seen.collect()}
    assert out[7]["status"] == "answered"
    assert out[7]["candidate_sql"] == "SQL of q\n[Question: q\nThe service asks: which?\nReference SQL: SELECT 1]"
    assert out[8]["candidate_sql"] == "SELECT 2"


def test_plans_are_built_without_jobs(spark):
    reps = spark.createDataFrame([(7, "q", "followup", None, "w")],
                                 "reply_id int, question string, status string, candidate_sql string, followup string")
    evals = spark.createDataFrame([(1, "q", "SELECT 1")], "eval_id int, original_question string, gold_sql string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        model.answer_followups(reps, evals, lambda s: s, lambda s: s)
        replies.telemetry(spark.createDataFrame([("{}",)], "reply string"))
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("http://x/a?m=1&m=22", "a.b.c", "avg/x/mean")], "u string, n string, m string")
    r = df.select(message_id(F.col("u")).alias("m"), is_three_part_name(F.col("n")).alias("t"),
                  metric_rename(F.col("m")).alias("r"),
                  interleave(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(9), F.lit(8))).alias("i")).first()
    assert r["m"] == "22" and r["t"] is True and r["r"] == "avg_avg_x" and r["i"] == [1, 9, 2, 8]
    assert df.select(message_id(F.lit("plain")).alias("m")).first()["m"] == "plain"
    with pytest.raises(KeyError):
        render("{missing}", {})


def test_sectionise_links_lines_and_markdown(spark):
    html = "<link rel=x><H2 class=a>Rules</H2><ul><li>first\nline</li>\n<LI>two</LI></ul><listing>x</listing>"
    one = corpus.sectionise(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(r["heading"], r["bullets"]) for r in one] == [("Rules", "first line\ntwo")]
    text = "- lost\n# One:\n- a\n* b\n 2. c\nplain\n## Two\n#no heading"
    two = corpus.sectionise(spark.createDataFrame([(1, text)], "page_id int, html string"), form="lines").collect()
    assert sorted((r["heading"], r["bullets"]) for r in two) == [("One", "a\nb\nc"), ("Two", "")]


def test_render_leaves_braces_in_values(spark):
    df = spark.createDataFrame([("say {gold}", "SELECT 1")], "q string, g string")
    out = df.select(render("{question}|{gold}|{question}", {"question": F.col("q"), "gold": F.col("g")}).alias("x"))
    assert out.first()["x"] == "say {gold}|SELECT 1|say {gold}"
