"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads whole driver tables (or tables Spark derives from them by
the rules in ``standins``).  Float outputs that are sums or means are
rounded to ``R`` decimals so that two engines' summation orders agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlscore.operators import corpus, cycles, equivalence, evalset, evaluate, judge, keywords, metrics, model, replies, rules, runs
from sqlscore.operators.parallel import partitions, spread
from sqlscore.plans import pairs as P
from sqlscore.plans import standins as S
from sqlscore.session import checkpoint_root, scratch_path, stash
from sqlscore.sources.tables import load, register_views
from sqlscore.streaming import logs as L
from sqlscore.streaming import means as SM

R = 9  # decimals of rounded float outputs: past every exact tie, far above float noise

QUALITY_WEIGHTS = {"purchase/mean": 0.5, "click/mean": 0.3, "view/mean": 0.2}
COMPOSITE_CORE = {"purchase/mean": 0.5, "click/mean": 0.25, "view/mean": 0.25}
INSTRUCTION = "Answer with one Spark SQL query.\nUse only the listed tables."
REPLACE_TERMS = [("orders", "orders_v2"), ("o_custkey", "o_customer_key")]
REQUIRED_DIMS = ["o_custkey", "o_orderpriority"]
PROMPT = "Question: {question}\nReference SQL: {gold_sql}\nIssues: {issues}"
PACK_TARGET_CHARS = 1_000_000
GATE = 15.0
TEXT_PART_CHARS = 2000  # length at which a joined feedback text goes on in a new part
UNANSWERABLE = "unanswerable"


def stub_model(q: pd.Series) -> pd.Series:
    """Deterministic stand-in for a text-to-SQL model (tests and checks): fails on
    any batch with an unanswerable question, and answers with an index of its own."""
    if (q == UNANSWERABLE).any():
        raise ValueError("cannot answer")
    return pd.Series(["SELECT " + str(len(x)) + " AS n" for x in q])


def stub_helper(q: pd.Series) -> pd.Series:
    """Deterministic stand-in for the helper that answers follow-up questions."""
    return pd.Series(["answer " + str(len(x)) for x in q])


# ---------------------------------------------------------------- results

def q_result_equiv(spark: SparkSession, sf: str) -> DataFrame:
    register_views(spark, sf, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"])
    return equivalence.verdicts(spark, P.pairs())


def q_result_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    register_views(spark, sf, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"])
    return equivalence.fingerprint_verdicts(spark, P.pairs())


def q_result_equiv_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """C3 with row order: places by the keys of each query's own ORDER BY."""
    register_views(spark, sf, ["nation", "customer", "supplier", "orders"])
    return equivalence.verdicts(spark, P.ordered_pairs(), mode="ordered")


def q_result_confirm_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows of buckets with unequal fingerprints go through the exact diff."""
    register_views(spark, sf, ["lineitem"])
    d = equivalence.confirm_diff(equivalence.run_query(spark, P.ALTERED_GOLD), equivalence.run_query(spark, P.ALTERED_CAND))
    return d.select("_c0", "_c1", "_c2", "_c3", "side", F.abs("n").alias("mult"))


def _diff_pair(spark: SparkSession, sf: str):
    register_views(spark, sf, ["lineitem"])
    return equivalence.align(equivalence.run_query(spark, P.DIFF_GOLD), equivalence.run_query(spark, P.DIFF_CAND))


def q_result_diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = equivalence.signed_diff(*_diff_pair(spark, sf))
    return d.select("_c0", "_c1", "_c2", "side", F.abs("n").alias("mult"))


def q_result_diff_sample(spark: SparkSession, sf: str) -> DataFrame:
    g, c = _diff_pair(spark, sf)
    d = equivalence.diff_sample(g, c, k=5)
    return d.select("_c0", "_c1", "_c2", "side", F.abs("n").alias("mult"))


# ---------------------------------------------------------------- eval set

def q_eval_set(spark, sf):
    return S.eval_set(spark, sf)


def q_eval_replicate(spark, sf):
    return evalset.replicate(S.eval_set(spark, sf).select("eval_id", "question"), 3)


def q_eval_prefix(spark, sf):
    return evalset.prefix_questions(S.eval_set(spark, sf), INSTRUCTION).select("eval_id", "question", "original_question")


def q_eval_replace_terms(spark, sf):
    return evalset.replace_terms(S.eval_set(spark, sf), REPLACE_TERMS).select("eval_id", "gold_sql", "updated_gold_sql")


def q_eval_split(spark, sf):
    return evalset.split(S.eval_set(spark, sf), 0.30).select("eval_id", "split")


def _labelled(spark, sf):
    """Rows with a hot label (a third of all) and 211 small ones."""
    key = F.col("eval_id")
    return S.eval_set(spark, sf).select("eval_id", F.when(key % 3 == 0, "hot").otherwise(
        F.concat(F.lit("l"), (key % 211).cast("string"))).alias("label"))


def q_eval_split_stratified(spark, sf):
    return evalset.split_stratified(_labelled(spark, sf), "label", 0.30)


def q_eval_null_issues(spark, sf):
    """Rows without issues get a typed null column; the set is materialised and counted."""
    kept, n = evalset.materialise(evalset.with_null_issues(S.eval_set(spark, sf).select("eval_id", "question")))
    return kept.select("eval_id", "question", "issues", F.lit(n).cast("long").alias("n_rows"))


def q_eval_questions(spark, sf):
    return evalset.questions(S.eval_set(spark, sf))


def q_eval_request(spark, sf):
    r = evalset.requests(S.eval_set(spark, sf))
    return r.select("eval_id", F.col("inputs.inputs.question").alias("question"),
                    F.size("expectations.guidelines").alias("n_guidelines"),
                    F.get("expectations.guidelines", 0).alias("guideline"),
                    F.col("expectations.expected_response").alias("expected_response"))


def q_eval_prepare(spark, sf):
    return evalset.prepare(S.eval_set(spark, sf).select("eval_id", "question"), 500, 2)


GUIDELINES = {
    "count_joins": "The candidate query uses the same number of joins as the expected query.",
    "has_select": "The expected response contains a SELECT statement.",
    "dimension_ambiguity": "The candidate query reads the same tables as the expected query.",
}


def q_eval_batches(spark, sf):
    return evalset.batches(S.eval_set(spark, sf).select("eval_id"), 64)


def q_guideline_requests(spark, sf):
    e = S.candidates(spark, sf).select("eval_id", "question", "candidate_sql")
    return evalset.guideline_requests(e, GUIDELINES).select(
        "eval_id", "guideline", F.concat_ws("\n", "guideline_text", "question", "candidate_sql").alias("request"))


def q_cycle_numbering(spark, sf):
    r = S.runs(spark, sf).filter(F.col("mode") == "cycle").withColumn("started_at", F.substring("run_name", 7, 8))
    return cycles.number_cycles(r, run="root_run_id", started="started_at", skew_safe=True).select(
        "run_id", "root_run_id", "cycle")


def q_gold_lookup(spark, sf):
    c = S.candidates(spark, sf).select("eval_id", "question")
    return evalset.gold_lookup(c, S.eval_set(spark, sf)).select("eval_id", "question", "gold_eval_id", "gold_sql")


def q_user_questions(spark, sf):
    return corpus.user_questions(load(spark, sf, "conversations"))


# ---------------------------------------------------------------- keywords / rules

def _cands(spark, sf):
    """Candidates with each SQL text tokenized once for all scorers in the plan."""
    return rules.tokenize(S.candidates(spark, sf), "gold_sql", "candidate_sql")


def _cands_whole(spark, sf):
    """The same with the tokens of all statements, which rules are about."""
    return rules.tokenize(S.candidates(spark, sf), "gold_sql", "candidate_sql", only_first_statement=False)


def q_keyword_hist(spark, sf):
    return keywords.keyword_histogram(_cands(spark, sf), "eval_id", {"gold": "gold_sql", "candidate": "candidate_sql"})


def q_keyword_diff(spark, sf):
    return keywords.keyword_diff(_cands(spark, sf), "eval_id")


def q_keyword_verdict(spark, sf):
    return keywords.keyword_verdict(_cands(spark, sf), "eval_id").drop("metadata")


def q_keyword_metadata(spark, sf):
    """The verdict's metadata map as long rows (only texts that differ have one)."""
    v = keywords.keyword_verdict(_cands(spark, sf), "eval_id")
    return (v.select("eval_id", F.explode_outer("metadata").alias("keyword", "diff"))
            .filter(F.col("keyword").isNotNull()))


def q_rule_count_joins(spark, sf):
    return rules.rule_count_joins(_cands_whole(spark, sf)).select("eval_id", "gold_joins", "cand_joins", "value")


def q_rule_has_select(spark, sf):
    return rules.rule_has_select(_cands_whole(spark, sf)).select("eval_id", "gold_has_select", "cand_has_select", "value")


def q_rule_tables(spark, sf):
    return rules.rule_tables(S.candidates(spark, sf)).select("eval_id", "missing_tables", "extra_tables", "value")


NESTED_TABLES = [  # FROM inside calls, quoted names with blanks, lists after sub-queries, brackets around joins
    "SELECT extract(year FROM cast(o_orderdate AS date)), trim(both 'x' FROM upper(c)) FROM orders WHERE o_orderkey = {k}",
    "SELECT substring(c_name FROM position('a' IN c_name)) FROM (SELECT * FROM customer) t, orders o WHERE o_orderkey = {k}",
    "SELECT * FROM `my db`.`my table` m JOIN orders ON m.a IS DISTINCT FROM orders.b AND o_orderkey = {k}",
    "SELECT array(SELECT max(n_name) FROM nation) FROM (customer c JOIN orders o ON c.c_custkey = o.o_custkey) WHERE o_orderkey = {k}",
    "WITH y (a, b) AS (SELECT overlay(x PLACING '_' FROM length(trim(leading ' ' FROM x))), 1 FROM orders) SELECT * FROM y, explode(array({k}))",
    "SELECT /* FROM a /* JOIN b */ , c */ n_name FROM nation, LATERAL (SELECT {k} FROM orders) l",
]
NESTED_COMMENTS = [
    "select /* a /* join */ where */ {k} from t", "select /* ' /* \" */ */ {k} from t where x -- /* /* group by",
    "select '/* /*' , {k} from t where `a /* b` and /**/ /* /* or */ not */ 1",
]


def _texts(spark, sf, templates):
    key = F.col("o_orderkey").cast("string")
    made = F.array(*(F.replace(F.lit(t), F.lit("{k}"), key) for t in templates))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("eval_id"), F.get(
        made, F.pmod("o_orderkey", F.lit(len(templates))).cast("int")).alias("sql"))


def q_rule_tables_nested(spark, sf):
    return _texts(spark, sf, NESTED_TABLES).select("eval_id", F.array_join(rules.tables_used(F.col("sql")), ",").alias("tables"))


def q_keyword_nested(spark, sf):
    return keywords.keyword_histogram(_texts(spark, sf, NESTED_COMMENTS), "eval_id", {"gold": "sql"}).drop("side")


def q_rule_required_dims(spark, sf):
    return rules.rule_required_dims(_cands(spark, sf), REQUIRED_DIMS).select("eval_id", "missing_dims", "value")


def q_rule_limit_without_order(spark, sf):
    r = rules.rule_limit_without_order(_cands_whole(spark, sf))
    return r.select("eval_id", "gold_sql_unordered_limit", "candidate_sql_unordered_limit")


SCORERS = ["sql_clauses_distribution_equivalence", "count_joins", "has_select", "dimension_ambiguity",
           "required_dims"]


def q_evaluate_all(spark, sf):
    fb = evaluate.evaluate(S.candidates(spark, sf, partitions(spark)), SCORERS, required_dims=REQUIRED_DIMS)
    m = metrics.metric_means(fb.withColumn("run_id", F.lit("r0")), keys=("run_id",))
    return m.select("scorer", "metric_name", F.round("mean", R).alias("mean"), "n")


def _result_rows(spark, sf, partitions=None):
    """The executed pairs dealt out over all orders, so each text serves many rows.  Rows are
    spread over ``partitions`` by their keys, before they have texts."""
    register_views(spark, sf, ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"])
    names = sorted(P.PAIRS)
    texts = F.array(*(F.struct(F.lit(n).alias("pair"), F.lit(P.PAIRS[n][0]).alias("gold_sql"),
                               F.lit(P.PAIRS[n][1]).alias("candidate_sql")) for n in names))
    return (spread(load(spark, sf, "orders").select("o_orderkey"), partitions).select(F.col("o_orderkey").alias("eval_id"), F.get(
        texts, F.pmod("o_orderkey", F.lit(len(names))).cast("int")).alias("t")).select("eval_id", "t.*"))


def q_evaluate_results(spark, sf):
    """J4 with the executed-result scorer: verdict, rationale and number of sample rows of every row."""
    v = evaluate.score_results(spark, _result_rows(spark, sf), group_size=9)
    return v.select("eval_id", "pair", "value", "only_in_gold", "only_in_candidate", "error",
                    F.size("sample_gold").alias("n_sample_gold"), F.size("sample_candidate").alias("n_sample_candidate"),
                    "rationale")


def q_evaluate_many(spark, sf):
    """J4 with as many distinct pairs as nations times candidate texts, in groups run at once."""
    register_views(spark, sf, ["customer", "supplier"])
    n = F.col("n_nationkey").cast("string")
    fill = lambda t: F.replace(F.lit(t), F.lit("{nation}"), n)
    rows = load(spark, sf, "nation").select("n_nationkey", fill(P.NATION_GOLD).alias("gold_sql"), F.posexplode(
        F.array(*map(fill, P.NATION_CANDS))).alias("variant", "candidate_sql"))
    v = evaluate.score_results(spark, rows, group_size=20, views={"customer", "supplier"})
    return v.select("n_nationkey", "variant", "value", "gold_rows", "cand_rows", "only_in_gold", "only_in_candidate", "error",
                    F.size("sample_gold").alias("n_sample_gold"), F.size("sample_candidate").alias("n_sample_candidate"))


def stub_judge(q: pd.Series) -> pd.Series:
    """Deterministic stand-in for a judging model: some replies are no JSON, some out of range, some lack a score."""
    def reply(x: str) -> str:
        n = len(x)
        if n % 7 == 0:
            return "no comment"
        if n % 7 == 1:
            return '{"score": 1.5}'
        value = '"value": "' + ("yes" if n % 2 else "no") + '"'
        return "{" + value + ("" if n % 7 == 2 else f', "score": {n % 5 / 4}') + f', "rationale": "length {n}"' + "}"
    return pd.Series([reply(x) for x in q])


def q_evaluate_judged(spark, sf):
    """Lexical scorers, executed results and judged guidelines in one feedback
    table; per row the composite score and the joined feedback."""
    rows = _result_rows(spark, sf, partitions(spark))
    lexical = evaluate.evaluate(rows, ["count_joins", "sql_clauses_distribution_equivalence"])
    executed = evaluate.evaluate(rows, ["sql_results_equivalence"], group_size=9)
    judged = judge.judge(rows, {f"judged_{k}": v for k, v in GUIDELINES.items()}, stub_judge, store=scratch_path(spark, "judgements"), portions=1)
    scored = judge.row_scores(metrics.union_feedback(lexical, executed, judged))
    return scored.select("eval_id", "feedback", F.col("n_items").alias("n_feedback"), F.coalesce("n_metrics", F.lit(0)).alias("n_metrics"),
                         F.round("composite", R).alias("composite"))


def q_row_context(spark, sf):
    """The optimiser's view: question, candidate and list of feedback for each row."""
    c = S.candidates(spark, sf).select("eval_id", "question", "gold_sql", "candidate_sql")
    view = judge.row_context(c, evaluate.evaluate(c, ["count_joins", "has_select"]))
    return view.select("eval_id", "question", F.size("assessments").alias("n"), F.array_join(
        F.transform("assessments", lambda a: a["scorer"]), ",").alias("scorers"),
        F.size(F.filter("assessments", lambda a: a["value"])).alias("n_true"))


# ---------------------------------------------------------------- metrics

def q_metric_means(spark, sf):
    m = metrics.metric_means(S.feedback_events(spark, sf))
    return m.select("run_id", "cycle", "scorer", "metric_name", F.round("mean", R).alias("mean"), "n")


def q_label_means(spark, sf):
    lab = load(spark, sf, "labels").unpivot("doc_id", ["quality", "toxic"], "scorer", "value")
    docs = load(spark, sf, "documents").select("doc_id", F.col("source").alias("run_id"))
    m = metrics.metric_means(lab.join(docs, "doc_id"), keys=("run_id",))
    return m.select("run_id", "scorer", "metric_name", F.round("mean", R).alias("mean"), "n")


def _quality(spark, sf):
    return metrics.quality_score(S.cycle_metrics(spark, sf), QUALITY_WEIGHTS)


def q_quality_score(spark, sf):
    return _quality(spark, sf).select("run_id", "cycle", F.round("quality", R).alias("quality"), "n_metrics")


def q_composite_score(spark, sf):
    c = metrics.composite_score(S.cycle_metrics(spark, sf), COMPOSITE_CORE)
    return c.select("run_id", "cycle", "n_metrics", "n_custom", F.round("core_score", R).alias("core_score"),
                    F.round("custom_score", R).alias("custom_score"), F.round("composite", R).alias("composite"))


def q_feedback_text(spark, sf):
    return metrics.ordered_text(load(spark, sf, "conversations"), ["conv_id", "role"], "turn", "text")


def q_feedback_text_parts(spark, sf):
    conv = load(spark, sf, "conversations")
    return metrics.ordered_text(conv, ["conv_id", "role"], "turn", "text", max_chars=TEXT_PART_CHARS)


def _threads(spark, sf):
    """The texts of one role in a conversation are one thread."""
    thread = F.concat_ws("/", F.col("conv_id").cast("string"), "role")
    return load(spark, sf, "conversations").select(thread.alias("thread"), "turn", "text")


def q_quality_gate(spark, sf):
    g = metrics.quality_gate(_quality(spark, sf), GATE)
    return g.select("run_id", "cycle", F.round("quality", R).alias("quality"), "passes")


def q_runs_vs_baseline(spark, sf):
    m = S.cycle_metrics(spark, sf)
    base = m.groupBy("run_id", "metric").agg(F.min_by("value", "cycle").alias("value"))
    v = metrics.versus_baseline(m, base)
    return v.select("run_id", "cycle", "metric", F.round("value", R).alias("value"),
                    F.round("baseline", R).alias("baseline"), F.round("delta", R).alias("delta"))


# ---------------------------------------------------------------- cycles

def q_cycle_lookback(spark, sf):
    lb = cycles.lookback(_quality(spark, sf), 3, value="quality", skew_safe=True)
    return lb.select("run_id", "cycle", F.round("quality", R).alias("quality"),
                     F.array_join(F.transform("context", lambda x: x["cycle"].cast("string")), ",").alias("context_cycles"),
                     F.round("context_mean", R).alias("context_mean"))


def q_cycle_lookback_texts(spark, sf):
    t = _threads(spark, sf).withColumn("chars", F.length("text"))
    lb = cycles.lookback(t, 3, value="chars", run="thread", cycle="turn", skew_safe=True, carry=("text",))
    return lb.select("thread", "turn", F.array_join(F.transform("context", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
                     .alias("context"), F.round("context_mean", R).alias("context_mean"))


def q_cycle_prev_curr(spark, sf):
    pc = cycles.previous_current(_quality(spark, sf), ["quality"], skew_safe=True)
    return pc.select("run_id", "cycle", F.round("quality", R).alias("quality"),
                     F.round("prev_quality", R).alias("prev_quality"))


def q_cycle_drift(spark, sf):
    d = cycles.drift(S.cycle_metrics(spark, sf), skew_safe=True)
    return d.select("run_id", "cycle", "metric", F.round("value", R).alias("value"),
                    F.round("prev_value", R).alias("prev_value"), F.round("diff", R).alias("diff"),
                    F.round("rel_change", R).alias("rel_change"))


def q_prompt_token_diff(spark, sf):
    return cycles.token_diff(_threads(spark, sf), "thread", "turn", "text")


def q_latest_instruction(spark, sf):
    return cycles.latest(_threads(spark, sf), "text", run="thread", cycle="turn")


def q_best_cycle(spark, sf):
    return cycles.best_per_run(_quality(spark, sf), "quality").select(
        "run_id", "cycle", F.round("quality", R).alias("quality"))


def q_best_cycles_top10(spark, sf):
    return cycles.best_overall(_quality(spark, sf), "quality", 10).select(
        "run_id", "cycle", F.round("quality", R).alias("quality"))


# ---------------------------------------------------------------- runs

def q_runs_parent_name(spark, sf):
    return runs.with_parent_name(S.runs(spark, sf)).select("run_id", "parent_run_id", "run_name", "parent_run_name")


def q_runs_under_roots(spark, sf):
    ev = load(spark, sf, "events")
    roots = ev.filter(F.col("event_type") == "error").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("root_run_id"))
    return runs.runs_under(S.runs(spark, sf), roots).select("run_id", "root_run_id", "mode")


def q_runs_clean_columns(spark, sf):
    r = S.runs(spark, sf).select(F.col("run_id").alias("run id"), F.col("run_name").alias("run name"),
                                 F.col("mode").alias("run mode"))
    r = runs.underscore_columns(r)
    return runs.add_column(r, "name_length", F.length("run_name"))


# ---------------------------------------------------------------- corpus / replies / model

def q_pack_documents(spark, sf):
    docs = load(spark, sf, "documents")
    n = corpus.group_count(docs, PACK_TARGET_CHARS, length_col="n_chars")
    return corpus.pack_documents(docs, n, group_expr=F.pmod(F.col("doc_id"), F.lit(n)))


def q_sectionise(spark, sf):
    return corpus.sectionise(load(spark, sf, "pages"))


def q_url_message_id(spark, sf):
    return corpus.url_message_ids(load(spark, sf, "pages"))


def q_prompt_render(spark, sf):
    from sqlscore.functions.sqltext import render
    e = S.eval_set(spark, sf)
    return e.select("eval_id", render(PROMPT, {c: F.col(c) for c in ("question", "gold_sql", "issues")}).alias("prompt"))


def q_reply_parse(spark, sf):
    from pyspark.sql import types as T
    schema = T.StructType(replies.INSTRUCTION_SCHEMA.fields + [T.StructField("k", T.LongType())])
    p = replies.parse_json(load(spark, sf, "events"), "props", schema, "p")
    return p.select("event_id", F.col("p.k").alias("k"), F.col("p.ai_system_instruction").alias("instruction"),
                    "parse_error")


def q_reply_status(spark, sf):
    return replies.classify(S.replies(spark, sf)).select("reply_id", "status")


def q_telemetry_flatten(spark, sf):
    t = replies.telemetry(S.replies(spark, sf))
    return t.select("reply_id", "status", "conversation_id", "candidate_sql", "row_count",
                    F.unix_timestamp("created_ts").alias("created_s"))


def q_model_apply(spark, sf):
    """Some questions are missing and some make the model fail; neither touches its neighbours."""
    q = (F.when(F.col("eval_id") % 53 == 0, F.lit(None).cast("string"))
         .when(F.col("eval_id") % 101 == 0, F.lit(UNANSWERABLE)).otherwise(F.col("question")))
    e = S.eval_set(spark, sf).select("eval_id", q.alias("question"))
    return model.apply_model(e, "question", stub_model, "output", attempts=1, batch_size=256).select(
        "eval_id", "output", "error")


def q_model_ai_query(spark, sf):
    e = S.eval_set(spark, sf).select("eval_id", "question")
    return model.ai_query(e, "question", "Answer briefly: ", stub_model, "answer").select("eval_id", "answer")


def q_followup_answers(spark, sf):
    t = replies.telemetry(S.replies(spark, sf)).select("reply_id", "question", "status", "candidate_sql", "followup")
    a = model.answer_followups(t, S.eval_set(spark, sf), stub_helper, stub_model)
    return a.select("reply_id", "status", "candidate_sql")


def _traces(spark, sf):
    """Labels as assessments of traces: two a document, none where the quality is 0."""
    one = lambda name: F.struct(F.lit(name).alias("scorer"), F.col(name).alias("value"))
    some = F.when(F.col("quality") == 0, F.array().cast("array<struct<scorer:string,value:int>>")).otherwise(
        F.array(one("quality"), one("toxic")))
    return load(spark, sf, "labels").select(F.col("doc_id").alias("trace_id"), some.alias("assessments"))


def q_trace_assessments(spark, sf):
    return metrics.flatten_assessments(_traces(spark, sf))


def q_run_feedback(spark, sf):
    fb = S.feedback_events(spark, sf).select("run_id", "item_id", "scorer", "value")
    ids = load(spark, sf, "events").filter(F.col("event_type") == "error").select("user_id").distinct()
    return metrics.run_feedback(fb, ids)


# ---------------------------------------------------------------- logs / streams

def _log_rows(spark, sf):
    ev = load(spark, sf, "events")
    level = (F.when(F.col("value") < 50, F.lit("DEBUG")).when(F.col("value") < 150, F.lit("INFO"))
             .when(F.col("value") < 300, F.lit("WARNING")).otherwise(F.lit("ERROR")))
    return L.log_rows(ev, "ts", "event_type", level, F.concat(F.lit("event "), F.col("event_id").cast("string")))


def q_log_levels(spark, sf):
    return L.log_levels(_log_rows(spark, sf))


def _event_stream(spark, sf):
    ev = load(spark, sf, "events")
    # file source over the table's folder; the glob keeps the other tables out
    src = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(sf.rstrip("/"))
    # watermarks need TIMESTAMP; the wall-clock values are read as UTC (see _utc)
    return src.withColumn("ts", F.col("ts").cast("timestamp"))


class _utc:
    """Run a stream with the session time zone pinned to UTC (restored after):
    the NTZ -> TIMESTAMP cast and day windows then follow wall-clock days
    whatever zone the caller's session uses."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get("spark.sql.session.timeZone")
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __exit__(self, *exc):
        self.spark.conf.set("spark.sql.session.timeZone", self.old)


def q_stream_dedup(spark, sf):
    checkpoint_root(spark)
    with _utc(spark):
        # every event arrives twice
        twice = _event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        s = SM.dedup_stream(twice, "event_id", "ts", "1 hour").select(
            "event_id", "user_id", "event_type")
        return SM.run_to_parquet(spark, s, scratch_path(spark, "dedup-out"), scratch_path(spark, "dedup-ckpt"))


ARRIVALS, ARRIVAL_DAYS = 5, 6


def q_stream_late_means(spark, sf):
    """L2 with late rows: events arrive in five parts, with a stop and a restart after each; some of the
    first four come with the last, long after the watermark has passed them."""
    checkpoint_root(spark)
    with _utc(spark):
        ev = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        step = F.least(F.floor(F.date_diff("ts", F.lit("2024-01-01")) / ARRIVAL_DAYS), F.lit(ARRIVALS - 1))
        step = F.when(F.col("event_id") % 40 == 7, F.lit(ARRIVALS - 1)).otherwise(step)
        day = F.date_format(F.col("window_start"), "yyyy-MM-dd").alias("day")
        out = SM.replay(spark, [ev.filter(step == i) for i in range(ARRIVALS)], scratch_path(spark, "late-in"),
                        scratch_path(spark, "late-out"), scratch_path(spark, "late-ckpt"),
                        lambda s: SM.running_means(s, "ts", "event_type", "value", "1 day", "1 hour").select(day, "event_type", "mean", "n"))
        came = ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("came"))
        late = out.join(came, ["day", "event_type"])
        return stash(late.select("day", "event_type", F.round("mean", R).alias("mean"), "n", (F.col("came") - F.col("n")).alias("n_late")), "late-means")


def q_stream_scorer_means(spark, sf):
    checkpoint_root(spark)
    with _utc(spark):
        s = SM.running_means(_event_stream(spark, sf), "ts", "event_type", "value", "1 day", "1 hour").select(
            F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type",
            F.round("mean", R).alias("mean"), "n")
        return SM.run_to_parquet(spark, s, scratch_path(spark, "means-out"), scratch_path(spark, "means-ckpt"))


def q_model_resume(spark, sf):
    """A run that stops after half of its portions and another that asks what is left;
    ``n_calls`` counts the recorded calls of a row's prompt."""
    rows = S.eval_set(spark, sf).select("eval_id", "question")
    store = scratch_path(spark, "answers")
    model.ask_missing(rows, "question", stub_model, store, "stub", portions=4, max_portions=2)
    out = model.ask_stored(rows, "question", stub_model, store, "stub", "answer", portions=4)
    calls = model.stored_answers(spark, store).groupBy("digest").agg(F.count(F.lit(1)).alias("n_calls"))
    return (out.withColumn("digest", model.prompt_digest(F.col("question"), "stub")).join(calls, "digest", "left")
            .select("eval_id", "question", "answer", "error", "n_calls"))


QUERIES = {
    "result_equiv": q_result_equiv,
    "result_fingerprint": q_result_fingerprint,
    "result_equiv_ordered": q_result_equiv_ordered,
    "result_confirm_diff": q_result_confirm_diff,
    "result_diff_rows": q_result_diff_rows,
    "result_diff_sample": q_result_diff_sample,
    "eval_set": q_eval_set,
    "eval_replicate": q_eval_replicate,
    "eval_prefix": q_eval_prefix,
    "eval_replace_terms": q_eval_replace_terms,
    "eval_split": q_eval_split,
    "eval_questions": q_eval_questions,
    "eval_request": q_eval_request,
    "eval_prepare": q_eval_prepare,
    "eval_batches": q_eval_batches,
    "guideline_requests": q_guideline_requests,
    "gold_lookup": q_gold_lookup,
    "user_questions": q_user_questions,
    "keyword_hist": q_keyword_hist,
    "keyword_diff": q_keyword_diff,
    "keyword_verdict": q_keyword_verdict,
    "keyword_metadata": q_keyword_metadata,
    "rule_count_joins": q_rule_count_joins,
    "rule_has_select": q_rule_has_select,
    "rule_tables": q_rule_tables,
    "rule_required_dims": q_rule_required_dims,
    "rule_tables_nested": q_rule_tables_nested,
    "keyword_nested": q_keyword_nested,
    "rule_limit_without_order": q_rule_limit_without_order,
    "evaluate_all": q_evaluate_all,
    "evaluate_results": q_evaluate_results,
    "evaluate_many": q_evaluate_many,
    "metric_means": q_metric_means,
    "label_means": q_label_means,
    "quality_score": q_quality_score,
    "composite_score": q_composite_score,
    "feedback_text": q_feedback_text,
    "feedback_text_parts": q_feedback_text_parts,
    "quality_gate": q_quality_gate,
    "runs_vs_baseline": q_runs_vs_baseline,
    "cycle_lookback": q_cycle_lookback,
    "cycle_lookback_texts": q_cycle_lookback_texts,
    "cycle_prev_curr": q_cycle_prev_curr,
    "cycle_drift": q_cycle_drift,
    "prompt_token_diff": q_prompt_token_diff,
    "latest_instruction": q_latest_instruction,
    "best_cycle": q_best_cycle,
    "cycle_numbering": q_cycle_numbering,
    "best_cycles_top10": q_best_cycles_top10,
    "runs_parent_name": q_runs_parent_name,
    "runs_under_roots": q_runs_under_roots,
    "runs_clean_columns": q_runs_clean_columns,
    "pack_documents": q_pack_documents,
    "sectionise": q_sectionise,
    "url_message_id": q_url_message_id,
    "prompt_render": q_prompt_render,
    "reply_parse": q_reply_parse,
    "reply_status": q_reply_status,
    "telemetry_flatten": q_telemetry_flatten,
    "model_apply": q_model_apply,
    "model_ai_query": q_model_ai_query,
    "followup_answers": q_followup_answers,
    "trace_assessments": q_trace_assessments,
    "run_feedback": q_run_feedback,
    "log_levels": q_log_levels,
    "stream_dedup": q_stream_dedup,
    "stream_scorer_means": q_stream_scorer_means,
    "stream_late_means": q_stream_late_means,
    "eval_split_stratified": q_eval_split_stratified,
    "eval_null_issues": q_eval_null_issues,
    "evaluate_judged": q_evaluate_judged,
    "row_context": q_row_context,
    "model_resume": q_model_resume,
}
