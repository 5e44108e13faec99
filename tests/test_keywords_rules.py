from pyspark.sql import functions as F

from sqlscore.functions.sqltext import all_zero, keyword_count_map, map_difference, sql_keywords, sql_tokens
from sqlscore.operators import keywords, rules


def kw(spark, text):
    return spark.createDataFrame([(text,)], "s string").select(sql_keywords(F.col("s")).alias("k")).first()["k"]


def test_literals_comments_quoted_names_ignored(spark):
    assert kw(spark, "SELECT 'FROM x WHERE' AS \"GROUP BY\" -- ORDER BY\nFROM t /* JOIN */") == ["SELECT", "AS", "FROM"]
    assert kw(spark, "SELECT `select` FROM t") == ["SELECT", "FROM"]


def test_multiword_with_line_breaks(spark):
    assert kw(spark, "SELECT a FROM t GROUP\n   BY a ORDER   BY a") == ["SELECT", "FROM", "GROUP BY", "ORDER BY"]
    assert kw(spark, "SELECT * FROM a LEFT OUTER JOIN b ON x GROUP BY GROUP BY") == \
        ["SELECT", "FROM", "LEFT OUTER JOIN", "ON", "GROUP BY", "GROUP BY"]


def test_nested_subquery_and_first_statement(spark):
    assert kw(spark, "SELECT * FROM (SELECT a FROM t WHERE a IN (SELECT b FROM u)); DROP TABLE t") == \
        ["SELECT", "FROM", "SELECT", "FROM", "WHERE", "IN", "SELECT", "FROM"]


def test_empty_and_null(spark):
    assert kw(spark, "") == []
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(sql_tokens(F.col("s")).alias("t")).first()["t"] is None


def test_keyword_diff_of_identical_text_is_zero(spark):
    df = spark.createDataFrame([(1, "SELECT a FROM t WHERE b = 1", "select a from t where b = 1")],
                               "eval_id int, gold_sql string, candidate_sql string")
    d = keywords.keyword_diff(df, "eval_id").collect()
    assert d and all(r["diff"] == 0 for r in d)
    v = keywords.keyword_verdict(df, "eval_id").first()
    assert v["value"] is True and v["metadata"] is None


def test_keyword_verdict_reports_union_of_keys(spark):
    df = spark.createDataFrame([(1, "SELECT a FROM t GROUP BY a", "SELECT a FROM t JOIN u ON x")],
                               "eval_id int, gold_sql string, candidate_sql string")
    v = keywords.keyword_verdict(df, "eval_id").first()
    assert v["value"] is False
    assert v["metadata"] == {"SELECT": 0, "FROM": 0, "GROUP BY": 1, "JOIN": -1, "ON": -1}


def test_row_form_map_difference(spark):
    df = spark.createDataFrame([("SELECT a FROM t", "SELECT a FROM t WHERE x")], "g string, c string")
    r = df.select(map_difference(keyword_count_map(F.col("g")), keyword_count_map(F.col("c"))).alias("d")).first()
    assert r["d"] == {"FROM": 0, "SELECT": 0, "WHERE": -1}
    r2 = df.select(all_zero(map_difference(keyword_count_map(F.col("g")), keyword_count_map(F.col("g")))).alias("z")).first()
    assert r2["z"] is True


def test_rules(spark):
    df = spark.createDataFrame([
        (1, "WITH c AS (SELECT * FROM orders) SELECT * FROM c JOIN customer ON 1=1",
         "SELECT * FROM orders LEFT JOIN customer ON 1=1 WHERE o_custkey = 1 AND o_orderpriority = 'x'"),
        (2, "DROP TABLE x", "SELECT 1"),
    ], "eval_id int, gold_sql string, candidate_sql string")
    j = {r["eval_id"]: r for r in rules.rule_count_joins(df).collect()}
    assert j[1]["value"] is True and j[1]["gold_joins"] == 1
    s = {r["eval_id"]: r for r in rules.rule_has_select(df).collect()}
    assert s[1]["value"] is True and s[2]["value"] is False
    t = {r["eval_id"]: r for r in rules.rule_tables(df).collect()}
    assert t[1]["value"] is True and t[1]["missing_tables"] == ""
    d = {r["eval_id"]: r for r in rules.rule_required_dims(df, ["o_custkey", "o_orderpriority"]).collect()}
    assert d[1]["value"] is True and d[2]["missing_dims"] == "o_custkey,o_orderpriority"


def test_limit_without_order(spark):
    df = spark.createDataFrame([(1, "SELECT a FROM t LIMIT 5", "SELECT a FROM t ORDER BY a LIMIT 5"),
                                (2, "SELECT a FROM t -- LIMIT 5", "SELECT a FROM t")],
                               "eval_id int, gold_sql string, candidate_sql string")
    r = {x["eval_id"]: x for x in rules.rule_limit_without_order(df).collect()}
    assert r[1]["gold_sql_unordered_limit"] is True and r[1]["candidate_sql_unordered_limit"] is False
    assert r[2]["gold_sql_unordered_limit"] is False


def test_keyword_jobs_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, "SELECT a", None)], "eval_id int, gold_sql string, candidate_sql string")
    for out in (keywords.keyword_histogram(df, "eval_id", {"gold": "gold_sql"}), keywords.keyword_diff(df, "eval_id"),
                keywords.keyword_verdict(df, "eval_id")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


REAL_SQL = [  # text, tables, joins
    ("SELECT `a` FROM `main`.`sales`.`orders` o JOIN `x` ON 1=1", ["main.sales.orders", "x"], 1),
    ("SELECT last_join FROM a, b c, d AS e WHERE x IN (1, 2)", ["a", "b", "d"], 0),
    ("SELECT EXTRACT(YEAR FROM c) FROM t WHERE a IS DISTINCT FROM b", ["t"], 0),
    ("WITH RECURSIVE r(a, b) AS (SELECT 1 FROM s), q AS (SELECT 2) SELECT * FROM r LEFT JOIN q ON 1=1", ["s"], 1),
    ("SELECT 'it\\'s FROM nowhere JOIN x' FROM t -- JOIN u\nNATURAL JOIN v", ["t", "v"], 1),
    ("SELECT 1 FROM a; SELECT 2 FROM b JOIN c", ["a", "b", "c"], 1),
]


def test_rules_on_real_sql(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(REAL_SQL)], "i int, s string")
    out = {r["i"]: r for r in df.select("i", rules.tables_used(F.col("s")).alias("t"),
                                        rules.join_count_tokens(sql_tokens(F.col("s"), False)).alias("j")).collect()}
    for i, (text, tables, joins) in enumerate(REAL_SQL):
        assert (out[i]["t"], out[i]["j"]) == (tables, joins), text


def test_quoted_dimension_is_found(spark):
    df = spark.createDataFrame([("SELECT `Region`, 'city' FROM t",)], "candidate_sql string")
    r = rules.rule_required_dims(df, ["region", "city"]).first()
    assert r["missing_dims"] == "city"


def test_long_literal_does_not_overflow(spark):
    df = spark.createDataFrame([("SELECT '" + "x\\'" * 50_000 + "' FROM t",)], "s string")
    assert df.select(rules.tables_used(F.col("s")).alias("t")).first()["t"] == ["t"]


def test_cheaper_patterns_give_the_same(spark):
    """guards and character maps give what the plain patterns give, on any text."""
    import random
    from sqlscore.functions import sqltext as X
    words = ["select", "from", "a.b", "`x y`", "`t` . `u`", "with", "c as (", ", d as\n(", "as(", "(", ")", ",", ";", "'it''s'", "--x\n", "/* /* */ */", "é", "join",
             " ", ".", "o_custkey", "\"q", "count(*)", "where", "\\'", "Ñame", "\x0b", "`"]
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    df = spark.createDataFrame([*texts, (-1, None)], "i int, s string")
    s = F.col("s")
    names = F.when(X.nests_comments(X.without_escapes(s)), X.strip_nested(X.without_escapes(s), keep_names=True)).otherwise(
        F.regexp_replace(X.without_escapes(s), f"{X._TEXT_RE}|(`[^`]*`)", "$1 "))
    dims = F.split(F.upper(F.regexp_replace(F.translate(F.regexp_replace(names, r"\s*\.\s*", "."), "`", ""), r"[^A-Za-z0-9_]+", " ")), " ")
    ctes = lambda t: F.regexp_extract_all(F.lower(t), F.lit(rules._CTE_RE), F.lit(1))
    there = F.translate(F.lower(names), rules._BLANKS, "").contains("as(")
    some = lambda a: F.array_except(F.array_distinct(a), F.array(F.lit("")))
    for r in df.select(s, names.alias("n"), X.strip_to_names(s).alias("n2"), some(dims).alias("d"), some(rules.dims_tokens(s)).alias("d2"),
                       (F.size(ctes(names)) > 0).alias("c"), there.alias("c2")).collect():
        assert r["n"] == r["n2"] and r["d"] == r["d2"], r
        assert r["c2"] or not r["c"], r


def test_texts_are_stripped_once_for_all_scorers(spark):
    """the pattern for literals and comments runs once a text for tables and dimensions."""
    from sqlscore.operators import evaluate
    df = spark.createDataFrame([(1, "select a from t", "select 'x' from t")], "eval_id int, gold_sql string, candidate_sql string")
    out = evaluate.evaluate(df, ["dimension_ambiguity", "required_dims"], required_dims=["a"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|(`[^`]*`)") == 2
