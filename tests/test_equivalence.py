import math

import pytest
from pyspark.sql import functions as F

from sqlscore.operators.equivalence import (
    Pair, UnsafeQuery, align, bucket_fingerprints, confirm_diff, dense_index, diff_sample, fingerprint, pair_verdict,
    report_pairs, results_equal, score_pairs,
    signed_diff, verdicts, wrap_query,
)
from sqlscore.session import scratch_path


def verdict(spark, g, c, **kw):
    return results_equal(g, c, **kw).first().asDict()


def test_identical_and_renamed(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert verdict(spark, a, b)["value"] is True


def test_row_order_ignored_in_bag_mode(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    b = spark.createDataFrame([(3,), (1,), (2,)], "a int")
    assert verdict(spark, a, b)["value"] is True


def test_one_duplicate_missing(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    b = spark.createDataFrame([(1,), (2,)], "a int")
    v = verdict(spark, a, b)
    assert v["value"] is False and v["only_in_gold"] == 1 and v["only_in_candidate"] == 0
    assert verdict(spark, a, b, mode="set")["value"] is True


def test_int_bigint_double_widening(spark):
    a = spark.createDataFrame([(1,)], "a int")
    b = spark.createDataFrame([(1,)], "a bigint")
    c = spark.createDataFrame([(1.0,)], "a double")
    assert verdict(spark, a, b)["value"] is True
    assert verdict(spark, a, c)["value"] is True
    assert verdict(spark, a, b, strict_types=True)["value"] is False


def test_null_vs_missing_row(spark):
    a = spark.createDataFrame([(1, None)], "a int, b string")
    b = spark.createDataFrame([], "a int, b string")
    v = verdict(spark, a, b)
    assert v["value"] is False and v["only_in_gold"] == 1
    n1 = spark.createDataFrame([(None,)], "a int")
    assert verdict(spark, n1, n1)["value"] is True


def test_nan_and_negative_zero(spark):
    a = spark.createDataFrame([(float("nan"),), (-0.0,)], "a double")
    b = spark.createDataFrame([(float("nan"),), (0.0,)], "a double")
    assert verdict(spark, a, b)["value"] is True
    fa, fb = fingerprint(a).first(), fingerprint(b).first()
    assert fa == fb


def test_map_columns(spark):
    a = spark.sql("SELECT map('a', 1, 'b', 2) AS m")
    b = spark.sql("SELECT map('b', 2, 'a', 1) AS m")
    c = spark.sql("SELECT map('a', 1) AS m")
    assert verdict(spark, a, b)["value"] is True
    assert verdict(spark, a, c)["value"] is False


def test_duplicate_column_names(spark):
    spark.createDataFrame([(1, 2)], "a int, b int").createOrReplaceTempView("t_dup")
    g = spark.sql(wrap_query("SELECT x.a, y.a FROM t_dup x JOIN t_dup y ON x.a = y.a"))
    c = spark.createDataFrame([(1, 1)], "p int, q int")
    assert verdict(spark, g, c)["value"] is True


def test_both_empty_with_different_schemas(spark):
    a = spark.createDataFrame([], "a int")
    b = spark.createDataFrame([], "x string, y string")
    assert align(a, b) is None
    assert verdict(spark, a, b)["value"] is True
    c = spark.createDataFrame([("1", "2")], "x string, y string")
    assert verdict(spark, a, c)["value"] is False


def test_error_paths(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("t_err")
    path = scratch_path(spark, "unlisted")
    spark.range(2).write.parquet(path)
    cases = {
        "null_cand": ("SELECT a FROM t_err", None, "candidate:no_query"),
        "unparsable": ("SELECT a FROM t_err", "SELEC a FRM", "candidate:not_a_query_or_unparsable"),
        "unresolved": ("SELECT a FROM t_err", "SELECT zz FROM t_err", "candidate:unresolved"),
        "drop": ("SELECT a FROM t_err", "DROP TABLE t_err", "candidate:not_a_query_or_unparsable"),
        "two_statements": ("SELECT a FROM t_err", "SELECT a FROM t_err; DROP TABLE t_err",
                           "candidate:not_a_query_or_unparsable"),
        "insert_cte": ("SELECT a FROM t_err", "WITH x AS (SELECT 1) INSERT INTO t_err SELECT * FROM x",
                       "candidate:not_a_query_or_unparsable"),
        "reflect": ("SELECT a FROM t_err", "SELECT reflect('java.lang.Math', 'abs', -1)",
                    "candidate:forbidden_construct"),
        "reflect_quoted": ("SELECT a FROM t_err", "SELECT `reflect`('java.lang.Math', 'abs', -1)",
                           "candidate:forbidden_construct"),
        "reflect_after_quote": ("SELECT a FROM t_err", "SELECT '\\'' AS a, reflect('java.lang.Math', 'abs', -1) AS b",
                                "candidate:forbidden_construct"),
        "reflect_in_subquery": ("SELECT a FROM t_err", "SELECT a FROM t_err WHERE '1' IN (SELECT try_reflect("
                                "'java.lang.Math', 'abs', -1))", "candidate:forbidden_construct"),
        "path_read": ("SELECT a FROM t_err", f"SELECT * FROM `parquet`.`{path}`", "candidate:forbidden_relation"),
        "path_in_cte": ("SELECT a FROM t_err", f"WITH c AS (SELECT * FROM parquet.`{path}`) SELECT 1 FROM c",
                        "candidate:forbidden_relation"),
        "no_gold": (None, "SELECT 1", "gold:no_gold"),
    }
    for pid, (g, c, err) in cases.items():
        row = pair_verdict(spark, Pair(pid, g, c)).first()
        assert row["value"] is False and row["error"] == err, (pid, row)
    assert spark.table("t_err").count() == 1  # nothing ran


def test_only_listed_views_are_read(spark):
    for name in ("t_listed", "t_other"):
        spark.range(2).createOrReplaceTempView(name)
    ok = Pair("p", "SELECT id FROM t_listed", "SELECT id FROM t_listed WHERE id IN (SELECT id FROM t_listed)")
    bad = Pair("q", "SELECT id FROM t_listed", "SELECT id FROM t_listed WHERE EXISTS (SELECT 1 FROM t_other)")
    assert pair_verdict(spark, ok, views={"t_listed"}).first()["value"] is True
    assert pair_verdict(spark, bad, views={"t_listed"}).first()["error"] == "candidate:forbidden_relation"
    assert pair_verdict(spark, bad).first()["error"] is None


def test_exact_numbers_and_type_mismatch(spark):
    same = lambda a, b: pair_verdict(spark, Pair("p", f"SELECT {a} AS x", f"SELECT {b} AS x")).first()
    assert same("9007199254740993L", "CAST(9007199254740992 AS DECIMAL(20,0))")["value"] is False
    assert same("9007199254740993L", "CAST(9007199254740993 AS DECIMAL(20,0))")["value"] is True
    big = "CAST('12345678901234567890123.{}' AS DECIMAL({},2))"
    assert same(big.format("01", 25), big.format("02", 26))["value"] is False
    assert same(big.format("01", 25), big.format("01", 26))["value"] is True
    assert same("CAST(1.50 AS DECIMAL(5,2))", "1.5D")["value"] is True
    assert same("1", "'1'")["error"] == "type_mismatch"
    assert same("array(1)", "array(1L)")["value"] is True
    assert same("map('a', map('b', 1))", "map('a', map('b', 1L))")["value"] is True
    assert same("map('a', map('b', 1))", "map('a', map('b', 2L))")["value"] is False


def test_fingerprints_agree_with_the_exact_diff_on_maps(spark):
    from sqlscore.operators.equivalence import fingerprint_verdicts
    rows = {r["pair_id"]: r["fp_match"] for r in fingerprint_verdicts(spark, [
        Pair("width", "SELECT map('a', 1) AS m", "SELECT map('a', 1L) AS m"),
        Pair("nested", "SELECT map('a', map('b', 1)) AS m", "SELECT map('a', map('b', 1L)) AS m"),
        Pair("differ", "SELECT map('a', map('b', 1)) AS m", "SELECT map('a', map('b', 2L)) AS m")]).collect()}
    assert rows == {"width": True, "nested": True, "differ": False}


def test_unhashable_type_is_a_verdict(spark):
    q = "SELECT parse_json('{}') AS v"
    rows = verdicts(spark, [Pair("variant", q, q), Pair("ok", "SELECT 1", "SELECT 1")])
    found = {r["pair_id"]: r for r in score_pairs(spark, [Pair("variant", q, q), Pair("ok", "SELECT 1", "SELECT 1")])}
    assert rows.columns[0] == "pair_id" and found["ok"]["value"] is True and found["variant"]["value"] is False


def test_trailing_semicolon_and_comments(spark):
    spark.createDataFrame([(1,), (2,)], "a int").createOrReplaceTempView("t_sc")
    row = pair_verdict(spark, Pair("p", "SELECT a FROM t_sc ORDER BY a;", "SELECT a FROM t_sc -- all rows\n")).first()
    assert row["value"] is True and row["error"] is None


def test_wrap_rejects_empty():
    with pytest.raises(UnsafeQuery):
        wrap_query("   ")


def test_signed_diff_and_sample(spark):
    a = spark.range(0, 100).select(F.col("id").alias("a"))
    b = spark.range(10, 110).select(F.col("id").alias("a"))
    g, c = align(a, b)
    d = signed_diff(g, c).collect()
    assert sum(1 for r in d if r["side"] == "gold") == 10
    assert sum(1 for r in d if r["side"] == "candidate") == 10
    s = diff_sample(a, b, k=5).collect()
    assert sorted(r["_c0"] for r in s if r["side"] == "gold") == [0, 1, 2, 3, 4]


def test_ordered_mode(spark):
    """All columns and the dense rank by the key make up a row."""
    a = spark.range(0, 50, numPartitions=4).select(F.col("id").alias("place"), (F.col("id") * 2).alias("v"))
    b = a.repartition(3)
    c = a.select((F.col("place") * 10 + 7).alias("place"), "v")
    assert verdict(spark, a, b, mode="ordered", order_key="_c0")["value"] is True
    assert verdict(spark, a, c, mode="ordered", order_key="_c0")["value"] is False
    up, down = a.orderBy("place"), a.orderBy(F.desc("place"))
    assert verdict(spark, up, up.repartition(3).orderBy("place"), mode="ordered")["value"] is True
    assert verdict(spark, up, down, mode="ordered")["value"] is False
    assert verdict(spark, a, down, mode="ordered")["value"] is True  # no order asked for


ORDERED = [
    ("SELECT k, n FROM t_ord ORDER BY k", "SELECT k, n FROM t_ord ORDER BY k DESC", False),
    ("SELECT k, n FROM t_ord ORDER BY k", "SELECT k + 1, n FROM t_ord ORDER BY 1", False),
    ("SELECT n, v FROM t_ord ORDER BY v", "SELECT n, v FROM t_ord ORDER BY v, n DESC", True),
    ("SELECT n, v FROM t_ord ORDER BY v", "SELECT n, v FROM t_ord ORDER BY 2", True),
    ("SELECT n, v FROM t_ord ORDER BY v, n", "SELECT n, v FROM t_ord ORDER BY v", False),
    ("WITH c AS (SELECT * FROM t_ord) SELECT n, v FROM c ORDER BY v, n LIMIT 3", "SELECT n, v FROM t_ord ORDER BY v, n LIMIT 3;", True),
    ("SELECT n FROM t_ord ORDER BY k", "SELECT n FROM t_ord ORDER BY n", True),
    ("SELECT n FROM t_ord ORDER BY k DESC", "SELECT n FROM t_ord ORDER BY n", False),
    ("SELECT n FROM t_ord ORDER BY k", "SELECT n FROM t_ord", False),
    ("SELECT n FROM t_ord", "SELECT n FROM t_ord ORDER BY n DESC", True),
    ("SELECT n FROM (SELECT * FROM t_ord ORDER BY k) s", "SELECT n FROM t_ord ORDER BY n DESC", True),
    ("SELECT max(k) AS m FROM t_ord ORDER BY 1", "SELECT 5", True),
    ("SELECT v, count(*) FROM t_ord GROUP BY v ORDER BY count(*) DESC, v NULLS LAST",
     "SELECT v, count(1) AS c FROM t_ord GROUP BY v ORDER BY c DESC, v NULLS LAST", True),
    ("SELECT v FROM t_ord ORDER BY v NULLS LAST", "SELECT v FROM t_ord ORDER BY v NULLS FIRST", False),
]


@pytest.mark.parametrize(("gold", "cand", "want"), ORDERED)
def test_ordered_texts(spark, gold, cand, want):
    spark.sql("SELECT * FROM VALUES (1, 'a', 10), (2, 'b', 10), (3, 'c', 20), (4, 'd', 20), (5, 'e', NULL) AS t(k, n, v)"
              ).createOrReplaceTempView("t_ord")
    assert pair_verdict(spark, Pair("p", gold, cand), mode="ordered").first()["value"] is want
    (row,) = report_pairs(spark, [Pair("p", gold, cand)], mode="ordered")
    assert row[5] is want and bool(row[8] or row[9]) is not want


@pytest.mark.parametrize(("gold", "cand"), [("SELECT array(1)", "SELECT array(1)) t left semi join (select 1"),
                                            ("SELECT 1 AS a, 2 AS b", "SELECT 1 AS a) t, (SELECT 2 AS b")])
def test_text_that_is_no_query_by_itself(spark, gold, cand):
    row = pair_verdict(spark, Pair("p", gold, cand)).first()
    assert (row["value"], row["error"]) == (False, "candidate:not_a_query_or_unparsable")


@pytest.mark.parametrize(("gold", "cand", "want"), [
    ("sum(CAST(id AS DECIMAL(38,18)))", "sum(id) * 1.0", True), ("max(CAST(1 AS DECIMAL(38,0)))", "max(CAST(1 AS DECIMAL(38,10)))", True),
    ("max(CAST(-1.5 AS DECIMAL(38,18)))", "max(CAST(-1.5 AS DECIMAL(38,30)))", True), ("max(CAST(-1.5 AS DECIMAL(38,18)))", "max(CAST(1.5 AS DECIMAL(38,30)))", False),
    ("max(CAST(0.25 AS DECIMAL(38,38)))", "max(CAST(0.25 AS DECIMAL(38,2)))", True), ("max(9223372036854775807)", "max(CAST(9223372036854775807 AS DECIMAL(38,19)))", True),
    ("max(CAST(NULL AS DECIMAL(38,0)))", "max(CAST(NULL AS DECIMAL(38,20)))", True), ("max(CAST(NULL AS DECIMAL(38,0)))", "max(CAST(0 AS DECIMAL(38,20)))", False),
    ("max(CAST('99999999999999999999999999999999999999' AS DECIMAL(38,0)))", "max(CAST(0.5 AS DECIMAL(38,30)))", False)])
def test_wide_decimals(spark, gold, cand, want):
    spark.range(5).createOrReplaceTempView("t_ids")
    row = pair_verdict(spark, Pair("p", f"SELECT {gold} FROM t_ids", f"SELECT {cand} FROM t_ids")).first()
    assert (row["value"], row["error"]) == (want, None)


@pytest.mark.parametrize("mode", ["bag", "set"])
def test_report_is_verdict_and_samples(spark, mode):
    spark.range(40).createOrReplaceTempView("t_rep")
    pairs = [Pair("same", "SELECT id FROM t_rep", "SELECT id AS x FROM t_rep"), Pair("it's", "SELECT id FROM t_rep", "SELECT id + 3 FROM t_rep"),
             Pair("width", "SELECT id FROM t_rep", "SELECT id, id FROM t_rep"), Pair("bad", "SELECT id FROM t_rep", "SELECT nope FROM t_rep"),
             Pair("boom", "SELECT id FROM t_rep", "SELECT 1 / (id - id) FROM t_rep")]
    rows = {r[0]: r for r in report_pairs(spark, pairs, samples=2, mode=mode, group_size=2)}
    assert rows["same"][5] is True and rows["same"][8:] == ([], [])
    assert rows["it's"][1:6] == (40, 40, 3, 3, False)
    assert rows["it's"][8:] == (['{"_c0":0}', '{"_c0":1}'], ['{"_c0":40}', '{"_c0":41}'])
    assert rows["width"][5] is False and len(rows["width"][8]) == len(rows["width"][9]) == 2
    assert rows["bad"][6] == "candidate:unresolved" and rows["boom"][6] == "runtime:divide_by_zero"


def test_one_changed_row_is_one_bucket(spark):
    a = spark.range(20_000).select("id", (F.col("id") % 7).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 777, 99).otherwise(F.col("v")))
    buckets = bucket_fingerprints(*align(a, b), buckets=512).collect()
    assert 1 <= len(buckets) <= 2 and sum(r["rows"] for r in buckets) < 300
    assert sorted((r["_c0"], r["_c1"], r["side"]) for r in confirm_diff(a, b, 512).collect()) == [(777, 0, "gold"), (777, 99, "candidate")]
    assert confirm_diff(a, a.repartition(3), 512).count() == 0
    assert confirm_diff(a, a.union(a.filter("id < 5")), 512).count() == 5


def test_dense_index_is_dense(spark):
    df = spark.range(0, 1000, numPartitions=7).orderBy(F.col("id").desc())
    idx = dense_index(df).collect()
    assert sorted(r["__pos"] for r in idx) == list(range(1000))
    assert all(r["id"] == 999 - r["__pos"] for r in idx)


def test_fingerprint_unequal_implies_diff(spark):
    a = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    b = spark.createDataFrame([(1, None), (1, None)], "a int, b int")
    assert fingerprint(a).first() != fingerprint(b).first()
    assert verdict(spark, a, b)["value"] is False


def test_score_pairs_isolates_runtime_errors(spark):
    spark.createDataFrame([("1",), ("x",)], "s string").createOrReplaceTempView("t_rt")
    pairs = [Pair("ok", "SELECT s FROM t_rt", "SELECT s FROM t_rt"),
             Pair("boom", "SELECT CAST(s AS INT) FROM t_rt", "SELECT 1")]
    rows = {r["pair_id"]: r for r in score_pairs(spark, pairs)}
    assert rows["ok"]["value"] is True
    assert rows["boom"]["value"] is False and rows["boom"]["error"] == "runtime:cast_invalid_input"


def test_property_shuffle_invariance(spark):
    df = spark.range(0, 500).select((F.col("id") % 37).alias("k"), (F.col("id") % 5).alias("v"))
    shuffled = df.repartition(9).orderBy(F.rand(7))
    assert verdict(spark, df, shuffled)["value"] is True
    assert verdict(spark, shuffled, df)["value"] is True
    assert not math.isnan(1.0)


def test_fingerprint_verdicts_sql_path(spark):
    from sqlscore.operators.equivalence import fingerprint_verdicts
    spark.sql("SELECT * FROM VALUES (CAST('NaN' AS DOUBLE), 1, map('a', 1)), (-0.0D, NULL, map('b', 2)) "
              "AS t(d, i, m)").createOrReplaceTempView("fp_a")
    spark.sql("SELECT * FROM VALUES (0.0D, CAST(NULL AS BIGINT), map('b', 2)), (CAST('NaN' AS DOUBLE), 1L, map('a', 1)) "
              "AS t(x, y, z)").createOrReplaceTempView("fp_b")
    spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS INT)), (CAST(NULL AS INT), 1) AS t(a, b)").createOrReplaceTempView("fp_c")
    spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS INT)), (1, CAST(NULL AS INT)) AS t(a, b)").createOrReplaceTempView("fp_d")
    rows = {r["pair_id"]: r for r in fingerprint_verdicts(spark, [
        Pair("same", "SELECT * FROM fp_a", "SELECT * FROM fp_b"),
        Pair("nulls", "SELECT * FROM fp_c", "SELECT * FROM fp_d"),
        Pair("width", "SELECT * FROM fp_c", "SELECT a FROM fp_c"),
        Pair("bad", "SELECT * FROM fp_c", "SELECT nope FROM fp_c")]).collect()}
    assert rows["same"]["fp_match"] is True and rows["same"]["gold_rows"] == 2
    assert rows["nulls"]["fp_match"] is False
    assert rows["width"]["fp_match"] is False
    assert rows["bad"]["fp_match"] is False and rows["bad"]["gold_rows"] is None


def test_runtime_error_class_is_reported(spark):
    spark.createDataFrame([(1,), (0,)], "a int").createOrReplaceTempView("t_div")
    rows = score_pairs(spark, [Pair("div", "SELECT a FROM t_div", "SELECT 10 / a FROM t_div")])
    ansi = spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert rows[0]["value"] is False
    if ansi:
        assert rows[0]["error"] == "runtime:divide_by_zero"


def test_places_are_dealt_out_by_rows(spark, monkeypatch):
    """tasks get a bounded number of rows with many keys, and a hot key goes round the shuffle."""
    import sqlscore.operators.equivalence as E
    from pyspark.sql import functions as F
    monkeypatch.setattr(E, "FEW_KEYS", 10)
    monkeypatch.setattr(E, "PLACE_ROWS", 100)
    n = 2000
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id"))
    df = spark.range(n).select(key.cast("long").alias("_c0"), (F.col("id") % 5).cast("double").alias("_c1"))
    for keys in [((0, True, True),), ((1, False, False), (0, True, False))]:
        out = E.places(df, E.Order(keys))
        want = {}
        rows = [tuple(r) for r in df.collect()]
        def by(r):
            return [((r[i] is None) != first, 0 if r[i] is None else r[i] if up else -r[i]) for i, up, first in keys]
        for r in sorted(rows, key=by):
            want.setdefault(tuple(by(r)), len(want))
        got = sorted((tuple(r) for r in out.collect()), key=str)
        assert got == sorted(((*r, want[tuple(by(r))]) for r in rows), key=str)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert f"{(n // 100) + 1}), REPARTITION_BY_NUM" in plan and "left_anti" in plan.lower().replace("leftanti", "left_anti")
