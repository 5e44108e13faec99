"""Property tests (small generated tables, few examples: each one runs Spark jobs)."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sqlscore.operators.equivalence import fingerprint, results_equal, signed_diff, align
from sqlscore.operators import evalset

ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)),
                          st.one_of(st.none(), st.sampled_from(["a", "b", ""]))), min_size=0, max_size=12)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "x int, y string"


def v(spark, a, b, **kw):
    return results_equal(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), **kw).first()


@SETTINGS
@given(rows=ROWS, seed=st.integers(0, 1000))
def test_permutation_is_equal(spark, rows, seed):
    shuffled = list(rows)
    random.Random(seed).shuffle(shuffled)
    assert v(spark, rows, shuffled)["value"] is True


@SETTINGS
@given(a=ROWS, b=ROWS)
def test_symmetry(spark, a, b):
    ab, ba = v(spark, a, b), v(spark, b, a)
    assert ab["value"] == ba["value"]
    assert ab["only_in_gold"] == ba["only_in_candidate"] and ab["only_in_candidate"] == ba["only_in_gold"]


@SETTINGS
@given(rows=ROWS.filter(lambda r: len(r) > 0), i=st.integers(0, 100))
def test_dropped_duplicate_is_found(spark, rows, i):
    doubled = rows + [rows[i % len(rows)]]
    r = v(spark, doubled, rows)
    assert r["value"] is False and r["only_in_gold"] == 1 and r["only_in_candidate"] == 0


@SETTINGS
@given(a=ROWS, b=ROWS)
def test_fingerprint_unequal_implies_nonempty_diff(spark, a, b):
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    if fingerprint(da).first() != fingerprint(db).first():
        assert signed_diff(*align(da, db)).count() > 0
    else:
        assert sorted(map(repr, a)) == sorted(map(repr, b))


@SETTINGS
@given(n=st.integers(0, 60), frac=st.sampled_from([0.0, 0.3, 0.5, 1.0]))
def test_split_disjoint_and_complete(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "eval_id")
    s = evalset.split(df, frac).collect()
    assert len(s) == n and {r["split"] for r in s} <= {"train", "test"}
    assert len({r["eval_id"] for r in s}) == n
