"""Plan properties of every registered query (static plans, AQE off):
no cross joins, no row-at-a-time Python UDFs."""

import pytest

from conftest import SF
from sqlscore.plans.queries import QUERIES

BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cross_join_no_row_udf(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = [b for b in BANNED if b in plan]
    assert not found, f"{name}: {found}"
