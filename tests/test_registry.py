"""Every registered query runs on sf0.001 with a stable schema and has an oracle."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sqlscore.plans.queries import QUERIES

from conftest import SF


def test_entry(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 18 and "value" in df.columns


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    df = queries()[name](spark, SF)
    schema = df.schema.simpleString()
    df.limit(5).collect()
    assert queries()[name](spark, SF).schema.simpleString() == schema
