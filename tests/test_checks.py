"""Queries against DuckDB on the smallest sample tables."""

import pytest

import checks
from checks.compare import connect, differences

checks.load()

# Training takes long and has no SQL; it is tested on its own.
SLOW = {"gen12_recommendations_with_model", "mod6_logistic_scores", "mod7_epoch_metrics", "mod8_batch_scores", "mod15_metrics_log"}


@pytest.mark.parametrize("name", sorted(set(checks.QUERIES) - SLOW))
def test_query(spark, sf_dir, name):
    got = checks.QUERIES[name](spark, sf_dir).toPandas()
    if name in checks.SQL:
        assert differences(got, connect(sf_dir).execute(checks.SQL[name]).df()) is None
    else:
        assert len(got)


def test_every_sql_has_a_query():
    assert set(checks.SQL) <= set(checks.QUERIES)
