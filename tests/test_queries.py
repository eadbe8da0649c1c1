"""Every named query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference
from topicloom.plans.oracle import oracle
from topicloom.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"lasso_terms", "lasso_cv_terms", "lda_sweep", "gibbs_topics", "composition_errors"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(oracle()))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, oracle()[name]) is None


def test_every_query_without_sql_is_a_model():
    assert set(QUERIES) - set(oracle()) == SLOW | {"lda_topics", "lda_fixed_alpha_topics"}
    assert set(oracle()) <= set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["term", "tf", "df"] and df.count() > 0


def test_scan_reads_only_what_it_needs(spark):
    """Column pruning reaches the parquet scan."""
    from topicloom.plans import queries

    counts = queries.clean_tokens(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in counts
    labels = queries.class_histogram(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string>" in labels
