"""Every query with SQL against that SQL, every other query for rows, at the smallest scale."""

from __future__ import annotations

import os
from functools import partial

import pytest

import __spark_entry__ as entry
from cohortlens.catalogue import models
from cohortlens.models import ensembles, members
from tests.compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(autouse=True)
def small_models(monkeypatch):
    """Fewer trees, so that these tests stay short; the queries themselves have full sizes."""
    monkeypatch.setitem(members.GBT_DEFAULTS, "maxDepth", 3)
    for forest in (members.FOREST_DEFAULTS, members.EDA_FOREST, members.BASELINE_FOREST, models.SELECTION_FOREST, models.ENSEMBLE_FOREST):
        monkeypatch.setitem(forest, "numTrees", 12)
    monkeypatch.setattr(ensembles, "fit_stack", partial(ensembles.fit_stack, iterations=20))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).collect()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["age_band", "gender", "n", "positives", "rate"]
    assert df.count() > 0
