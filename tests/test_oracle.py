"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math

import pytest

from spantab.plans.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    assert compare(spark, con, name, sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_finite_rows(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows
    assert all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))


@pytest.mark.parametrize("name", ["e16_mlp_fit", "e17_interval_fit"])
def test_loss_falls(spark, sf_dir, name):
    losses = [r["loss"] for r in QUERIES[name](spark, sf_dir).orderBy("epoch").collect()]
    assert losses[-1] < losses[0]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["set"] for r in rows} == {"train", "valid", "test", "bounded"}
    assert {r["fold"] for r in rows} == set(range(5))
