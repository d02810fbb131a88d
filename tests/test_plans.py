"""Every registered query of the reference operators against its oracle."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from evidentia import plans
from oracle import rows_of_duckdb, rows_of_spark

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, name):
    assert rows_of_spark(QUERIES[name](spark, sf_dir)) == rows_of_duckdb(sf_dir, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_join_any_key_takes_whole_tables(spark, sf_dir):
    """customers and suppliers meet whatever their balances."""
    pairs = QUERIES["join_any_key"](spark, sf_dir)
    c, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier"))
    met = c.join(s, c["c_nationkey"] == s["s_nationkey"])
    assert pairs.join(met.filter("c_acctbal <= 9000 and s_acctbal <= 5000"), ["s_suppkey", "c_custkey"], "left_semi").count() > 0
    assert met.join(pairs, ["s_suppkey", "c_custkey"], "left_anti").count() == 0
