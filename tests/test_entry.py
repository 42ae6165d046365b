"""The registered queries against their SQL, on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import table_queries
from graphloom.operators import paths

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(table_queries.QUERIES))
def test_query(spark, duck, name):
    got, want = table_queries.QUERIES[name](spark, SF).toPandas(), duck.sql(table_queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_star_is_one_scan(spark):
    plan = table_queries.QUERIES["bgp_star"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_constant_reaches_the_scan(spark):
    plan = table_queries.QUERIES["match_object"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_nationkey,7)" in plan


def test_sameterm_takes_every_customer(spark):
    df = table_queries.QUERIES["filter_sameterm_all"](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/customer.parquet").count() > 20
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_joins_are_on_keys(spark):
    """mapped IRIs are joined on the tables' integer keys, no hash of a term is made or shuffled."""
    plan = table_queries.QUERIES["bgp_cycle_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 3 and "xxhash64" not in plan


def test_pairs_of_a_closure_are_not_shuffled(spark):
    """after the edges of each component are together, nothing joins the pairs with terms."""
    plan = table_queries.QUERIES["path_orders"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "xxhash64" not in plan and plan.count("Exchange") == 1


def test_bound_path_makes_its_edges_once(spark, monkeypatch):
    """no round makes the edges again or shuffles them, and no join attaches terms to the result."""
    plans, rounds = [], paths._rounds

    def watched(first, step):
        def watch(fresh, reached):
            out = step(fresh, reached)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out

        return rounds(first, watch)

    monkeypatch.setattr(paths, "_rounds", watched)
    df = table_queries.QUERIES["path_orders_bound"](spark, SF)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3
    for plan in plans:
        assert "Window" not in plan and "hashpartitioning" not in plan and "xxhash64" not in plan
