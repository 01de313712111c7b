"""Every registered query outside llm against its SQL in DuckDB."""

import pytest
from conftest import DATA, same

from atlasframe.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same(q.QUERIES[name](spark, DATA).toPandas(), duck.sql(q.ORACLES[name]).df())


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    from atlasframe import sources

    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("l_linenumber as z", "l_quantity as value")
    plan = sources.read_z_window(rows, 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_linenumber" in plan and "l_comment" not in plan


def test_distance_joins_have_no_cartesian_product(spark):
    from atlasframe.operators import spatial
    from atlasframe.plans import fixtures as fx

    p = fx.points(spark, DATA)
    plan = spatial.pairs_within(p, p, 2.0, "point_id", "point_id")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
