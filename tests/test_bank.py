"""Every query of the bank against another engine over the same tables."""

import compare
import pytest

from sluice import bank


@pytest.mark.parametrize("name", sorted(bank.QUERIES))
def test_query(spark, data, name):
    found = compare.of_spark(bank.QUERIES[name](spark, data))
    assert len(set(found[0])) == len(found[0])
    if name in bank.ORACLES:
        assert found == compare.of_duckdb(data, bank.ORACLES[name])


def test_names_are_unique_and_oracles_belong_to_queries():
    assert set(bank.ORACLES) <= set(bank.QUERIES)
    with pytest.raises(ValueError):
        bank.case("segments_twice", "SELECT 1 AS a")
        bank.case("segments_twice", "SELECT 1 AS a")
    bank.QUERIES.pop("segments_twice")
    bank.ORACLES.pop("segments_twice")


def test_range_join_is_an_equi_join(spark, data):
    plan = bank.QUERIES["range_join_blocks"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = bank.QUERIES["scan_project_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[1]


def test_range_join_gives_the_same_for_any_width(spark):
    from sluice.operators.joins import range_join

    points = spark.createDataFrame([(i,) for i in (-7, 0, 3, 9, 10, 55)], "p long")
    blocks = spark.createDataFrame([(1, -10, -1), (2, 0, 9), (3, 3, 60), (4, 10, 10)], "b int, lo long, hi long")
    want = sorted((p.p, b.b) for p in points.collect() for b in blocks.collect() if b.lo <= p.p <= b.hi)
    for width in (1, 7, 100):
        assert sorted((r.p, r.b) for r in range_join(points, blocks, "p", "lo", "hi", width).collect()) == want


def test_asof_takes_the_last_earlier_row(spark):
    from sluice.operators.joins import asof_join

    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3), ("a", 0)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 4, "z"), ("b", 9, "w")], "k string, t int, v string")
    found = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert found == {("a", 5): "z", ("a", 1): "x", ("b", 3): None, ("a", 0): None}
