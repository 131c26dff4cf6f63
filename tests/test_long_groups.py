"""Joins of long groups, and rows that SQL joins with nothing."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from plumbline.operators.events import basket_returns
from plumbline.operators.joins import as_of


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_reads_a_group_once(spark, forward):
    left = [(i, "ab"[i % 2], i * 37 % 1000) for i in range(900)] + [(900, "a", None), (901, None, 5), (902, "c", 5)]
    right = [("ab"[i % 2], i * 53 % 1000, i) for i in range(0, 700, 3)] + [("a", None, -1), (None, 5, -2)]
    got = as_of(spark.createDataFrame(left, "id int, symbol string, ts int"), spark.createDataFrame(right, "symbol string, ts int, v int"), values=("v",), forward=forward)
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()  # read anew for every row
    want = {}
    for i, symbol, ts in left:
        own = sorted((t, v) for s, t, v in right if s == symbol and None not in (s, t))
        times = [t for t, _ in own]
        k = -1 if ts is None else bisect_left(times, ts) if forward else bisect_right(times, ts) - 1
        want[i] = own[k][1] if 0 <= k < len(own) else None
    assert {r["id"]: r["v"] for r in got.collect()} == want


def test_equal_legs_of_a_basket_are_priced_once_and_counted(spark):
    legs = [(1, "a", 1, 0, 2)] * 3 + [(1, "b", -1, 1, 2), (2, "a", 1, 2, 9)]  # the last has no second price
    changes = spark.createDataFrame(legs, "review int, symbol string, sign int, announced int, effective int")
    closes = spark.createDataFrame([(0, "a", 10.0), (3, "a", 12.0), (1, "b", 10.0), (2, "b", 11.0)], "date int, symbol string, close double")
    got = basket_returns(changes, closes, 0.002)
    assert [tuple(r) for r in got.collect()] == [(1, 4, pytest.approx((3 * 0.2 - 0.1) / 4 - 0.002))]
    plan = basket_returns(changes.crossJoin(spark.range(50)).drop("id"), closes, 0.002)
    assert "unboundedfollowing" not in plan._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.select(F.sum("legs")).first()[0] == 200
