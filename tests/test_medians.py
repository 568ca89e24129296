"""Medians and quantiles of few and of many rows agree."""

import pytest
from pyspark.sql import functions as F

from hearthframe.operators import ordered as O
from hearthframe.operators import stats as S

ROWS = [("a", None, 1.0, 5), ("a", None, 4.0, None), ("a", None, float("nan"), 7), ("a", None, None, 9), (None, 1, -2.0, 1), (None, 1, 3.5, 2),
        ("b", 2, None, None), *[("c", 3, float(i * i % 97), i) for i in range(200)]]


@pytest.mark.parametrize("most", [0, 4, 1000])
def test_medians_of_few_and_many_rows_agree(spark, most):
    df = spark.createDataFrame(ROWS, "k string, j int, x double, y int")
    got = S.median_table(df, ["k", "j"], ["x", "y"], [F.max("y").alias("top")], most=most).select("k", "j", "n", "top", "median_x", "median_y")
    want = {("a", None): (4, 9, "4.0", 7.0), (None, 1): (2, 2, "0.75", 1.5), ("b", 2): (1, None, "None", None), ("c", 3): (200, 199, None, 99.5)}
    values = sorted(float(i * i % 97) for i in range(200))
    want["c", 3] = (200, 199, str((values[99] + values[100]) / 2), 99.5)
    assert {(r.k, r.j): (r.n, r.top, str(r.median_x), r.median_y) for r in got.collect()} == want


def test_quantiles_by_reading_twice_equal_the_running_weights(spark):
    df = spark.createDataFrame(ROWS, "k string, j int, x double, y int")
    for pick in (O.quantiles, O.finite_quantiles):
        one, two = (pick(df, ["k", "j"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}, count_as="n", reread=r) for r in (False, True))
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
