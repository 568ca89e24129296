"""Steps that must not grow with the input in one task, or be worked out anew by every job."""

import numpy as np
from pyspark.sql import functions as F

from hearthframe.operators import models as MO
from hearthframe.operators import repeat_sales as RS
from hearthframe.operators import spatial as SP


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distances_to_towns_are_not_sorted(spark, monkeypatch):
    plans, write = {}, SP.materialise

    def keep(df, name):
        plans[name] = plan_of(df)
        return write(df, name)
    monkeypatch.setattr(SP, "materialise", keep)
    sales = spark.createDataFrame([("A", "T1", 1.30, 103.80), ("A", "T2", 1.30, 103.80), ("A", "T2", 1.31, 103.80), ("A", "T3", 1.40, 103.90), ("B", "T4", None, None)],
                                  "flat_type string, town string, latitude double, longitude double")
    requests = spark.createDataFrame([(1, "A", 1.30, 103.80), (1, "A", 1.30, 103.80), (2, "A", 1.41, 103.90), (3, "A", None, None), (4, "B", None, None), (5, "C", 1.0, 103.0)],
                                     "request_id long, flat_type string, latitude double, longitude double")
    got = sorted(map(tuple, SP.nearest_town(requests, sales).collect()))
    assert got == [(1, "T2", 2), (1, "T2", 2), (2, "T3", 1), (3, "T2", 2), (4, "T4", 1)]
    states = [plan for name, plan in plans.items() if name != "town-places"]
    assert states and not any("SortAggregate" in plan for plan in states)


def test_rare_levels_are_counted_once(spark):
    df = spark.range(60).select(F.when(F.col("id") < 55, "often").when(F.col("id") < 59, "rare").alias("c"))
    out = MO.pool_rare_levels(df, df, ["c"])
    assert sorted((r.c, r["count"]) for r in out.groupBy("c").count().collect()) == [("infrequent", 5), ("often", 55)]
    assert "Aggregate" not in plan_of(out)


def test_boosting_partitions_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(MO, "ROWS_AT_ONCE", 100)
    dealt = MO.dealt(spark.range(0, 10_000, 1, 2))
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 10_000 and max(r["count"] for r in sizes) <= 200


def test_backtest_works_out_its_pairs_once_and_shuffles_few_changes(spark, monkeypatch):
    written, write, ways, quantiles = [], RS.materialise, [], RS.O.quantiles
    monkeypatch.setattr(RS, "materialise", lambda df, name: written.append((name, df.columns)) or write(df, name))
    monkeypatch.setattr(RS.O, "quantiles", lambda *a, **b: ways.append(b.get("reread", False)) or quantiles(*a, **b))
    rows = [(k, 1 + 2 * (k % 2), f"f{k}", 100, 110 + k % 7, 100.0 + k, 104.0 + k * k % 31) for k in range(200)]
    pairs = spark.createDataFrame(rows, "base_id long, horizon_years int, future_id string, base_month int, future_month int, base_price double, future_price double")
    got = RS.scenario_backtest(pairs, 114)
    assert written[0] == ("backtest-pairs", ["horizon_years", "base_price", "future_price", "future_month"]) and ways == [True]
    for r in got.collect():
        early = np.log([x[6] / x[5] for x in rows if x[1] == r.horizon_years and x[4] < 114])
        assert r.calibration_pair_count == len(early) and abs(r.median_log_change - np.quantile(early, 0.5)) < 1e-12
        assert abs(r.upper_log_residual - (np.quantile(early, 0.9) - np.quantile(early, 0.5))) < 1e-12
    assert got.count() == 2
