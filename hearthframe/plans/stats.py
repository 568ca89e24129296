"""Aggregation queries (survey group E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthframe.functions import measures as M
from hearthframe.operators import comparables as C
from hearthframe.operators import ordered as O
from hearthframe.operators import quality as Q
from hearthframe.operators import repeat_sales as RS
from hearthframe.operators import snapshots as SN
from hearthframe.operators import stats as S
from hearthframe.operators.lookups import modes
from hearthframe.plans.comparables import UNITS_SQL, pairs_sql
from hearthframe.plans.joins import SEQ_SQL, grouped_sales, paired
from hearthframe.plans.registry import query
from hearthframe.plans.scalars import SQL_LEASE_BAND
from hearthframe.session import materialise
from hearthframe.sources.tables import (
    LISTINGS_SQL, OBSERVATIONS_SQL, PREDICTIONS_SQL, SALES_SQL, SPLIT_SQL, listings, predictions, raw_observations, sales,
    table, with_split)

_ERR = "predicted_price - actual_price"


# Added before rounding to four places, so that exact halves round alike wherever they are computed.
NUDGE = 3e-7


def rounded(df, keys, columns, places=4):
    nudge = NUDGE if places == 4 else 0.0
    return df.select(*keys, *[F.round(F.col(c) + nudge, places).alias(c) for c in columns])


def _finite(value: str, p: float, keys: str) -> str:
    return (f"max({value}) FILTER (rn = least(n, greatest(1, CAST(ceil((n + 1) * {p}::DOUBLE) AS BIGINT))))")


@query("e2_evaluation_metrics", f"""WITH {PREDICTIONS_SQL}
SELECT model_id, dataset_split, count(*) AS prediction_count, round(avg(abs({_ERR})) + 3e-7::DOUBLE, 4) AS mae, round(quantile_cont(abs({_ERR}), 0.5) + 3e-7::DOUBLE, 4) AS median_absolute_error,
 round(avg(abs({_ERR}) / actual_price * 100) + 3e-7::DOUBLE, 4) AS mape_pct, round(quantile_cont(abs({_ERR}) / actual_price * 100, 0.5) + 3e-7::DOUBLE, 4) AS median_ape_pct,
 round(sqrt(avg(power({_ERR}, 2))) + 3e-7::DOUBLE, 4) AS rmse, round(1 - sum(power({_ERR}, 2)) / (var_pop(actual_price) * count(*)) + 3e-7::DOUBLE, 4) AS r_squared,
 round(avg({_ERR}) + 3e-7::DOUBLE, 4) AS mean_bias, round(avg(CAST(actual_price BETWEEN lower_estimate AND upper_estimate AS DOUBLE)) * 100 + 3e-7::DOUBLE, 4) AS interval_coverage_pct,
 round(avg(upper_estimate - lower_estimate) + 3e-7::DOUBLE, 4) AS mean_interval_width FROM predictions GROUP BY ALL""")
def _e2(spark, sf):
    m = S.evaluation_metrics(predictions(spark, sf), ["model_id", "dataset_split"])
    return rounded(m, ["model_id", "dataset_split", "prediction_count"],
                   ["mae", "median_absolute_error", "mape_pct", "median_ape_pct", "rmse", "r_squared", "mean_bias", "interval_coverage_pct", "mean_interval_width"])


@query("e3_segment_metrics", f"""WITH {PREDICTIONS_SQL},
r AS (SELECT *, abs({_ERR}) AS ae, row_number() OVER (PARTITION BY model_id, town ORDER BY abs({_ERR})) AS rn, count(*) OVER (PARTITION BY model_id, town) AS n FROM predictions)
SELECT model_id, town, count(*) AS prediction_count, round(avg(ae) + 3e-7::DOUBLE, 4) AS mae, round({_finite('ae', 0.9, '')} + 3e-7::DOUBLE, 4) AS p90_absolute_error FROM r GROUP BY ALL""")
def _e3(spark, sf):
    m = S.segment_metrics(predictions(spark, sf), ["model_id", "town"])
    return rounded(m, ["model_id", "town", "prediction_count"], ["mae", "p90_absolute_error"])


def _dims():
    return {"flat_type": F.col("flat_type"), "transaction_year": F.year("transaction_month"), "storey_range": F.col("storey_range"),
            "remaining_lease_band": M.lease_band(F.col("remaining_lease_months")), "town": F.col("town")}


_DIM_SQL = f"""dims AS (
  SELECT *, 'flat_type' AS dimension, flat_type AS grp FROM predictions UNION ALL SELECT *, 'transaction_year', CAST(year(transaction_month) AS VARCHAR) FROM predictions
  UNION ALL SELECT *, 'storey_range', storey_range FROM predictions UNION ALL SELECT *, 'remaining_lease_band', {SQL_LEASE_BAND} FROM predictions
  UNION ALL SELECT *, 'town', town FROM predictions)"""
_KEEP = ["model_id", "dataset_split", "predicted_price", "actual_price", "lower_estimate", "upper_estimate"]


@query("e4_error_by_dimension", f"""WITH {PREDICTIONS_SQL}, {_DIM_SQL}
SELECT model_id, dataset_split, dimension, grp AS "group", count(*) AS prediction_count, round(avg(abs({_ERR})), 8) AS mae,
  round(quantile_cont(abs({_ERR}), 0.5), 8) AS median_absolute_error, round(avg({_ERR}), 8) AS mean_bias FROM dims GROUP BY ALL""")
def _e4(spark, sf):
    d = S.stack_dimensions(predictions(spark, sf), _dims(), _KEEP)
    keys = ["model_id", "dataset_split", "dimension", "group"]
    m = S.evaluation_metrics(d, keys)
    return m.select(*keys, "prediction_count", F.round("mae", 8).alias("mae"), F.round("median_absolute_error", 8).alias("median_absolute_error"),
                    F.round("mean_bias", 8).alias("mean_bias"))


@query("e5_reliability_breakdown", f"""WITH {PREDICTIONS_SQL}, {_DIM_SQL}, ref AS (SELECT avg(abs({_ERR})) AS m FROM predictions WHERE dataset_split='test' AND model_id='MODEL_A')
SELECT model_id, dimension, grp AS "group", count(*) AS prediction_count, round(avg(abs({_ERR})) / (SELECT m FROM ref), 3) AS mae_vs_selected,
  CASE WHEN count(*) < 30 THEN 'too_few_to_judge' WHEN avg(abs({_ERR})) / (SELECT m FROM ref) >= 1.25 THEN 'higher_error_watch' ELSE 'within_overall_range' END AS reliability_status
FROM dims WHERE dataset_split = 'test' GROUP BY ALL""")
def _e5(spark, sf):
    p = predictions(spark, sf).filter("dataset_split = 'test'")
    ref = S.with_errors(p.filter("model_id = 'MODEL_A'")).agg(F.avg("abs_error").alias("m")).scalar()
    keys = ["model_id", "dimension", "group"]
    d = S.segment_metrics(S.stack_dimensions(p, _dims(), _KEEP), keys)
    return rounded(S.reliability(d, ref), [*keys, "prediction_count", "reliability_status"], ["mae_vs_selected"], 3)


_TEST = "SELECT * FROM split_sales WHERE dataset_split = 'test'"


@query("e6_paired_error_breakdown", f"""WITH {PREDICTIONS_SQL}, {pairs_sql(_TEST)},
w AS (SELECT tid, price, sum({UNITS_SQL}) AS u, any_value(tier) AS tier, count(*) AS n FROM winning GROUP BY tid, price),
c AS (SELECT tid, price, tier, sum(u) OVER (PARTITION BY tid ORDER BY price) AS cum, sum(u) OVER (PARTITION BY tid) AS total, sum(n) OVER (PARTITION BY tid) AS sales_behind FROM w),
base AS (SELECT tid, min(price) FILTER (cum >= total * 0.5) AS baseline_price, any_value(tier) AS tier, max(sales_behind) AS n FROM c GROUP BY tid),
cuts AS (SELECT quantile_cont(resale_price, 0.25) AS q1, quantile_cont(resale_price, 0.5) AS q2, quantile_cont(resale_price, 0.75) AS q3 FROM split_sales WHERE dataset_split = 'train'),
x AS (SELECT p.*, baseline_price, tier, n, abs(predicted_price - actual_price) AS ae, q1, q2, q3 FROM predictions p JOIN base ON tid = transaction_id, cuts WHERE model_id = 'MODEL_B' AND dataset_split = 'test'),
d AS (SELECT *, 'town' AS dimension, town AS t, town AS g FROM x UNION ALL SELECT *, 'town_flat_type', town, flat_type FROM x UNION ALL SELECT *, 'town_lease_band', town, {SQL_LEASE_BAND} FROM x
 UNION ALL SELECT *, 'town_predicted_price_band', town, CASE WHEN predicted_price <= q1 THEN 'Q1' WHEN predicted_price <= q2 THEN 'Q2' WHEN predicted_price <= q3 THEN 'Q3' ELSE 'Q4' END FROM x
 UNION ALL SELECT *, 'town_comparable_tier', town, tier FROM x UNION ALL SELECT *, 'town_comparable_count_band', town, CASE WHEN n < 5 THEN '<5' WHEN n < 20 THEN '5-19' ELSE '20+' END FROM x
 UNION ALL SELECT *, 'transaction_month', 'ALL', strftime(transaction_month, '%Y-%m') FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension, t, g ORDER BY ae) AS rn, count(*) OVER (PARTITION BY dimension, t, g) AS cnt FROM d),
s AS (SELECT dimension, t AS town, g AS "group", count(*) AS sale_count, avg(ae) AS m, avg(abs(baseline_price - actual_price)) AS b, avg(ae / actual_price * 100) AS mape, avg({_ERR}) AS bias,
 max(ae) FILTER (rn = least(cnt, greatest(1, CAST(ceil((cnt + 1) * 0.9::DOUBLE) AS BIGINT)))) AS p90, avg(CAST(actual_price BETWEEN lower_estimate AND upper_estimate AS DOUBLE)) * 100 AS cov FROM r GROUP BY ALL),
top AS (SELECT town, "group", row_number() OVER (ORDER BY mape DESC, sale_count DESC, town, "group") AS priority FROM s WHERE dimension = 'town_flat_type' AND sale_count >= 100 QUALIFY priority <= 10)
SELECT s.dimension, s.town, s."group", sale_count, round(m + 3e-7::DOUBLE, 4) AS model_mae, round(b + 3e-7::DOUBLE, 4) AS baseline_mae, round(m - b + 3e-7::DOUBLE, 4) AS model_minus_baseline_mae,
 round(mape + 3e-7::DOUBLE, 4) AS model_mape_pct, round(bias + 3e-7::DOUBLE, 4) AS model_mean_bias, round(p90 + 3e-7::DOUBLE, 4) AS model_p90_absolute_error, round(cov + 3e-7::DOUBLE, 4) AS range_coverage_pct,
 CASE WHEN sale_count < 30 THEN 'limited_sales' WHEN m > b THEN 'model_higher_mae' ELSE 'model_lower_mae' END AS evidence_status, CAST(priority AS INT) AS priority
FROM s LEFT JOIN top ON s.dimension = 'town_flat_type' AND top.town = s.town AND top."group" = s."group" """)
def _e6(spark, sf):
    base = with_split(sales(spark, sf))
    found = C.estimate_targets(base.filter("dataset_split = 'test'"), base).filter("weighted_price IS NOT NULL").select(
        "transaction_id", F.col("weighted_price").alias("baseline_price"), "comparable_tier", "comparable_count")
    model = predictions(spark, sf).filter("model_id = 'MODEL_B' AND dataset_split = 'test'")
    cuts = S.training_quartiles(base.filter("dataset_split = 'train'"), "resale_price")
    segments = materialise(S.paired_error_breakdown(model.join(found, "transaction_id"), cuts), "segments")
    keys = ["dimension", "town", "group"]
    measures = ["model_mae", "baseline_mae", "model_minus_baseline_mae", "model_mape_pct", "model_mean_bias", "model_p90_absolute_error", "range_coverage_pct"]
    out = segments.join(S.worst_segments(segments), keys, "left")
    return rounded(out, [*keys, "sale_count", "evidence_status", "priority"], measures)


@query("e7_percentile_linear", "SELECT l_shipmonth, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM (SELECT month(l_shipdate) AS l_shipmonth, l_extendedprice FROM lineitem) GROUP BY 1")
def _e7(spark, sf):
    li = table(spark, sf, "lineitem").select(F.month("l_shipdate").alias("l_shipmonth"), "l_extendedprice")
    return rounded(O.quantiles(li, ["l_shipmonth"], "l_extendedprice", {"p90": 0.9}), ["l_shipmonth"], ["p90"], 6)


@query("e10_finite_sample_quantile", f"""WITH r AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, {_finite('v', 0.9, '')} AS p90, {_finite('v', 0.025, '')} AS p025, {_finite('v', 0.9999999, '')} AS top FROM r GROUP BY 1""")
def _e10(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    return O.finite_quantiles(o, ["o_orderpriority"], "o_totalprice", {"p90": 0.9, "p025": 0.025, "top": 0.9999999})


@query("e11_residual_bounds", f"""WITH {PREDICTIONS_SQL},
r AS (SELECT model_id, actual_price - predicted_price AS v, abs(actual_price - predicted_price) AS a, count(*) OVER (PARTITION BY model_id) AS n,
  row_number() OVER (PARTITION BY model_id ORDER BY actual_price - predicted_price) AS rn, row_number() OVER (PARTITION BY model_id ORDER BY abs(actual_price - predicted_price)) AS ra
  FROM predictions WHERE dataset_split = 'validation')
SELECT model_id, round({_finite('v', (1 - 0.95) / 2, '')} + 3e-7::DOUBLE, 4) AS lower_offset, round({_finite('v', 1 - (1 - 0.95) / 2, '')} + 3e-7::DOUBLE, 4) AS upper_offset,
  round(max(a) FILTER (ra = least(n, greatest(1, CAST(ceil((n + 1) * 0.95::DOUBLE) AS BIGINT)))) + 3e-7::DOUBLE, 4) AS radius FROM r GROUP BY 1""")
def _e11(spark, sf):
    from hearthframe.operators.calibration import residual_offsets
    v = predictions(spark, sf).filter("dataset_split = 'validation'")
    return rounded(residual_offsets(v, ["model_id"], 0.95), ["model_id"], ["lower_offset", "upper_offset", "radius"])


@query("e12_pearson", f"WITH {SALES_SQL} SELECT flat_type, count(*) AS n, round(corr(floor_area_sqm, resale_price), 8) AS pearson_r FROM sales GROUP BY 1")
def _e12(spark, sf):
    return rounded(S.pearson(sales(spark, sf), "floor_area_sqm", "resale_price", ["flat_type"]), ["flat_type", "n"], ["pearson_r"], 8)


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@query("e13_spearman", f"""WITH {SALES_SQL}, r AS (SELECT {_RANK.format(c='floor_area_sqm')} AS x, {_RANK.format(c='resale_price')} AS y FROM sales)
SELECT count(*) AS n, round(corr(x, y), 8) AS spearman_rho FROM r""")
def _e13(spark, sf):
    return rounded(S.spearman(sales(spark, sf), "floor_area_sqm", "resale_price"), ["n"], ["spearman_rho"], 8)


@query("e14_eta_squared", f"""WITH {SALES_SQL}, g AS (SELECT flat_model, count(*) n, avg(resale_price) m FROM sales GROUP BY 1), t AS (SELECT avg(resale_price) gm, var_pop(resale_price)*count(*) sst, count(*) c FROM sales)
SELECT any_value(c) AS n, count(*) AS groups, round(sum(n*(m-gm)*(m-gm)) / any_value(sst), 8) AS eta_squared FROM g, t""")
def _e14(spark, sf):
    return rounded(S.eta_squared(sales(spark, sf), "flat_model", "resale_price"), ["n", "groups"], ["eta_squared"], 8)


@query("e15_within_group_pearson", f"""WITH {SALES_SQL}, d AS (SELECT floor_area_sqm - avg(floor_area_sqm) OVER (PARTITION BY flat_type) AS x, resale_price - avg(resale_price) OVER (PARTITION BY flat_type) AS y FROM sales)
SELECT count(*) AS n, round(corr(x, y), 8) AS within_r FROM d""")
def _e15(spark, sf):
    return rounded(S.within_group_pearson(sales(spark, sf), "floor_area_sqm", "resale_price", "flat_type"), ["n"], ["within_r"], 8)


@query("e16_column_profile", """
SELECT 'l_returnflag' AS "column", count(*) AS rows, count(*) - count(l_returnflag) AS missing_rows, count(DISTINCT l_returnflag) AS distinct_values FROM lineitem
UNION ALL SELECT 'l_quantity', count(*), count(*) - count(l_quantity), count(DISTINCT l_quantity) FROM lineitem
UNION ALL SELECT 'l_suppkey', count(*), count(*) - count(l_suppkey), count(DISTINCT l_suppkey) FROM lineitem
UNION ALL SELECT 'tax', count(*), count(*) FILTER (l_tax = 0), count(DISTINCT nullif(l_tax, 0)) FROM lineitem""")
def _e16(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("tax", F.nullif(F.col("l_tax"), F.lit(0.0)))
    return S.column_profile(li, ["l_returnflag", "l_quantity", "l_suppkey", "tax"])


@query("e17_mode_with_tiebreak", f"""WITH {SALES_SQL}
SELECT block_id, flat_type, flat_model FROM (SELECT block_id, flat_type, flat_model, count(*) n, min(month_no) m FROM sales GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY block_id, flat_type ORDER BY n DESC, m, flat_model) = 1""")
def _e17(spark, sf):
    return modes(sales(spark, sf), ["block_id", "flat_type"], "flat_model", "month_no")


@query("e18_monthly_trends", f"""WITH {SALES_SQL}
SELECT transaction_month, town, flat_type, count(*) AS n, round(quantile_cont(resale_price, 0.5), 9) AS median_resale_price, round(quantile_cont(resale_price / floor_area_sqm, 0.5), 9) AS median_unit FROM sales GROUP BY ALL""")
def _e18(spark, sf):
    s = sales(spark, sf).withColumn("unit", M.unit_price(F.col("resale_price"), F.col("floor_area_sqm")))
    keys = ["transaction_month", "town", "flat_type"]
    return rounded(S.median_table(s, keys, ["resale_price", "unit"]), [*keys, "n"], ["median_resale_price", "median_unit"], 9)


_MEDS = ["resale_price", "floor_area_sqm", "storey_midpoint", "remaining_lease_months", "lease_commence_year"]


@query("e19_block_summary", f"""WITH {SALES_SQL}
SELECT block_id, town, flat_type, count(*) AS n, min(resale_price) AS low_price, max(resale_price) AS high_price, max(transaction_month) AS last_month,
 {', '.join(f'round(quantile_cont({c}, 0.5), 6) AS median_{c}' for c in _MEDS)} FROM sales GROUP BY ALL""")
def _e19(spark, sf):
    keys = ["block_id", "town", "flat_type"]
    m = S.median_table(sales(spark, sf), keys, _MEDS, [F.min("resale_price").alias("low_price"), F.max("resale_price").alias("high_price"),
                                                       F.max("transaction_month").alias("last_month")])
    return rounded(m, [*keys, "n", "low_price", "high_price", "last_month"], [f"median_{c}" for c in _MEDS], 6)


@query("e20_build_metadata", f"WITH {SALES_SQL} SELECT count(*) AS sales, count(DISTINCT block_id) AS blocks, count(DISTINCT town) AS towns, count(DISTINCT flat_type) AS types, min(transaction_month) AS first_month, max(transaction_month) AS last_month FROM sales")
def _e20(spark, sf):
    # One narrow aggregate to distinct triples, then small counts.
    t = sales(spark, sf).groupBy("block_id", "town", "flat_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("transaction_month").alias("a"), F.max("transaction_month").alias("b"))
    return t.agg(F.sum("n").alias("sales"), F.count_distinct("block_id").alias("blocks"), F.count_distinct("town").alias("towns"),
                 F.count_distinct("flat_type").alias("types"), F.min("a").alias("first_month"), F.max("b").alias("last_month"))


@query("e21_market_overview", """
SELECT event_type, count(*) AS listing_count, count(*) FILTER (value > 50) AS expensive_count, count(*) FILTER (value < 5) AS cheap_count,
  round(quantile_cont(value, 0.5), 6) AS median_value, max(ts) AS latest FROM events GROUP BY 1""")
def _e21(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value", "ts")
    m = S.median_table(e, ["event_type"], ["value"], [F.count_if(F.col("value") > 50).alias("expensive_count"),
                                                     F.count_if(F.col("value") < 5).alias("cheap_count"), F.max("ts").alias("latest")])
    return m.select("event_type", F.col("n").alias("listing_count"), "expensive_count", "cheap_count", F.round("median_value", 6).alias("median_value"), "latest")


@query("e22_dq_checks", """
WITH t AS (SELECT count(*) AS total, count(*) FILTER (c_acctbal > -500) AS matched, count(*) FILTER (c_acctbal > 1000) AS valued, count(c_name) AS linked,
  count(c_acctbal) AS with_area, count(*) FILTER (c_acctbal > 9990) AS low FROM customer)
SELECT 'current_listing_count' AS check_name, total::DOUBLE AS observed_value, 'count' AS unit, 'informational' AS status FROM t
UNION ALL SELECT 'block_match_coverage', 100.0::DOUBLE*matched/total, 'percent', CASE WHEN 100.0::DOUBLE*matched/total >= 95 THEN 'pass' ELSE 'review' END FROM t
UNION ALL SELECT 'valuation_coverage', 100.0::DOUBLE*valued/total, 'percent', CASE WHEN 100.0::DOUBLE*valued/total >= 90 THEN 'pass' ELSE 'review' END FROM t
UNION ALL SELECT 'listing_url_coverage', 100.0::DOUBLE*linked/total, 'percent', CASE WHEN linked = total THEN 'pass' ELSE 'review' END FROM t
UNION ALL SELECT 'floor_area_coverage', 100.0::DOUBLE*with_area/total, 'percent', CASE WHEN 100.0::DOUBLE*with_area/total >= 95 THEN 'pass' ELSE 'review' END FROM t
UNION ALL SELECT 'unusually_low_price_flags', low::DOUBLE, 'count', CASE WHEN low = 0 THEN 'pass' ELSE 'review' END FROM t
UNION ALL SELECT 'complete_snapshot_count', (SELECT count(DISTINCT c_nationkey) FROM customer)::DOUBLE, 'count', 'pass' FROM t""")
def _e22(spark, sf):
    c = table(spark, sf, "customer")
    bal = F.col("c_acctbal")
    row = c.agg(F.count(F.lit(1)).alias("total"), F.count_if(bal > -500).alias("matched"), F.count_if(bal > 1000).alias("valued"),
                F.count("c_name").alias("linked"), F.count("c_acctbal").alias("with_area"), F.count_if(bal > 9990).alias("low_price_flags"),
                F.count_distinct("c_nationkey").alias("snapshots"))
    return S.quality_checks(row)


@query("e23_histogram_fixed", """
WITH c AS (SELECT CAST(floor(o_totalprice / 100000) * 100000 AS BIGINT) AS bucket, count(*) AS n FROM orders WHERE o_totalprice < 100000 OR o_totalprice > 300000 GROUP BY 1)
SELECT s.b AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(bucket) FROM c), (SELECT max(bucket) FROM c), 100000)) AS b) s LEFT JOIN c ON c.bucket = s.b""")
def _e23(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice < 100000 OR o_totalprice > 300000")
    return S.histogram(o, "o_totalprice", 100000)


@query("e24_equal_width_bins", f"""WITH {SALES_SQL}, b AS (SELECT min(floor_area_sqm) lo, max(floor_area_sqm) hi FROM sales)
SELECT CAST(least(49, floor((floor_area_sqm - lo) / (hi - lo) * 50)) AS INTEGER) AS bin, round(avg(floor_area_sqm), 6) AS mean_x, round(avg(resale_price) + 3e-7::DOUBLE, 4) AS mean_y, count(*) AS n FROM sales, b GROUP BY 1""")
def _e24(spark, sf):
    b = S.equal_width_bins(sales(spark, sf), "floor_area_sqm", "resale_price")
    return b.select("bin", F.round("mean_x", 6).alias("mean_x"), F.round(F.col("mean_y") + NUDGE, 4).alias("mean_y"), "n")


@query("e25_latest_complete_run", f"""WITH {LISTINGS_SQL},
r AS (SELECT source_site, run_id, max(last_seen) AS observed, 8 AS expected, count(DISTINCT p) AS saved_pages FROM (SELECT *, unnest(pages_seen) AS p FROM listings) GROUP BY 1, 2 HAVING count(DISTINCT p) = 8)
SELECT source_site, run_id, observed, saved_pages FROM r QUALIFY row_number() OVER (PARTITION BY source_site ORDER BY observed DESC, run_id DESC) = 1""")
def _e25(spark, sf):
    return SN.latest_complete_runs(listings(spark, sf).withColumn("total_pages", F.lit(8)))


@query("e26_status_counters", "SELECT 'flag' AS dimension, l_returnflag AS \"group\", count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def _e26(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return S.status_counts(li, ["flag", "status"])


@query("e27_local_evidence_counts", f"WITH {SPLIT_SQL} SELECT town, flat_type, count(*) FILTER (month_no >= 23980) AS recent_training_sales, count(*) FILTER (month_no >= 23980) < 100 AS limited_local FROM split_sales WHERE dataset_split = 'train' GROUP BY ALL")
def _e27(spark, sf):
    return S.local_evidence(with_split(sales(spark, sf)).filter("dataset_split = 'train'"), 23980)


@query("e28_centroid", """
SELECT c_mktsegment AS station, count(*) AS exits, round(avg(1.2::DOUBLE + (c_custkey % 100) * 0.003::DOUBLE), 8) AS latitude, array_to_string(list_sort(list(DISTINCT CAST(c_nationkey % 7 AS VARCHAR))), ',') AS exit_codes,
  CASE WHEN c_mktsegment LIKE 'M%' THEN 'LRT' ELSE 'MRT' END AS rail_type FROM customer GROUP BY 1""")
def _e28(spark, sf):
    from hearthframe.operators.places import station_centroids
    c = table(spark, sf, "customer")
    name = F.col("c_mktsegment")
    exits = c.select(name.alias("station"), F.when(name.like("M%"), F.concat(name, F.lit(" LRT STATION"))).otherwise(name).alias("full_name"),
                     (F.lit(1.2) + F.col("c_custkey") % 100 * 0.003).alias("latitude"), F.lit(103.8).alias("longitude"),
                     (F.col("c_nationkey") % 7).cast("string").alias("exit_code"))
    return station_centroids(exits).select("station", "exits", F.round("latitude", 8).alias("latitude"), "exit_codes", "rail_type")


@query("e29_filtered_summary", f"WITH {SALES_SQL} SELECT count(*) AS n, count(DISTINCT block_id) AS blocks, round(quantile_cont(resale_price, 0.5), 6) AS median_price FROM sales WHERE flat_type IN ('SMALL','PROMO') AND transaction_month >= DATE '1999-01-01'")
def _e29(spark, sf):
    s = sales(spark, sf).filter(F.col("flat_type").isin("SMALL", "PROMO") & (F.col("transaction_month") >= "1999-01-01"))
    m = S.median_table(s, [], ["resale_price"], [F.count_distinct("block_id").alias("blocks")])
    return m.select("n", "blocks", F.round("median_resale_price", 6).alias("median_price"))


@query("e30_snapshot_run_summary", f"""WITH {SEQ_SQL},
gone AS (SELECT r.source_site, r.run_id, count(*) AS g FROM seqd p JOIN runs r ON r.source_site = p.source_site AND r.seq = p.seq + 1
  LEFT JOIN seqd c ON c.source_site = p.source_site AND c.listing_id = p.listing_id AND c.seq = p.seq + 1 WHERE c.listing_id IS NULL GROUP BY ALL)
SELECT source_site, run_id, any_value(snapshot_sequence) AS snapshot_sequence, count(*) AS listing_count, count(*) FILTER (change_type='new') AS new_count,
  count(*) FILTER (change_type='price_reduced') AS price_reduced_count, count(*) FILTER (change_type='price_increased') AS price_increased_count,
  count(*) FILTER (change_type='unchanged') AS unchanged_count, coalesce(any_value(g), 0) AS disappeared_from_previous_count
FROM changes LEFT JOIN gone USING (source_site, run_id) GROUP BY source_site, run_id""")
def _e30(spark, sf):
    return SN.snapshot_summary(listings(spark, sf))


@query("e31_train_ranges", f"WITH {SPLIT_SQL} SELECT flat_model, flat_type, min(floor_area_sqm) AS low_area, max(floor_area_sqm) AS high_area FROM split_sales WHERE dataset_split='train' GROUP BY ALL")
def _e31(spark, sf):
    return with_split(sales(spark, sf)).filter("dataset_split = 'train'").groupBy("flat_model", "flat_type").agg(
        F.min("floor_area_sqm").alias("low_area"), F.max("floor_area_sqm").alias("high_area"))


_PAIR_SALES = SALES_SQL.replace("'B' || l_suppkey AS block_id", "'B' || (l_suppkey % 10) AS block_id")


@query("e32_scenario_backtest", f"""WITH {_PAIR_SALES},
c AS (SELECT b.transaction_id AS base_id, h, f.transaction_id AS fid, f.month_no AS fm, b.resale_price AS bp, f.resale_price AS fp, abs(f.month_no - b.month_no - 12*h) AS mg,
  abs(b.floor_area_sqm - f.floor_area_sqm) AS ag, abs(b.storey_midpoint - f.storey_midpoint) AS sg FROM sales b JOIN sales f ON f.block_id = b.block_id AND f.flat_type = b.flat_type
  AND f.flat_model = b.flat_model AND f.month_no > b.month_no AND abs(f.floor_area_sqm - b.floor_area_sqm) <= 5 AND abs(f.storey_midpoint - b.storey_midpoint) <= 3, (VALUES (1),(3),(5)) v(h)
  WHERE abs(f.month_no - b.month_no - 12*h) <= 3),
p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY base_id, h ORDER BY mg, ag, sg, fm, fid) = 1),
q AS (SELECT h, count(*) AS cn, quantile_cont(ln(fp/bp), 0.5) AS mid, quantile_cont(ln(fp/bp), 0.1) AS lo, quantile_cont(ln(fp/bp), 0.9) AS hi FROM p WHERE fm < 24006 GROUP BY h HAVING count(*) >= 30)
SELECT h AS horizon_years, any_value(cn) AS calibration_pair_count, count(*) AS test_pair_count, round(any_value(mid), 8) AS median_log_change,
  round(avg(abs(fp - bp*exp(mid))) + 3e-7::DOUBLE, 4) AS test_mae, round(avg(CAST(fp BETWEEN bp*exp(mid)*exp(lo-mid) AND bp*exp(mid)*exp(hi-mid) AS DOUBLE)), 6) AS test_range_coverage
FROM p JOIN q USING (h) WHERE fm >= 24006 GROUP BY h""")
def _e32(spark, sf):
    b = RS.scenario_backtest(RS.repeat_sale_pairs(grouped_sales(spark, sf)), 24006)
    return b.select("horizon_years", "calibration_pair_count", "test_pair_count", F.round("median_log_change", 8).alias("median_log_change"),
                    F.round(F.col("test_mae") + NUDGE, 4).alias("test_mae"), F.round("test_range_coverage", 6).alias("test_range_coverage"))


@query("e33_time_split", f"WITH {SPLIT_SQL} SELECT dataset_split, count(*) AS n, min(transaction_month) AS first_month, max(transaction_month) AS last_month FROM split_sales GROUP BY 1")
def _e33(spark, sf):
    return with_split(sales(spark, sf)).groupBy("dataset_split").agg(
        F.count(F.lit(1)).alias("n"), F.min("transaction_month").alias("first_month"), F.max("transaction_month").alias("last_month"))


@query("e34_paired_wins", f"""WITH {PREDICTIONS_SQL},
x AS (SELECT a.dataset_split, a.town, a.actual_price AS y, a.predicted_price AS o, b.predicted_price AS w FROM predictions a JOIN predictions b USING (transaction_id, dataset_split) WHERE a.model_id='MODEL_A' AND b.model_id='MODEL_B'),
d AS (SELECT *, 'overall' AS dimension, 'ALL' AS g FROM x UNION ALL SELECT *, 'town', town FROM x)
SELECT dataset_split, dimension, g AS "group", count(*) AS sales, round(avg(abs(o-y)) + 3e-7::DOUBLE, 4) AS old_mae, round(avg(abs(w-y)) + 3e-7::DOUBLE, 4) AS new_mae,
  count(*) FILTER (abs(o-y) - abs(w-y) > 0.005) AS new_wins, count(*) FILTER (abs(o-y) - abs(w-y) < -0.005) AS old_wins, count(*) FILTER (abs(abs(o-y) - abs(w-y)) <= 0.005) AS ties
FROM d GROUP BY ALL""")
def _e34(spark, sf):
    g = S.paired_gains(paired(predictions(spark, sf)), {"overall": F.lit("ALL"), "town": F.col("town")})
    return g.select("dataset_split", "dimension", "group", "sales", F.round(F.col("old_mae") + NUDGE, 4).alias("old_mae"), F.round(F.col("new_mae") + NUDGE, 4).alias("new_mae"), "new_wins", "old_wins", "ties")


@query("e35_source_coverage", "SELECT source, lang, count(*) AS records, count(*) FILTER (n_chars > 500) AS records_with_coordinates FROM documents GROUP BY ALL")
def _e35(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("n_chars") > 500).alias("records_with_coordinates"))


@query("e36_merge_by_key", f"WITH {LISTINGS_SQL} SELECT source_site, run_id, listing_id, first_seen, last_seen, asking_price_sgd, array_to_string(pages_seen, ',') AS pages FROM listings")
def _e36(spark, sf):
    return listings(spark, sf).withColumn("pages", F.array_join(F.col("pages_seen").cast("array<string>"), ",")).drop("pages_seen")


@query("e37_run_completeness", f"""WITH {OBSERVATIONS_SQL}
SELECT source_site, run_id, array_to_string(list_sort(list(DISTINCT page_number)), ',') AS saved_pages,
  coalesce(array_to_string(list_filter(generate_series(1, 10), lambda x: NOT list_contains(list(DISTINCT page_number), x)), ','), '') AS missing_pages,
  count(DISTINCT listing_id) AS unique_listing_ids, count(*) - count(DISTINCT listing_id) AS count_difference, CASE WHEN count(DISTINCT page_number) = 10 THEN 'complete' ELSE 'partial' END AS status
FROM observations GROUP BY source_site, run_id""")
def _e37(spark, sf):
    o = raw_observations(spark, sf)
    totals = o.groupBy("source_site", "run_id").agg(F.lit(10).alias("total_pages"), F.count(F.lit(1)).alias("advertised_count"))
    return SN.run_progress(o, totals)


@query("e38_audit_counters", """
SELECT 'rows' AS kind, 'to_fix' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'field', 'title', count(*) FILTER (s_suppkey % 3 = 0) FROM supplier
UNION ALL SELECT 'field', 'address', count(*) FROM supplier UNION ALL SELECT 'field', 'block', count(*) FROM supplier UNION ALL SELECT 'field', 'street', count(*) FROM supplier
UNION ALL SELECT 'field', 'project_name', count(*) FROM supplier UNION ALL SELECT 'issue', 'missing_or_invalid_price', count(*) FILTER (s_suppkey % 5 = 0) FROM supplier""")
def _e38(spark, sf):
    k = F.col("s_suppkey").cast("string")
    rows = table(spark, sf, "supplier").select(
        F.lit("main").alias("source_site"), k.alias("listing_id"), F.concat(F.lit("https://a.example.org/x-"), k).alias("listing_url"),
        F.when(F.col("s_suppkey") % 3 == 0, "42").otherwise("Nice flat").alias("title"), F.concat(F.lit("Blk "), k, F.lit(" Elm St")).alias("project_name"),
        F.lit("Elm St").alias("address"), F.lit("").alias("block"), F.lit("").alias("street"),
        F.when(F.col("s_suppkey") % 5 == 0, 0).otherwise(1).alias("asking_price_sgd"), F.lit(900).alias("floor_area_sqft"), F.lit("{}").alias("raw_card_json"))
    return Q.audit_counters(Q.audit_listings(rows, "main", ["a.example.org"]))


@query("e39_merge_query_labels", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ' | ') AS source_query, min(c_custkey) AS first_key FROM customer GROUP BY 1")
def _e39(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.array_join(F.array_sort(F.collect_set("c_mktsegment")), " | ").alias("source_query"), F.min("c_custkey").alias("first_key"))


@query("e40_evaluation_mae_table", f"""WITH {PREDICTIONS_SQL}
SELECT model_id AS candidate, dataset_split AS period, coalesce(flat_type, 'ALL') AS segment, count(*) AS n, round(avg(abs({_ERR})), 2) AS mae, round(sqrt(avg(power({_ERR}, 2))), 2) AS rmse, round(avg({_ERR}), 2) AS mean_bias
FROM predictions GROUP BY GROUPING SETS ((model_id, dataset_split), (model_id, dataset_split, flat_type))""")
def _e40(spark, sf):
    e = S.with_errors(predictions(spark, sf))
    e = e.select("model_id", "dataset_split", "error", "abs_error", F.explode(F.array(F.lit("ALL"), F.col("flat_type"))).alias("segment"))
    return e.groupBy(F.col("model_id").alias("candidate"), F.col("dataset_split").alias("period"), "segment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("abs_error"), 2).alias("mae"),
        F.round(F.sqrt(F.avg(F.col("error") * F.col("error"))), 2).alias("rmse"), F.round(F.avg("error"), 2).alias("mean_bias"))


@query("e41_flat_mix_argmax", """
SELECT s_suppkey, list_sort([{a: -(s_suppkey % 5), b: '1 ROOM'}, {a: -(s_suppkey % 7), b: '2 ROOM'}, {a: -(s_suppkey % 3), b: '3 ROOM'}])[1].b AS main_type,
 list_sort([{a: -(s_suppkey % 5), b: '1 ROOM'}, {a: -(s_suppkey % 7), b: '2 ROOM'}, {a: -(s_suppkey % 3), b: '3 ROOM'}])[2].b AS second_type FROM supplier""")
def _e41(spark, sf):
    from hearthframe.operators.places import flat_mix
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select("s_suppkey", (k % 5).alias("one"), (k % 7).alias("two"), (k % 3).alias("three"))
    mix = flat_mix({"1 ROOM": "one", "2 ROOM": "two", "3 ROOM": "three"})
    return s.select("s_suppkey", F.get(mix, 0)["flat_type"].alias("main_type"), F.get(mix, 1)["flat_type"].alias("second_type"))
