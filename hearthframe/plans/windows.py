"""Window, ordering and set queries (survey groups F, G, H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthframe import constants as K
from hearthframe.operators import market as MK
from hearthframe.operators import ordered as O
from hearthframe.operators import quality as Q
from hearthframe.operators import snapshots as SN
from hearthframe.operators import stats as S
from hearthframe.operators.calibration import half_of
from hearthframe.operators.trends import rolling_past_features
from hearthframe.plans.joins import SEQ_SQL
from hearthframe.plans.registry import query
from hearthframe.sources.tables import (
    BLOCKS_SQL, LISTINGS_SQL, OBSERVATIONS_SQL, PREDICTIONS_SQL, SALES_SQL, SPLIT_SQL, blocks, listings, predictions,
    raw_observations, sales, table, with_split)


@query("f1_row_number_qualify", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _f1(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return Q.keep_first(o, ["o_custkey"], [-F.col("o_totalprice"), "o_orderkey"])


@query("f3_rolling_past_only", f"""WITH {SALES_SQL}, t AS (SELECT DISTINCT town, flat_type, month_no FROM sales),
j AS (SELECT t.*, h.resale_price / h.floor_area_sqm AS u, h.month_no >= t.month_no - 12 AS near FROM t JOIN sales h ON h.town = t.town AND h.flat_type = t.flat_type
   AND h.month_no < t.month_no AND h.month_no >= t.month_no - 24),
g AS (SELECT town, flat_type, month_no, count(*) FILTER (near) AS recent_count, CASE WHEN count(*) FILTER (near) >= 10 THEN quantile_cont(u, 0.5) FILTER (near) END AS recent,
   CASE WHEN count(*) FILTER (NOT near) >= 10 THEN quantile_cont(u, 0.5) FILTER (NOT near) END AS previous FROM j GROUP BY ALL)
SELECT t.town, t.flat_type, t.month_no, coalesce(recent_count, 0) AS recent_count, round(recent, 8) AS recent_unit_price,
  round(CASE WHEN previous > 0 THEN 100 * (recent / previous - 1) END, 6) AS change_pct FROM t LEFT JOIN g USING (town, flat_type, month_no)""")
def _f3(spark, sf):
    r = rolling_past_features(sales(spark, sf))
    return r.select("town", "flat_type", "month_no", "recent_count", F.round("recent_unit_price", 8).alias("recent_unit_price"), F.round("change_pct", 6).alias("change_pct"))


@query("f4_window_totals", f"""WITH {SALES_SQL} SELECT block_id, n, count(*) OVER () AS blocks, sum(n) OVER () AS sales FROM (SELECT block_id, count(*) AS n FROM sales GROUP BY 1) ORDER BY n DESC, block_id LIMIT 50""")
def _f4(spark, sf):
    b = sales(spark, sf).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    totals = b.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("sales"))
    top = b.orderBy(F.desc("n"), "block_id").limit(50)
    return top.select("block_id", "n", totals.select("blocks").scalar().alias("blocks"), totals.select("sales").scalar().alias("sales"))


@query("f5_run_sequence", f"WITH {SEQ_SQL} SELECT source_site, run_id, seq AS snapshot_sequence FROM runs")
def _f5(spark, sf):
    return SN.run_sequence(listings(spark, sf)).select("source_site", "run_id", "snapshot_sequence")


@query("f6_positional_scenarios", f"""WITH {SALES_SQL}, {BLOCKS_SQL},
b AS (SELECT DISTINCT block_id, flat_type, storey_range, max(storey_midpoint) OVER (PARTITION BY block_id, flat_type, storey_range) AS mid FROM sales JOIN blocks USING (block_id) WHERE storey_midpoint <= max_floor_lvl),
r AS (SELECT *, row_number() OVER (PARTITION BY block_id, flat_type ORDER BY mid, storey_range) - 1 AS i, count(*) OVER (PARTITION BY block_id, flat_type) AS n FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY block_id, flat_type ORDER BY i) AS pos FROM r WHERE i IN (0, n // 2, n - 1))
SELECT block_id, flat_type, CASE pos WHEN 1 THEN 'low' WHEN 2 THEN 'middle' ELSE 'high' END AS scenario, storey_range, mid AS storey_midpoint FROM k""")
def _f6(spark, sf):
    return MK.storey_scenarios(blocks(spark, sf), sales(spark, sf))


@query("f8_month_half_split", f"""WITH {SPLIT_SQL}, m AS (SELECT DISTINCT month_no FROM split_sales WHERE dataset_split = 'validation'), r AS (SELECT month_no, row_number() OVER (ORDER BY month_no) - 1 AS i, count(*) OVER () AS n FROM m)
SELECT month_no, CASE WHEN i >= n // 2 THEN 'late' ELSE 'early' END AS half FROM r""")
def _f8(spark, sf):
    return half_of(with_split(sales(spark, sf)).filter("dataset_split = 'validation'"))


@query("g1_hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 8000")
def _g1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.sha2(F.col("o_orderkey").cast("string"), 256), "o_orderkey").limit(K.SCATTER_SAMPLE)


@query("g2_top_n_blocks", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 3000")
def _g2(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(K.MAP_BLOCKS)


@query("g3_latest_n", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def _g3(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(K.TABLE_ROWS)


@query("g4_shortlist_order", """SELECT c_custkey AS listing_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'investigate' ELSE 'watch' END AS opportunity_label, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS ranking_score
FROM customer ORDER BY c_mktsegment <> 'BUILDING', coalesce(nullif(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END, 0), -1) DESC, c_custkey LIMIT 50""")
def _g4(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("listing_id"), F.when(F.col("c_mktsegment") == "BUILDING", "investigate").otherwise("watch").alias("opportunity_label"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("ranking_score"))
    return c.orderBy(*MK.shortlist_order()).limit(K.SHORTLIST)


@query("g5_association_order", f"""WITH {SALES_SQL},
a AS (SELECT 'floor_area_sqm' AS c, corr(rank_x, rank_y) AS rho, NULL::DOUBLE AS eta FROM (SELECT rank() OVER (ORDER BY floor_area_sqm) + (count(*) OVER (PARTITION BY floor_area_sqm)-1)/2.0::DOUBLE AS rank_x,
   rank() OVER (ORDER BY resale_price) + (count(*) OVER (PARTITION BY resale_price)-1)/2.0::DOUBLE AS rank_y FROM sales)
 UNION ALL SELECT 'month_no', corr(rank_x, rank_y), NULL FROM (SELECT rank() OVER (ORDER BY month_no) + (count(*) OVER (PARTITION BY month_no)-1)/2.0::DOUBLE AS rank_x,
   rank() OVER (ORDER BY resale_price) + (count(*) OVER (PARTITION BY resale_price)-1)/2.0::DOUBLE AS rank_y FROM sales)
 UNION ALL SELECT 'flat_type', NULL, (SELECT sum(n*(m-gm)*(m-gm))/any_value(sst) FROM (SELECT count(*) n, avg(resale_price) m FROM sales GROUP BY flat_type), (SELECT avg(resale_price) gm, var_pop(resale_price)*count(*) sst FROM sales))
 UNION ALL SELECT 'town', NULL, (SELECT sum(n*(m-gm)*(m-gm))/any_value(sst) FROM (SELECT count(*) n, avg(resale_price) m FROM sales GROUP BY town), (SELECT avg(resale_price) gm, var_pop(resale_price)*count(*) sst FROM sales))
 UNION ALL SELECT 'transaction_id', NULL, NULL)
SELECT row_number() OVER (ORDER BY CASE WHEN rho IS NOT NULL THEN 0 WHEN eta IS NOT NULL THEN 1 ELSE 2 END, coalesce(abs(rho), eta, 0) DESC, c) AS position, c AS "column", round(rho, 6) AS spearman_rho, round(eta, 6) AS eta_squared FROM a""")
def _g5(spark, sf):
    a = S.association_profile(sales(spark, sf), ["floor_area_sqm", "month_no"], ["flat_type", "town"], ["transaction_id"], "resale_price", "flat_type")
    # The report holds one row per column of the table, so this window is a handful of rows.
    w = Window.orderBy(*S.association_order())
    return a.select(F.row_number().over(w).alias("position"), "column", "spearman_rho", "eta_squared")


@query("g6_top_contributions", """
SELECT p_partkey, array_to_string(list_transform(list_sort([{x: -(p_size - 25.0::DOUBLE), n: 'size'}, {x: -(p_retailprice - 950), n: 'price'}, {x: -(p_partkey % 9 - 4.0::DOUBLE), n: 'key'}]), lambda e: e.n), ',') AS ordered FROM part""")
def _g6(spark, sf):
    from hearthframe.operators.models import top_contributions
    p = table(spark, sf, "part")
    parts = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in (
        ("size", F.col("p_size") - 25.0), ("price", F.col("p_retailprice") - 950), ("key", F.col("p_partkey") % 9 - 4.0))])
    ends = top_contributions(parts, 5)
    zero = F.filter(parts, lambda x: x["value"] == 0)
    both = F.concat(F.transform(ends["positive"], lambda x: x["name"]), F.array_sort(F.transform(zero, lambda x: x["name"])),
                    F.reverse(F.transform(ends["negative"], lambda x: x["name"])))
    return p.select("p_partkey", F.array_join(both, ",").alias("ordered"))


@query("g7_argmin_model", f"""WITH {PREDICTIONS_SQL} SELECT model_id FROM (SELECT model_id, avg(abs(predicted_price - actual_price)) AS mae FROM predictions WHERE dataset_split = 'validation' GROUP BY 1) ORDER BY mae, model_id LIMIT 1""")
def _g7(spark, sf):
    e = S.with_errors(predictions(spark, sf).filter("dataset_split = 'validation'")).groupBy("model_id").agg(F.avg("abs_error").alias("mae"))
    return e.agg(F.min_by("model_id", F.struct("mae", "model_id")).alias("model_id"))


@query("g8_ordered_nulls_last", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score FROM customer ORDER BY score DESC NULLS LAST, c_custkey")
def _g8(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("score"))
    return c.orderBy(F.desc_nulls_last("score"), "c_custkey")


@query("h1_union_all", "SELECT 'orders' AS source, o_custkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer")
def _h1(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(F.lit("orders").alias("source"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return a.unionByName(b)


@query("h2_union_categories", "SELECT category, count(*) AS n FROM (SELECT c_mktsegment AS category FROM customer UNION ALL SELECT source FROM documents) WHERE category LIKE '%B%' OR category LIKE 'w%' GROUP BY 1")
def _h2(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("category"))
    b = table(spark, sf, "documents").select(F.col("source").alias("category"))
    u = a.unionByName(b)
    return u.filter(F.col("category").contains("B") | F.col("category").startswith("w")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("h3_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _h3(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti").distinct()


@query("h4_distinct_project", "SELECT DISTINCT p_type, p_brand FROM part")
def _h4(spark, sf):
    return table(spark, sf, "part").select("p_type", "p_brand").distinct()


@query("h5_dedupe_seen", """SELECT o_custkey, o_orderpriority, rn FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) AS rn FROM orders GROUP BY o_custkey, o_orderpriority) WHERE rn <= 5""")
def _h5(spark, sf):
    first = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_key"))
    w = Window.partitionBy("o_custkey").orderBy("first_key")
    return first.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").drop("first_key")
