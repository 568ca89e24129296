"""Join queries (survey group D, without the comparable tiers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthframe.functions import text as T
from hearthframe.operators import lookups as L
from hearthframe.operators import market as K
from hearthframe.operators import quality as Q
from hearthframe.operators import repeat_sales as RS
from hearthframe.operators import snapshots as SN
from hearthframe.operators import spatial as SP
from hearthframe.operators import stats as S
from hearthframe.plans.registry import query
from hearthframe.plans.scalars import sql_haversine
from hearthframe.sources.tables import (
    BLOCKS_SQL, FACILITIES_SQL, LISTINGS_SQL, PREDICTIONS_SQL, SALES_SQL, SPLIT_SQL, blocks, facilities, listings,
    predictions, sales, table, with_split)


@query("d1_feature_star_join", f"""WITH {SALES_SQL}, {BLOCKS_SQL}
SELECT transaction_id, b.block_name, max_floor_lvl, year_completed, n.n_name FROM sales s JOIN blocks b USING (block_id)
JOIN supplier p ON 'B' || p.s_suppkey = s.block_id JOIN nation n ON n_nationkey = s_nationkey""")
def _d1(spark, sf):
    b = blocks(spark, sf).select("block_id", "block_name", "max_floor_lvl", "year_completed")
    s = table(spark, sf, "supplier").select(F.concat(F.lit("B"), "s_suppkey").alias("block_id"), "s_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return sales(spark, sf).select("transaction_id", "block_id").join(b, "block_id").join(s, "block_id").join(n, "s_nationkey") \
        .select("transaction_id", "block_name", "max_floor_lvl", "year_completed", "n_name")


@query("d2_conform_lookup", """
SELECT l_suppkey, s_name, count(*) AS n FROM lineitem LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 2000) ON s_suppkey = l_suppkey GROUP BY ALL""")
def _d2(spark, sf):
    dim = table(spark, sf, "supplier").filter("s_acctbal > 2000").select(F.concat(F.lit(" b "), "s_suppkey").alias("raw"), "s_name")
    dim = dim.select(T.normalise(F.col("raw")).alias("key"), "s_name")
    li = table(spark, sf, "lineitem").select("l_suppkey").withColumn("key", T.normalise(F.concat(F.lit("B  "), "l_suppkey")))
    return L.conform(li, dim, "key", "key", "s_name").groupBy("l_suppkey", "s_name").agg(F.count(F.lit(1)).alias("n"))


@query("d3_nearest_and_within", f"""WITH {BLOCKS_SQL}, {FACILITIES_SQL},
d AS (SELECT b.block_id, f.category, {sql_haversine('b.latitude', 'b.longitude', 'f.latitude', 'f.longitude')} AS m FROM blocks b, facilities f)
SELECT block_id, category, round(min(m), 1) AS nearest_m, count(*) FILTER (m <= 1000) AS within_radius FROM d GROUP BY ALL""")
def _d3(spark, sf):
    return SP.nearest_and_within(blocks(spark, sf), facilities(spark, sf))


_DIM = """dim AS (SELECT s_suppkey, 'B' || s_suppkey AS block_id, CAST(s_suppkey % 40 AS VARCHAR) AS nb,
  CASE s_suppkey % 3 WHEN 0 THEN 'ELM STREET' ELSE 'OAK ROAD' END AS ns FROM supplier),
lst AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(c_custkey % 120 AS VARCHAR) END AS nb,
  CASE c_custkey % 3 WHEN 0 THEN 'ELM STREET' ELSE 'OAK ROAD' END AS ns FROM customer)"""


@query("d7_address_match", f"""WITH {_DIM},
e AS (SELECT nb, ns, count(*) n, min(block_id) id FROM dim GROUP BY ALL), u AS (SELECT nb, count(*) n, min(block_id) id FROM dim GROUP BY ALL),
x AS (SELECT c_custkey, lst.nb, CASE WHEN lst.nb = '' THEN 0 ELSE coalesce(e.n, 0) END AS ne, e.id AS eid, coalesce(u.n, 0) AS nu, u.id AS uid
  FROM lst LEFT JOIN e ON e.nb = lst.nb AND e.ns = lst.ns LEFT JOIN u ON u.nb = lst.nb)
SELECT c_custkey, CASE WHEN ne = 1 THEN eid WHEN ne = 0 AND nb <> '' AND nu = 1 THEN uid END AS block_id,
  CASE WHEN ne = 1 OR (ne = 0 AND nb <> '' AND nu = 1) THEN 'matched' WHEN ne > 1 THEN 'ambiguous' ELSE 'unmatched' END AS match_status,
  CASE WHEN ne = 0 AND nb <> '' AND nu = 1 THEN 1 ELSE ne END AS candidate_count FROM x""")
def _d7(spark, sf):
    k = F.col("s_suppkey")
    dim = table(spark, sf, "supplier").select(F.concat(F.lit("B"), k).alias("block_id"), (k % 40).cast("string").alias("block"),
                                              F.when(k % 3 == 0, "Elm St").otherwise("Oak Rd.").alias("street"))
    c = F.col("c_custkey")
    lst = table(spark, sf, "customer").select("c_custkey", F.when(c % 11 == 0, "").otherwise((c % 120).cast("string")).alias("block"),
                                              F.when(c % 3 == 0, "elm street").otherwise("OAK  RD").alias("street"))
    return K.match_address(lst, dim).select("c_custkey", "block_id", "match_status", "candidate_count")


@query("d8_repeat_sale_pairs", f"""WITH {SALES_SQL.replace("'B' || l_suppkey AS block_id", "'B' || (l_suppkey % 10) AS block_id")},
c AS (SELECT b.transaction_id AS base_id, h AS horizon_years, f.transaction_id AS future_id, b.month_no AS base_month, f.month_no AS future_month,
  b.resale_price AS base_price, f.resale_price AS future_price, abs(f.month_no - b.month_no - 12*h) AS mg, abs(b.floor_area_sqm - f.floor_area_sqm) AS ag,
  abs(b.storey_midpoint - f.storey_midpoint) AS sg FROM sales b JOIN sales f ON f.block_id = b.block_id AND f.flat_type = b.flat_type AND f.flat_model = b.flat_model
  AND f.month_no > b.month_no AND abs(f.floor_area_sqm - b.floor_area_sqm) <= 5 AND abs(f.storey_midpoint - b.storey_midpoint) <= 3, (VALUES (1),(3),(5)) v(h)
  WHERE abs(f.month_no - b.month_no - 12*h) <= 3)
SELECT base_id, horizon_years, future_id, base_month, future_month, base_price, future_price FROM c
QUALIFY row_number() OVER (PARTITION BY base_id, horizon_years ORDER BY mg, ag, sg, future_month, future_id) = 1""")
def _d8(spark, sf):
    return RS.repeat_sale_pairs(grouped_sales(spark, sf))


def grouped_sales(spark, sf):
    """Sales with ten large buildings, so that repeat pairs exist."""
    s = sales(spark, sf)
    return s.withColumn("block_id", F.concat(F.lit("B"), F.substring("block_id", 2, 20).cast("bigint") % 10))


SEQ_SQL = LISTINGS_SQL + """,
runs AS (SELECT source_site, run_id, row_number() OVER (PARTITION BY source_site ORDER BY max(last_seen), run_id) AS seq FROM listings GROUP BY source_site, run_id),
seqd AS (SELECT l.*, seq FROM listings l JOIN runs USING (source_site, run_id)),
changes AS (SELECT a.source_site, a.run_id, a.listing_id, a.seq AS snapshot_sequence, a.asking_price_sgd, b.asking_price_sgd AS previous_asking_price_sgd,
  a.asking_price_sgd - b.asking_price_sgd AS price_change_sgd, CASE WHEN b.listing_id IS NULL THEN 'new' WHEN a.asking_price_sgd < b.asking_price_sgd THEN 'price_reduced'
  WHEN a.asking_price_sgd > b.asking_price_sgd THEN 'price_increased' ELSE 'unchanged' END AS change_type
  FROM seqd a LEFT JOIN seqd b ON b.source_site = a.source_site AND b.listing_id = a.listing_id AND b.seq = a.seq - 1)"""


@query("d9_snapshot_diff", f"WITH {SEQ_SQL} SELECT * FROM changes")
def _d9(spark, sf):
    return SN.snapshot_changes(listings(spark, sf)).drop("observed_at")


LATEST_SQL = """
complete AS (SELECT source_site, run_id, max(last_seen) AS observed FROM (SELECT *, unnest(pages_seen) AS p FROM listings) GROUP BY 1, 2 HAVING count(DISTINCT p) = 8),
latest AS (SELECT source_site, run_id FROM complete QUALIFY row_number() OVER (PARTITION BY source_site ORDER BY observed DESC, run_id DESC) = 1)"""


@query("d10_ranking_inputs", f"""WITH {SEQ_SQL}, {LATEST_SQL}
SELECT source_site, run_id, l.listing_id, l.asking_price_sgd, c.change_type, cu.c_mktsegment FROM listings l JOIN latest USING (source_site, run_id)
JOIN changes c USING (source_site, run_id, listing_id) JOIN customer cu ON cu.c_custkey = l.listing_id""")
def _d10(spark, sf):
    rows = listings(spark, sf)
    latest = SN.latest_complete_runs(rows.withColumn("total_pages", F.lit(8))).select("source_site", "run_id")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("listing_id"), "c_mktsegment")
    return SN.ranking_inputs(rows, latest, c)


@query("d11_rules_cross_join", """
SELECT o_orderkey, o_totalprice * (1 + 8.0::DOUBLE / 100) AS upper_margin, o_totalprice * (1 - 5.0::DOUBLE / 100) AS lower_margin FROM orders""")
def _d11(spark, sf):
    # A one-row rules table becomes scalar subqueries, not a product.
    rules = spark.range(1).select(F.lit(8.0).alias("above"), F.lit(5.0).alias("below"))
    above, below = (rules.select(c).scalar() for c in ("above", "below"))
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * (1 + above / 100)).alias("upper_margin"),
                                             (F.col("o_totalprice") * (1 - below / 100)).alias("lower_margin"))


@query("d12_detail_view_join", f"""WITH {SALES_SQL}, {BLOCKS_SQL}, top AS (SELECT block_id, flat_type, count(*) AS sales_count, max(resale_price) AS top_price FROM sales GROUP BY ALL)
SELECT t.*, b.latitude, b.longitude, b.max_floor_lvl FROM top t JOIN blocks b USING (block_id)""")
def _d12(spark, sf):
    top = sales(spark, sf).groupBy("block_id", "flat_type").agg(F.count(F.lit(1)).alias("sales_count"), F.max("resale_price").alias("top_price"))
    return top.join(blocks(spark, sf).select("block_id", "latitude", "longitude", "max_floor_lvl"), "block_id")


@query("d13_lateral_json_unnest", """
SELECT o_orderkey, s AS scenario, o_custkey + c AS comparable_id FROM orders, (VALUES ('low', 1), ('low', 2), ('high', 1), ('high', 2)) v(s, c)""")
def _d13(spark, sf):
    comps = "array<struct<comparable_id:bigint>>"
    o = table(spark, sf, "orders")
    pair = F.array(*[F.struct((F.col("o_custkey") + i).alias("comparable_id")) for i in (1, 2)])
    text = o.select("o_orderkey", F.to_json(F.array(*[F.struct(F.lit(n).alias("scenario"), pair.alias("comparables")) for n in ("low", "high")])).alias("j"))
    first = text.select("o_orderkey", F.inline(F.from_json("j", f"array<struct<scenario:string,comparables:{comps}>>")))
    return first.select("o_orderkey", "scenario", F.inline("comparables"))


@query("d14_registry_left_join", f"""WITH {PREDICTIONS_SQL}
SELECT p.model_id, coalesce(r.name, p.model_id) AS model_name, dataset_split, count(*) AS n FROM predictions p
LEFT JOIN (VALUES ('MODEL_A', 'Model A')) r(model_id, name) ON r.model_id = p.model_id GROUP BY ALL""")
def _d14(spark, sf):
    m = predictions(spark, sf).groupBy("model_id", "dataset_split").agg(F.count(F.lit(1)).alias("n"))
    registry = spark.range(1).select(F.lit("MODEL_A").alias("model_id"), F.lit("Model A").alias("name"))
    return m.join(registry, "model_id", "left").select("model_id", F.coalesce("name", "model_id").alias("model_name"), "dataset_split", "n")


@query("d15_block_points_join", f"""WITH {SALES_SQL}, {BLOCKS_SQL}
SELECT block_id, b.latitude, b.longitude, n FROM (SELECT block_id, count(*) AS n FROM sales WHERE flat_type = 'SMALL' GROUP BY 1) JOIN blocks b USING (block_id)""")
def _d15(spark, sf):
    n = sales(spark, sf).filter("flat_type = 'SMALL'").groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    b = blocks(spark, sf).filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("block_id", "latitude", "longitude")
    return n.join(b, "block_id").select("block_id", "latitude", "longitude", "n")


_REQ2 = """req AS (SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 4 = 0 THEN 'B' || s_suppkey ELSE 'X' END AS block_id,
  CASE WHEN s_suppkey % 4 IN (0, 1) THEN 'TOWN ' || s_nationkey ELSE 'Y' END AS town,
  CASE WHEN s_suppkey % 2 = 0 THEN 'SMALL' ELSE 'PROMO' END AS flat_type, (s_suppkey % 60)::DOUBLE AS area, s_suppkey FROM supplier)"""


def _requests(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("request_id"), F.when(k % 4 == 0, F.concat(F.lit("B"), k)).otherwise("X").alias("block_id"),
        F.when(k % 4 <= 1, F.concat(F.lit("TOWN "), "s_nationkey")).otherwise("Y").alias("town"),
        F.when(k % 2 == 0, "SMALL").otherwise("PROMO").alias("flat_type"), (k % 60).cast("double").alias("area"))


@query("d16_scope_fallback_join", f"""WITH {SALES_SQL}, {_REQ2},
b AS (SELECT block_id, flat_type, quantile_cont(floor_area_sqm, 0.5) m FROM sales WHERE month_no < 24000 GROUP BY ALL),
t AS (SELECT town, flat_type, quantile_cont(floor_area_sqm, 0.5) m FROM sales WHERE month_no < 24000 GROUP BY ALL),
a AS (SELECT flat_type, quantile_cont(floor_area_sqm, 0.5) m FROM sales WHERE month_no < 24000 GROUP BY ALL)
SELECT request_id, coalesce(b.m, t.m, a.m) AS median_area, CASE WHEN b.m IS NOT NULL THEN 'same block' WHEN t.m IS NOT NULL THEN 'same town' ELSE 'nationwide' END AS area_scope
FROM req LEFT JOIN b USING (block_id, flat_type) LEFT JOIN t ON t.town = req.town AND t.flat_type = req.flat_type LEFT JOIN a ON a.flat_type = req.flat_type""")
def _d16(spark, sf):
    out = K.typical_area(_requests(spark, sf), sales(spark, sf).filter("month_no < 24000"))
    return out.select("request_id", "median_area", "area_scope")


@query("d17_infer_category_nearest_median", f"""WITH {SALES_SQL}, {_REQ2},
b AS (SELECT block_id, flat_type, quantile_cont(floor_area_sqm, 0.5) m FROM sales GROUP BY ALL),
t AS (SELECT town, flat_type, quantile_cont(floor_area_sqm, 0.5) m FROM sales GROUP BY ALL),
a AS (SELECT flat_type, quantile_cont(floor_area_sqm, 0.5) m FROM sales GROUP BY ALL),
c AS (SELECT request_id, area, b.flat_type AS ft, b.m, 'same_block_area' AS how FROM req JOIN b USING (block_id)
 UNION ALL SELECT request_id, area, t.flat_type, t.m, 'same_town_area' FROM req JOIN t USING (town) WHERE req.block_id NOT IN (SELECT block_id FROM b)
 UNION ALL SELECT request_id, area, a.flat_type, a.m, 'national_area' FROM req, a WHERE req.block_id NOT IN (SELECT block_id FROM b) AND req.town NOT IN (SELECT town FROM t)),
k AS (SELECT *, abs(area - m) AS gap FROM c QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY abs(area - m), ft, m) = 1)
SELECT request_id, CASE WHEN area <> 0 AND gap <= greatest(8.0::DOUBLE, m * 0.12::DOUBLE) THEN ft END AS inferred_flat_type,
  CASE WHEN area = 0 THEN 'missing_floor_area' WHEN gap <= greatest(8.0::DOUBLE, m * 0.12::DOUBLE) THEN how ELSE 'area_outside_observed_types' END AS inference_method FROM k""")
def _d17(spark, sf):
    r = _requests(spark, sf).withColumn("floor_area_sqm", F.col("area")).drop("flat_type")
    return K.infer_flat_type(r, sales(spark, sf)).select("request_id", "inferred_flat_type", "inference_method")


@query("d18_nearest_group", f"""WITH {SALES_SQL}, {_REQ2},
q AS (SELECT request_id, flat_type, 1.25::DOUBLE + (request_id % 10) * 0.01::DOUBLE AS la, 103.7::DOUBLE + (request_id % 7) * 0.01::DOUBLE AS lo FROM req),
g AS (SELECT request_id, s.town, round(min((s.latitude-la)*(s.latitude-la) + (s.longitude-lo)*(s.longitude-lo)), 12) AS d, count(*) AS n FROM q JOIN sales s USING (flat_type) GROUP BY ALL)
SELECT request_id, town, n AS sales FROM g QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY d, n DESC, town) = 1""")
def _d18(spark, sf):
    r = _requests(spark, sf).select("request_id", "flat_type", (F.lit(1.25) + F.col("request_id") % 10 * 0.01).alias("latitude"),
                                    (F.lit(103.7) + F.col("request_id") % 7 * 0.01).alias("longitude"))
    return SP.nearest_town(r, sales(spark, sf))


@query("d19_reuse_unchanged", """
SELECT n.c_custkey, n.c_mktsegment = CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END AND c_custkey % 6 <> 0 AS reused,
  CASE WHEN c_mktsegment = CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END AND c_custkey % 6 <> 0 THEN c_acctbal - 1000 END AS asking_delta FROM customer n""")
def _d19(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    k = F.col("c_custkey")
    before = c.filter(k % 6 != 0).select("c_custkey", F.when(k % 4 == 0, "X").otherwise(F.col("c_mktsegment")).alias("was"),
                                         F.lit("M1").alias("model_id"), F.lit(1).alias("month"), F.lit(1000.0).alias("point"))
    x = c.join(before, "c_custkey", "left")
    same = K.reusable(F.col("model_id"), "M1", F.col("month"), F.lit(1), [(F.col("was"), F.col("c_mktsegment"))])
    return x.select("c_custkey", same.alias("reused"), F.when(same, F.col("c_acctbal") - F.col("point")).alias("asking_delta"))


@query("d20_dedupe_compute_fanout", f"""WITH {SALES_SQL}
SELECT transaction_id, n FROM sales JOIN (SELECT town, flat_type, count(*) AS n FROM sales GROUP BY ALL) USING (town, flat_type)""")
def _d20(spark, sf):
    s = sales(spark, sf)
    counts = s.groupBy("town", "flat_type").agg(F.count(F.lit(1)).alias("n"))
    return K.compute_once(s.select("transaction_id", "town", "flat_type"), ["town", "flat_type"],
                          lambda d: d.join(counts, ["town", "flat_type"]), ["n"]).select("transaction_id", "n")


@query("d21_candidate_scoring", """
SELECT s_suppkey, c_custkey, score, status FROM (SELECT s_suppkey, c_custkey, 100 * CAST(c_custkey % 10 = s_suppkey % 10 AS INT) + 50 * CAST(c_custkey % 4 = s_suppkey % 4 AS INT)
  + CAST(c_acctbal > 0 AS INT) AS score, CASE WHEN c_custkey % 10 = s_suppkey % 10 AND c_custkey % 4 = s_suppkey % 4 THEN 'exact' ELSE 'heuristic' END AS status
 FROM supplier JOIN customer ON c_nationkey = s_nationkey) QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) = 1""")
def _d21(spark, sf):
    from hearthframe.operators.matching import best_candidates
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    wanted = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", (s % 10).cast("string").alias("block"), F.concat(F.lit("Rd "), s % 4).alias("street"))
    found = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"), (c % 10).cast("string").alias("f_block"),
                                                F.concat(F.lit("ROAD "), c % 4).alias("f_street"), F.when(F.col("c_acctbal") > 0, "1.3").otherwise("").alias("f_lat"))
    return best_candidates(wanted, found, ["s_nationkey"], "s_suppkey", "c_custkey")


@query("d22_incremental_worklist", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _d22(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    cache = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("failed"))
    return c.join(cache.filter("NOT failed"), "c_custkey", "left_anti")


@query("d23_paired_prediction_join", f"""WITH {PREDICTIONS_SQL}
SELECT a.dataset_split, count(*) AS sales, round(avg(abs(a.predicted_price - a.actual_price)), 4) AS a_mae, round(avg(abs(b.predicted_price - a.actual_price)), 4) AS b_mae
FROM predictions a JOIN predictions b ON a.transaction_id = b.transaction_id AND a.dataset_split = b.dataset_split WHERE a.model_id = 'MODEL_A' AND b.model_id = 'MODEL_B' GROUP BY 1""")
def _d23(spark, sf):
    x = paired(predictions(spark, sf)).groupBy("dataset_split").agg(
        F.count(F.lit(1)).alias("sales"), F.round(F.avg(F.abs(F.col("old_price") - F.col("actual_price"))), 4).alias("a_mae"),
        F.round(F.avg(F.abs(F.col("new_price") - F.col("actual_price"))), 4).alias("b_mae"))
    return x


def paired(p, old="MODEL_A", new="MODEL_B"):
    """One row per sale carrying both models' prices."""
    a = p.filter(F.col("model_id") == old).withColumnRenamed("predicted_price", "old_price").drop("model_id", "lower_estimate", "upper_estimate")
    b = p.filter(F.col("model_id") == new).select("dataset_split", "transaction_id", F.col("predicted_price").alias("new_price"))
    return a.join(b, ["dataset_split", "transaction_id"])


@query("d24_tier_evidence_join", f"""WITH {PREDICTIONS_SQL}, n AS (SELECT town, flat_type, count(*) AS c FROM sales GROUP BY ALL)
SELECT model_id, CASE WHEN c < 480 THEN 'thin' ELSE 'thick' END AS evidence, count(*) AS n FROM predictions JOIN n USING (town, flat_type) GROUP BY ALL""")
def _d24(spark, sf):
    n = sales(spark, sf).groupBy("town", "flat_type").agg(F.count(F.lit(1)).alias("c"))
    return predictions(spark, sf).join(n, ["town", "flat_type"]).groupBy("model_id", F.when(F.col("c") < 480, "thin").otherwise("thick").alias("evidence")) \
        .agg(F.count(F.lit(1)).alias("n"))
