"""Source and sink queries (survey group A). Files go to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthframe.plans.registry import query
from hearthframe.session import new_path
from hearthframe.sources import readers as R
from hearthframe.sources import sinks as W
from hearthframe.sources.published import PublishedTable, clustered_write
from hearthframe.sources.tables import (
    SALES_SQL, SPLIT_SQL, blocks, raw_observations, sales, table, with_split, OBSERVATIONS_SQL, predictions, PREDICTIONS_SQL)


@query("a1_scan_csv_required", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def _a1(spark, sf):
    path = new_path(spark, "orders-csv")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.option("header", True).csv(path)
    return R.scan_csv(spark, path, ["o_orderkey", "o_orderstatus"]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("a2_csv_profile", """
SELECT o_orderpriority, n, rows, first, last, blank_status FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
 (SELECT count(*) AS rows, min(strftime(o_orderdate,'%Y-%m')) AS first, max(strftime(o_orderdate,'%Y-%m')) AS last,
   count(*) FILTER (o_orderstatus = 'P') AS blank_status FROM orders)""")
def _a2(spark, sf):
    o = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_orderstatus")).alias("status"))
    profile, groups = R.csv_profile(o, "month", "o_orderpriority")
    return groups.select("o_orderpriority", F.col("rows").alias("n"),
                         *[profile.select(c).scalar().alias(c) for c in ("rows", "first", "last", "blank_status")])


@query("a3_filtered_copy", f"WITH {SALES_SQL} SELECT transaction_id, town FROM sales WHERE town = 'TOWN 15' AND flat_type LIKE 'S%'")
def _a3(spark, sf):
    s = sales(spark, sf).select("transaction_id", "town", "flat_type")
    kept = W.filtered_copy(s, (F.col("town") == "TOWN 15") & F.col("flat_type").like("S%"), new_path(spark, "subset"))
    return kept.select("transaction_id", "town")


@query("a4_source_manifest")
def _a4(spark, sf):
    manifest = R.source_manifest(spark, [f"{sf}/{n}.parquet" for n in ("orders", "lineitem", "supplier")])
    return manifest.withColumn("run_id", R.build_run_id(manifest).scalar())


@query("a5_parquet_sink", f"WITH {SPLIT_SQL} SELECT dataset_split, count(*) AS n, min(month_no) AS first_month FROM split_sales GROUP BY 1")
def _a5(spark, sf):
    out = W.parquet_sink(with_split(sales(spark, sf)), new_path(spark, "features"), ["dataset_split"])
    return out.groupBy("dataset_split").agg(F.count(F.lit(1)).alias("n"), F.min("month_no").alias("first_month"))


@query("a6_csv_json_report_sink", "SELECT 'csv' AS kind, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'json', l_returnflag, l_linestatus, count(*) FROM lineitem GROUP BY ALL")
def _a6(spark, sf):
    report = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    csv, json = W.report_files(report, new_path(spark, "report"))
    a = spark.read.schema(report.schema).option("header", True).csv(csv).withColumn("kind", F.lit("csv"))
    b = spark.read.schema(report.schema).json(json).withColumn("kind", F.lit("json"))
    return a.unionByName(b)


@query("a7_inferred_reimport", f"WITH {PREDICTIONS_SQL} SELECT model_id, dataset_split, count(*) AS n FROM predictions GROUP BY ALL")
def _a7(spark, sf):
    # Nothing is inferred: the written table carries its schema.
    path = new_path(spark, "metrics")
    m = predictions(spark, sf).groupBy("model_id", "dataset_split").agg(F.count(F.lit(1)).alias("n"))
    m.write.parquet(path)
    return spark.read.schema(m.schema).parquet(path)


@query("a8_jsonl_latest_by_key", """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def _a8(spark, sf):
    path = new_path(spark, "log-json")
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", F.col("ts").cast("string").alias("ts"))
    e.write.json(path)
    return R.latest_json_records(spark, path, e.schema, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("a9_geojson_points", """
SELECT s_name AS name, 1.2::DOUBLE + (s_suppkey % 100) * 0.003::DOUBLE AS latitude, 103.6::DOUBLE + ((s_suppkey * 37) % 100) * 0.005::DOUBLE AS longitude
FROM supplier WHERE s_suppkey % 4 <> 3""")
def _a9(spark, sf):
    b = blocks(spark, sf).select("block_id", "block_name", "latitude", "longitude")
    bad = F.substring("block_id", 2, 20).cast("bigint") % 4 == 3

    def feature(lon):
        return F.struct(F.create_map(F.lit("name"), F.col("block_name")).alias("properties"),
                        F.struct(F.lit("Point").alias("type"), F.array(lon, F.col("latitude")).alias("coordinates")).alias("geometry"))
    docs = b.select(F.to_json(F.struct(F.array(feature(F.lit(0.0)), feature(F.when(bad, 0.0).otherwise(F.col("longitude")))).alias("features"))).alias("doc"))
    return R.geojson_points(docs, "doc").select(F.col("properties")["name"].alias("name"), "latitude", "longitude")


@query("a10_json_pages_import", f"""WITH {OBSERVATIONS_SQL},
ready AS (SELECT source_site, run_id FROM observations WHERE run_id <> 'W01' GROUP BY ALL HAVING count(DISTINCT page_number) = max(page_number))
SELECT source_site, run_id, listing_id, any_value(p) AS asking_price_sgd, any_value(np) AS pages FROM (
 SELECT o.*, first_value(asking_price_sgd) OVER (PARTITION BY source_site, run_id, listing_id ORDER BY page_number DESC, event_id DESC) AS p,
   count(DISTINCT page_number) OVER (PARTITION BY source_site, run_id, listing_id) AS np
 FROM observations o JOIN ready USING (source_site, run_id)) GROUP BY ALL""")
def _a10(spark, sf):
    path = new_path(spark, "pages-json")
    o = raw_observations(spark, sf)
    o.select("source_site", "run_id", F.col("page_number").cast("int").alias("page_number"), F.array(F.struct(
        "listing_id", "asking_price_sgd", F.col("event_id").alias("seq"))).alias("records")).write.json(path)
    loaded = o.filter("run_id = 'W01'").select("source_site", "run_id").distinct()
    out = R.import_pages(spark.read.schema(R.PAGE).json(path), loaded)
    return out.withColumn("pages", F.size("pages_seen").cast("bigint")).drop("pages_seen")


@query("a11_cross_store_projection", f"WITH {SALES_SQL} SELECT flat_type, count(*) AS n, max(resale_price) AS top_price FROM sales GROUP BY 1")
def _a11(spark, sf):
    other = W.parquet_sink(sales(spark, sf), new_path(spark, "store"))
    return other.select("flat_type", "resale_price").groupBy("flat_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("resale_price").alias("top_price"))


@query("a12_replace_by_key", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def _a12(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    new = o.filter("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.lit(0.0))
    orders = PublishedTable(spark, new_path(spark, "orders"), o.schema, ["o_orderpriority"])
    orders.replace(o)
    orders.replace(new)
    return orders.read().drop("o_orderpriority")


@query("a13_update_from", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(m, c_acctbal) ELSE c_acctbal END AS c_acctbal
FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _a13(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    u = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    customers = PublishedTable(spark, new_path(spark, "customers"), c.schema, ["c_mktsegment"])
    customers.replace(c)
    customers.update(u, ["c_custkey"], ["c_acctbal"], F.col("c_mktsegment") == "BUILDING")
    return customers.read().drop("c_mktsegment")


@query("a14_append_run_history", f"WITH {OBSERVATIONS_SQL} SELECT run_id, CASE WHEN run_id = 'W03' THEN count(*) * 10 ELSE count(*) END AS n FROM observations GROUP BY run_id")
def _a14(spark, sf):
    runs = raw_observations(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    current = runs.filter("run_id = 'W03'").withColumn("n", F.col("n") * 10)
    history = PublishedTable(spark, new_path(spark, "runs"), runs.schema, ["run_id"])
    history.replace(runs)
    history.replace(current)
    return history.read()


@query("a15_nested_evidence_sink", """
SELECT p_partkey, '[{"scenario":"low","point":' || p_size || '},{"scenario":"high","point":' || (p_size + 1) || '}]' AS scenarios FROM part""")
def _a15(spark, sf):
    p = table(spark, sf, "part")

    def item(name, value):
        return F.struct(F.lit(name).alias("scenario"), value.alias("point"))
    nested = p.select("p_partkey", F.array(item("low", F.col("p_size")), item("high", F.col("p_size") + 1)).alias("scenarios"))
    return W.nested_to_text(nested, "scenarios")


@query("a16_bounded_read_pushdown", f"WITH {SALES_SQL} SELECT transaction_id, resale_price FROM sales WHERE town='TOWN 16' AND flat_type='SMALL' AND transaction_month < DATE '1999-01-01'")
def _a16(spark, sf):
    rows = sales(spark, sf).select("transaction_id", "transaction_month", "town", "flat_type", "resale_price")
    stored = clustered_write(rows, new_path(spark, "sales-by-town"), ["town"], ["flat_type", "transaction_month"])
    return R.bounded_read(stored, ["transaction_id", "resale_price"], "TOWN 16", "SMALL", F.lit("1999-01-01").cast("date"))


@query("a17_dated_filter_builder", f"WITH {SALES_SQL} SELECT flat_type, count(*) AS n FROM sales WHERE flat_type IN ('SMALL','LARGE') AND transaction_month BETWEEN DATE '1997-01-01' AND DATE '1998-12-01' GROUP BY 1")
def _a17(spark, sf):
    keep = R.dated_filter(["SMALL", "LARGE"], F.lit("1997-01-01").cast("date"), F.lit("1998-12-01").cast("date"))
    return sales(spark, sf).filter(keep).groupBy("flat_type").agg(F.count(F.lit(1)).alias("n"))
