"""The driver's parquet tables and the property-market views over them.

Each view exists twice with one meaning: as a DataFrame for Spark and as a SQL
common table expression for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthframe import constants as K


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def latitude_of(key):
    return F.lit(1.20) + F.pmod(key, F.lit(100)) * F.lit(0.003)


def longitude_of(key):
    return F.lit(103.60) + F.pmod(key * 37, F.lit(100)) * F.lit(0.005)


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sale. The id spells out the row's content, so it is stable."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice")
    supp = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    joined = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    lease_year = F.lit(1960) + F.pmod(F.col("l_partkey"), F.lit(60))
    month_no = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    band = F.lit(1) + F.lit(3) * F.floor((F.col("p_size") - 1) / 3)
    return joined.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            F.round(F.col("l_discount") * 100).cast("bigint"), F.round(F.col("l_tax") * 100).cast("bigint"),
            F.date_format("l_shipdate", "yyyyMMdd")).alias("transaction_id"),
        month.alias("transaction_month"),
        month_no.cast("int").alias("month_no"),
        F.concat(F.lit("B"), F.col("l_suppkey")).alias("block_id"),
        F.concat(F.lit("TOWN "), F.col("s_nationkey")).alias("town"),
        F.col("p_type").alias("flat_type"), F.col("p_brand").alias("flat_model"),
        F.col("l_quantity").alias("floor_area_sqm"),
        F.col("p_size").cast("double").alias("storey_midpoint"),
        F.concat(F.lpad(band.cast("string"), 2, "0"), F.lit(" TO "),
                 F.lpad((band + 2).cast("string"), 2, "0")).alias("storey_range"),
        lease_year.cast("int").alias("lease_commence_year"),
        (F.lit(K.LEASE_TERM_MONTHS) - (month_no - (lease_year * 12 + 1))).cast("int").alias("remaining_lease_months"),
        latitude_of(F.col("l_suppkey")).alias("latitude"),
        longitude_of(F.col("l_suppkey")).alias("longitude"),
        F.col("l_extendedprice").alias("resale_price"),
        F.col("p_retailprice").alias("unit_reference_price"),
    )


SALES_SQL = """
sales AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
                   CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT),
                   CAST(round(l_tax * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS transaction_id,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS transaction_month,
         CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS month_no,
         'B' || l_suppkey AS block_id, 'TOWN ' || s_nationkey AS town,
         p_type AS flat_type, p_brand AS flat_model, l_quantity AS floor_area_sqm,
         CAST(p_size AS DOUBLE) AS storey_midpoint,
         lpad(CAST(1 + 3 * ((p_size - 1) // 3) AS VARCHAR), 2, '0') || ' TO '
           || lpad(CAST(3 + 3 * ((p_size - 1) // 3) AS VARCHAR), 2, '0') AS storey_range,
         CAST(1960 + l_partkey % 60 AS INTEGER) AS lease_commence_year,
         CAST(1188 - (year(l_shipdate) * 12 + month(l_shipdate) - ((1960 + l_partkey % 60) * 12 + 1)) AS INTEGER)
           AS remaining_lease_months,
         CAST(1.20 AS DOUBLE) + (l_suppkey % 100) * CAST(0.003 AS DOUBLE) AS latitude,
         CAST(103.60 AS DOUBLE) + ((l_suppkey * 37) % 100) * CAST(0.005 AS DOUBLE) AS longitude,
         l_extendedprice AS resale_price, p_retailprice AS unit_reference_price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def with_split(df: DataFrame) -> DataFrame:
    """Last 12 months are test, the 12 before validation, the rest train."""
    last = df.agg(F.max("month_no").alias("m")).scalar()
    age = last - F.col("month_no")
    return df.withColumn(
        "dataset_split",
        F.when(age < K.TEST_MONTHS, "test").when(age < K.VALIDATION_MONTHS, "validation").otherwise("train"))


SPLIT_SQL = SALES_SQL + """,
split_sales AS (
  SELECT *, CASE WHEN (SELECT max(month_no) FROM sales) - month_no < 12 THEN 'test'
                 WHEN (SELECT max(month_no) FROM sales) - month_no < 24 THEN 'validation'
                 ELSE 'train' END AS dataset_split
  FROM sales
)"""

# Constant price factors standing in for two models' predictions.
MODEL_FACTORS = (("MODEL_A", 1.9), ("MODEL_B", 2.1))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(model, sale) rows on the two later splits with a formula-made prediction."""
    base = with_split(sales(spark, sf)).filter(F.col("dataset_split").isin("validation", "test"))
    models = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(f).alias("factor")) for m, f in MODEL_FACTORS])
    exploded = base.select("*", F.inline(models))
    predicted = F.col("floor_area_sqm") * F.col("unit_reference_price") * F.col("factor")
    return exploded.withColumn("predicted_price", predicted).withColumnRenamed("resale_price", "actual_price") \
        .withColumn("lower_estimate", F.col("predicted_price") * 0.8) \
        .withColumn("upper_estimate", F.col("predicted_price") * 1.25).drop("factor")


PREDICTIONS_SQL = SPLIT_SQL + """,
predictions AS (
  SELECT s.* EXCLUDE (resale_price), s.resale_price AS actual_price, m.model_id,
         floor_area_sqm * unit_reference_price * m.factor AS predicted_price,
         floor_area_sqm * unit_reference_price * m.factor * CAST(0.8 AS DOUBLE) AS lower_estimate,
         floor_area_sqm * unit_reference_price * m.factor * CAST(1.25 AS DOUBLE) AS upper_estimate
  FROM split_sales s, (VALUES ('MODEL_A', CAST(1.9 AS DOUBLE)), ('MODEL_B', CAST(2.1 AS DOUBLE))) m(model_id, factor)
  WHERE dataset_split IN ('validation', 'test')
)"""


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Building dimension: one row per supplier."""
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("B"), key).alias("block_id"), F.col("s_name").alias("block_name"),
        F.concat(F.lit("TOWN "), F.col("s_nationkey")).alias("town"),
        latitude_of(key).alias("latitude"), longitude_of(key).alias("longitude"),
        (F.lit(20) + F.pmod(key, F.lit(31))).cast("int").alias("max_floor_lvl"),
        (F.lit(1960) + F.pmod(key, F.lit(50))).cast("int").alias("year_completed"),
        F.col("s_acctbal").alias("balance"))


BLOCKS_SQL = """
blocks AS (
  SELECT 'B' || s_suppkey AS block_id, s_name AS block_name, 'TOWN ' || s_nationkey AS town,
         CAST(1.20 AS DOUBLE) + (s_suppkey % 100) * CAST(0.003 AS DOUBLE) AS latitude,
         CAST(103.60 AS DOUBLE) + ((s_suppkey * 37) % 100) * CAST(0.005 AS DOUBLE) AS longitude,
         CAST(20 + s_suppkey % 31 AS INTEGER) AS max_floor_lvl,
         CAST(1960 + s_suppkey % 50 AS INTEGER) AS year_completed, s_acctbal AS balance
  FROM supplier
)"""


def facilities(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("facility_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"),
        (latitude_of(key) + 0.0011).alias("latitude"), (longitude_of(key) + 0.0017).alias("longitude"))


FACILITIES_SQL = """
facilities AS (
  SELECT c_custkey AS facility_id, c_name AS name, c_mktsegment AS category,
         CAST(1.20 AS DOUBLE) + (c_custkey % 100) * CAST(0.003 AS DOUBLE) + CAST(0.0011 AS DOUBLE) AS latitude,
         CAST(103.60 AS DOUBLE) + ((c_custkey * 37) % 100) * CAST(0.005 AS DOUBLE) + CAST(0.0017 AS DOUBLE) AS longitude
  FROM customer
)"""


def raw_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Listing card observations: (site, ISO-week run, listing) may repeat across pages."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("source_site"),
        F.concat(F.lit("W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0")).alias("run_id"),
        F.col("user_id").alias("listing_id"), F.col("event_id"),
        F.col("value").alias("asking_price_sgd"), F.col("ts").alias("observed_at"),
        (F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(8)) + 1).alias("page_number"))


OBSERVATIONS_SQL = """
observations AS (
  SELECT event_type AS source_site, 'W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS run_id,
         user_id AS listing_id, event_id, value AS asking_price_sgd, ts AS observed_at,
         CAST(json_extract(props, '$.k') AS INTEGER) % 8 + 1 AS page_number
  FROM events
)"""


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Merged snapshot rows: the latest card of a (site, run, listing) wins."""
    from hearthframe.operators.snapshots import merge_cards
    return merge_cards(raw_observations(spark, sf))


LISTINGS_SQL = OBSERVATIONS_SQL + """,
listings AS (
  SELECT source_site, run_id, listing_id, first_seen, last_seen, asking_price_sgd, pages_seen FROM (
    SELECT source_site, run_id, listing_id, asking_price_sgd,
           min(observed_at) OVER w AS first_seen, max(observed_at) OVER w AS last_seen,
           list_sort(list_distinct(list(page_number) OVER w)) AS pages_seen,
           row_number() OVER (PARTITION BY source_site, run_id, listing_id ORDER BY observed_at DESC, event_id DESC) AS rn
    FROM observations WINDOW w AS (PARTITION BY source_site, run_id, listing_id)
  ) WHERE rn = 1
)"""
