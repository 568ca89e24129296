"""Costly rows of small files are dealt over the cluster."""

from pyspark.sql import functions as F

from hearthframe.operators import finance as N
from hearthframe.plans import load_all
from hearthframe.plans.registry import QUERIES


def test_ceiling_of_a_small_file_is_dealt_over_tasks(spark):
    one = spark.range(50).coalesce(1).select("id", F.lit("hdb").alias("loan_type"), F.lit(25).alias("loan_years"), F.lit(2.6).alias("annual_rate_pct"),
                                             F.lit(90000.0).alias("cash_available"), F.lit(1500.0).alias("monthly_budget"))
    out = N.affordability_ceiling(one)
    assert out.rdd.getNumPartitions() >= 8
    assert out.select("ceiling_price").distinct().count() == 1 and out.count() == 50


def test_cards_of_a_small_file_are_dealt_over_tasks(spark, tmp_path):
    load_all()
    spark.range(40).select(F.col("id").alias("p_partkey"), F.lit("x y").alias("p_name"), F.lit("T").alias("p_type"), F.lit(3).alias("p_size")) \
        .coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = QUERIES["b26_card_text_extract"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= 8
    assert out.count() == 40
