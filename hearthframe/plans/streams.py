"""Streaming queries (survey group L); each must equal its batch counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthframe.operators.snapshots import run_sequence
from hearthframe.plans.joins import SEQ_SQL
from hearthframe.plans.registry import query
from hearthframe.session import materialise, new_path
from hearthframe.sources.tables import LISTINGS_SQL, OBSERVATIONS_SQL, listings, raw_observations
from hearthframe.streaming import pages as P


def observation_stream(spark, sf):
    """The observations as files that arrive one by one."""
    path = new_path(spark, "arrivals")
    o = raw_observations(spark, sf).withColumn("page_number", F.col("page_number").cast("int"))
    o.write.parquet(path)
    return spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(path)


def timed_stream(spark, sf, slices=5, rows_per_file=50_000):
    """The observations as they were made, one slice of time after the other, each in equally many files read as one batch."""
    o = raw_observations(spark, sf).withColumn("page_number", F.col("page_number").cast("int"))
    path, staged = new_path(spark, "arrivals"), materialise(o, "observations")
    ends = staged.selectExpr("min(observed_at) AS a", "max(observed_at) AS b").first()
    span = (ends["b"] - ends["a"]) / slices
    parts = []
    for i in range(slices):
        part = staged.filter(F.col("observed_at") >= ends["a"] + i * span)
        parts.append(part if i == slices - 1 else part.filter(F.col("observed_at") < ends["a"] + (i + 1) * span))
    # Every file must hold rows, else it is not written and a batch would reach into the next slice.
    files = max(1, min(part.count() for part in parts) // rows_per_file)
    for part in parts:
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(o.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("l1_page_ingest_stream", f"WITH {LISTINGS_SQL} SELECT source_site, run_id, listing_id, first_seen, last_seen, asking_price_sgd, array_to_string(pages_seen, ',') AS pages FROM listings")
def _l1(spark, sf):
    merged = P.ingest_stream(observation_stream(spark, sf), spark)
    return merged.withColumn("pages", F.array_join(F.col("pages_seen").cast("array<string>"), ",")).drop("pages_seen")


@query("l2_run_progress_stream", f"""WITH {OBSERVATIONS_SQL} SELECT source_site, run_id, count(DISTINCT page_number) AS saved_pages, 10 - count(DISTINCT page_number) AS missing_pages,
  count(DISTINCT listing_id) AS unique_listing_ids, CASE WHEN count(DISTINCT page_number) = 10 THEN 'complete' ELSE 'partial' END AS status FROM observations GROUP BY 1, 2""")
def _l2(spark, sf):
    return P.progress_stream(timed_stream(spark, sf), spark, 10)


@query("l3_change_stream", f"WITH {SEQ_SQL} SELECT * FROM changes")
def _l3(spark, sf):
    return P.change_stream(timed_stream(spark, sf), spark, run_sequence(listings(spark, sf)))
