"""Publication in one step: old or new and never half, failures, conflicts, repeated updates, the clustered layout."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from hearthframe.sources import published as P
from hearthframe.sources.readers import bounded_read

SCHEMA = "model_id string, sale long, price double"


@pytest.fixture
def table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    return P.PublishedTable(spark, tempfile.mkdtemp(prefix="published-") + "/t", frame.schema, ["model_id"])


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def seen(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_replaces_keys_and_keeps_the_rest_where_it_is(spark, table):
    assert seen(table.read()) == []
    first = table.replace(rows(spark, ("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 5.0), (None, 1, 7.0)))
    second = table.replace(rows(spark, ("A", 3, 9.0)))
    assert seen(table.read()) == [("A", 3, 9.0), ("B", 1, 5.0), (None, 1, 7.0)]
    assert seen(table.read(first.number)) == [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 5.0), (None, 1, 7.0)]
    assert len(set(first.parts.values()) & set(second.parts.values())) == 2
    table.replace(rows(spark, ("A", 3, 9.0)))
    assert seen(table.read()) == [("A", 3, 9.0), ("B", 1, 5.0), (None, 1, 7.0)]
    table.replace(rows(spark), also=rows(spark, ("B", 0, 0.0)))
    assert seen(table.read()) == [("A", 3, 9.0), (None, 1, 7.0)]


def test_a_failed_job_leaves_the_old_table(spark, table):
    table.replace(rows(spark, ("A", 1, 1.0)))
    bad = rows(spark, ("A", 2, 2.0), ("A", 3, 3.0)).repartition(2).withColumn(
        "price", F.when(F.col("sale") == 3, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("price")))
    with pytest.raises(Exception, match="broken"):
        table.replace(bad)
    assert seen(table.read()) == [("A", 1, 1.0)] and table.version().number == 1


def test_readers_and_writers_between_data_and_manifest(spark, table):
    table.replace(rows(spark, ("A", 1, 1.0), ("B", 1, 5.0)))
    other, between = P.PublishedTable(spark, table.root, table.schema, ["model_id"]), []

    def meanwhile():
        between.append(seen(other.read()))
        if len(between) == 1:
            other.replace(rows(spark, ("B", 2, 6.0)))  # another key: no conflict
            other.replace(rows(spark, ("A", 1, 4.0)))  # the same key: the update is computed anew
    table.update(rows(spark, ("x", 1, 10.0)).select("sale", "price"), ["sale"], ["price"], F.col("model_id") == "A", before_commit=meanwhile)
    assert between == [[("A", 1, 1.0), ("B", 1, 5.0)], [("A", 1, 4.0), ("B", 2, 6.0)]]
    assert seen(table.read()) == [("A", 1, 10.0), ("B", 2, 6.0)]
    with pytest.raises(P.PublishConflict):
        table.update(rows(spark, ("x", 1, 11.0)).select("sale", "price"), ["sale"], ["price"], retries=0,
                     before_commit=lambda: other.replace(rows(spark, ("A", 1, 2.0))))
    assert seen(table.read()) == [("A", 1, 2.0), ("B", 2, 6.0)]


def test_updates_take_nulls_and_refuse_repeats(spark, table):
    table.replace(rows(spark, ("A", 1, 1.0), ("A", 2, 2.0), ("B", 3, 3.0)))
    before = table.version()
    table.update(rows(spark, ("x", 1, None), ("x", 9, 9.0)).select("sale", "price"), ["sale"], ["price"])
    assert seen(table.read()) == [("A", 1, None), ("A", 2, 2.0), ("B", 3, 3.0)]
    assert sum(table.version().parts[k] != v for k, v in before.parts.items()) == 1
    with pytest.raises(ValueError, match="more than one update"):
        table.update(rows(spark, ("x", 1, 1.0), ("y", 1, 2.0)).select("sale", "price"), ["sale"], ["price"])
    with pytest.raises(ValueError, match="key columns"):
        table.update(rows(spark, ("x", 1, 1.0)), ["sale"], ["model_id"])


def test_an_unfinished_manifest_is_not_read(spark, table):
    table.replace(rows(spark, ("A", 1, 1.0)))
    stream = table._fs.create(table._path(table._manifest(2)), False)
    assert seen(table.read()) == [("A", 1, 1.0)]
    with pytest.raises(P.PublishConflict):
        table._commit(table.version(), {}, set(), attempts=2)
    stream.close()


def test_bounded_reads_skip_partitions_and_files(spark):
    sales = spark.range(40_000).selectExpr(
        "concat('S', id) AS transaction_id", "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('T', id % 20) END AS town", "concat('F', id % 5) AS flat_type",
        "add_months(DATE '2000-01-01', CAST(id % 120 AS INT)) AS transaction_month", "CAST(id AS DOUBLE) AS resale_price")
    stored = P.clustered_write(sales, tempfile.mkdtemp(prefix="layout-") + "/t", ["town"], ["flat_type", "transaction_month"], files=30)
    read = bounded_read(stored, ["transaction_id", "resale_price"], "HOT", "F1", F.lit("2003-01-01").cast("date"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = read._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^]]*town[^]]*HOT", plan)
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(flat_type,F1\)", plan) and "LessThan(transaction_month" in plan
    every = stored.select(F.input_file_name()).distinct().count()
    one = read.select(F.input_file_name()).distinct().count()
    hot = stored.filter("town = 'HOT'").select(F.input_file_name()).distinct().count()
    assert one < hot < every and hot >= 8
    want = sales.filter("town = 'HOT' AND flat_type = 'F1' AND transaction_month < DATE '2003-01-01'")
    assert seen(read) == seen(want.select("transaction_id", "resale_price"))
