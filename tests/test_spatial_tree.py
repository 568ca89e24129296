"""The tree of cells against all distances: remote and near points, dense places, the date line, ties."""

import random

from hearthframe.operators import spatial as SP
from pyspark.sql import functions as F


def everywhere(spark, wanted, targets):
    from hearthframe.functions import measures as M
    t = targets.select("category", F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    return {(r.category, r.latitude, r.longitude): r.d for r in wanted.join(t, "category").withColumn(
        "d", M.haversine_m(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b"))).groupBy("category", "latitude", "longitude").agg(F.min("d").alias("d")).collect()}


def test_tree_equals_all_distances(spark):
    rng = random.Random(4)
    spots = [("A", 1.3 + rng.gauss(0, .02), 103.8 + rng.gauss(0, .02)) for _ in range(800)] + [("A", -89.5, 10.0), ("A", 0.0, -179.9), ("B", 50.0, 8.0)]
    asked = [("A", rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)] + [("A", 0.0, 179.95), ("A", 1.3, 103.8), ("B", -50.0, -172.0), ("A", 90.0, 0.0)]
    t = spark.createDataFrame(spots, "category string, latitude double, longitude double")
    w = spark.createDataFrame(asked, "category string, latitude double, longitude double")
    got = {(r.category, r.latitude, r.longitude): r.nearest for r in SP.tree_nearest(w, t).collect()}
    want = everywhere(spark, w, t)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_a_remote_block_opens_few_cells(spark, monkeypatch):
    rows, real = [], SP.materialise

    def counting(df, name):
        out = real(df, name)
        rows.append((name, out.count()))
        return out
    monkeypatch.setattr(SP, "materialise", counting)
    blocks = spark.createDataFrame([("far", -40.0, 20.0)], "block_id string, latitude double, longitude double")
    shops = spark.range(100_000).selectExpr("id AS facility_id", "concat('n', id) AS name", "'SHOP' AS category",
                                            "1.2 + (id % 317) * 0.0007 AS latitude", "103.6 + (id % 331) * 0.0009 AS longitude")
    got = SP.nearest_and_within(blocks, shops).first()
    searched = sum(n for name, n in rows if name.startswith("tree"))
    points = spark.createDataFrame([("SHOP", -40.0, 20.0)], "category string, latitude double, longitude double")
    want = everywhere(spark, points, shops)
    assert abs(got["nearest_m"] - round(list(want.values())[0], 1)) < 0.11 and got["within_radius"] == 0
    assert searched < 1_000
