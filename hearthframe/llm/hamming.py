"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the sign bits of an embedding, cut into segments of `width` bits, each indexed by its value.
Round r probes every segment of an open query with all values that differ from its own in r bits,
verifies what it finds by full Hamming distance and keeps the k best. A code at distance
m (r + 1) - 1 or less differs in at most r bits in one of the m segments, so a query closes once its
k-th distance is covered by that. Equal codes are one index entry with its k smallest ids, and equal
queries are one search, so a vector that a third of all rows share costs no more than another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..session import materialise


def binary_codes(rows: DataFrame, width: int = 16) -> DataFrame:
    """(vec_id, code, segments) of rows with an id and an embedding; nulls and NaN inside count as bit 0."""
    @F.pandas_udf(ArrayType(LongType()))
    def words(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            bits = np.nan_to_num(np.array([np.nan if x is None else x for x in v], float)) > 0
            out.append(np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view(np.int64))
        return pd.Series(out, dtype=object)

    mask = F.lit((1 << width) - 1).cast("long")
    coded = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.size("embedding").alias("bits"), words("embedding").alias("code"))
    return coded.withColumn("segments", F.flatten(F.transform("code", lambda w: F.array(*(
        F.shiftrightunsigned(w, s).bitwiseAND(mask) for s in range(0, 64, width))))))


def distance(left: str, right: str):
    return F.aggregate(F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)


def fitting_width(rows: DataFrame) -> int:
    """Bits of a segment: log2 of the number of rows, 4 to 16, so that a value of a segment has about one code."""
    return min(16, max(4, rows.count().bit_length()))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, width: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance: the k rows of `rows` nearest to each row of `queries`, a query's own row included.

    Segments have `width` bits, by default `fitting_width`; the result does not depend on it. Ties go to the smaller id.
    Codes compare only with codes of as many bits. Rows or queries without an id or an embedding take no part; a repeated id
    counts once for each different code; fewer than k rows give fewer results.
    """
    width = width or fitting_width(rows)
    spark = rows.sparkSession
    coded = binary_codes(rows, width).select("bits", "code", "segments", "vec_id").distinct()
    few = Window.partitionBy("bits", "code").orderBy("vec_id")
    # The k smallest ids of each code: Spark applies the limit below the shuffle as well.
    members = coded.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k)
    codes = materialise(members.groupBy("bits", "code", "segments").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "hamming-codes")
    index = materialise(codes.select("bits", "code", "ids", F.posexplode("segments").alias("segment", "value")), "hamming-index")
    asked = materialise(binary_codes(queries, width).select(F.col("vec_id").alias("query_id"), "bits", "code", "segments").distinct(), "hamming-queries")
    open_ = asked.select("bits", "code", "segments").distinct().withColumn("query", F.xxhash64("bits", "code"))
    open_ = materialise(open_, "hamming-open")
    best, done = None, None
    order = Window.partitionBy("query").orderBy("distance", "id")
    for r in range(width + 1):
        if open_.isEmpty():
            break
        # One value in the plan, however many masks there are.
        masks = spark.range(1 << width).where(F.bit_count("id") == r).agg(F.collect_list("id").alias("masks")).scalar()
        probes = (open_.select("query", "bits", F.col("code").alias("asked"), F.posexplode("segments").alias("segment", "own"))
                  .select("query", "bits", "asked", "segment", "own", masks.alias("masks"))
                  .select("query", "bits", "asked", "segment", "own", F.explode("masks").alias("mask"))
                  .withColumn("value", F.col("own").bitwiseXOR(F.col("mask"))))
        # Spark takes exploded probes for as small as the queries they come from, so it must not choose to broadcast them.
        found = (probes.hint("merge").join(index, ["bits", "segment", "value"]).select("query", "ids", distance("asked", "code").alias("distance"))
                 .select("query", "distance", "ids").distinct())
        # Each code adds its smallest id first, so its k best codes hold the k best ids of a query.
        found = found.withColumn("id", F.col("ids")[0]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(
            "query", "distance", F.explode("ids").alias("id"))
        if best is not None:
            found = found.unionByName(best).distinct()
        best = materialise(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"), "hamming-best")
        reach = F.size("segments") * (r + 1) - 1
        last = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        closed = open_.join(last, "query").where((F.col("n") == k) & (F.col("last") <= reach) | (reach >= F.col("bits"))).select("query")
        finished = best.join(closed, "query", "left_semi")
        done = finished if done is None else done.unionByName(finished)
        open_ = materialise(open_.join(closed, "query", "left_anti"), "hamming-open")
        best = best.join(closed, "query", "left_anti")
    if done is None:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).alias("distance")).where("false")
    return (asked.withColumn("query", F.xxhash64("bits", "code")).select("query_id", "query").join(
        done.withColumn("rank", F.row_number().over(order)), "query")
        .select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance")))
