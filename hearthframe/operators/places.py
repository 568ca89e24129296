"""Stations and building mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def station_centroids(exits: DataFrame) -> DataFrame:
    """Mean point, exit count, distinct exit codes and rail type of each station."""
    light = F.concat(F.lit(" "), F.upper("full_name"), F.lit(" ")).contains(" LRT ")
    return exits.groupBy("station").agg(
        F.count(F.lit(1)).alias("exits"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
        F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("exit_code"), F.lit("")))), ",").alias("exit_codes"),
        F.when(F.bool_or(light), "LRT").otherwise("MRT").alias("rail_type"))


def flat_mix(counts: dict[str, str]) -> Column:
    """Types of a building from its wide count columns, most common first, ties by name."""
    entries = F.array(*[F.struct((-F.coalesce(F.col(c), F.lit(0))).alias("less"), F.lit(t).alias("flat_type")) for t, c in counts.items()])
    return F.array_sort(entries)
