"""Scored candidates: the best search result per wanted key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe.functions import text as T


def address_score(block: Column, street: Column, found_block: Column, found_street: Column, latitude: Column) -> tuple[Column, Column]:
    """100 for the block, 50 for the street, 1 for having a point; both names equal is exact."""
    same_block = T.geocode_text(found_block) == T.geocode_text(block)
    same_street = T.geocode_text(found_street) == T.geocode_text(street)
    score = F.when(same_block, 100).otherwise(0) + F.when(same_street, 50).otherwise(0) + F.when(F.trim(latitude) != "", 1).otherwise(0)
    return score, F.when(same_block & same_street, "exact").otherwise("heuristic")


def facility_score(name: Column, postal: Column, found_name: Column, found_postal: Column, latitude: Column) -> Column:
    """200 for the postal code, 100 for the same name or 50 for containing it, 1 for a point."""
    n, f = T.geocode_text(name), T.geocode_text(found_name)
    return (F.when((T.geocode_text(postal) != "") & (T.geocode_text(found_postal) == T.geocode_text(postal)), 200).otherwise(0)
            + F.when(f == n, 100).when((n != "") & f.contains(n), 50).otherwise(0) + F.when(F.trim(latitude) != "", 1).otherwise(0))


def best_candidates(wanted: DataFrame, found: DataFrame, on: Sequence[str], key: str, candidate: str) -> DataFrame:
    """Highest score per key, then the smallest candidate id; keys without results are ``not_found``.

    Candidates with equal searched fields score alike, so they are reduced to the
    smallest id first and a crowded search term stays a handful of rows.
    """
    few = found.groupBy(*on, "f_block", "f_street", "f_lat").agg(F.min(candidate).alias(candidate))
    pairs = wanted.join(few, list(on), "left")
    score, status = address_score(F.col("block"), F.col("street"), F.col("f_block"), F.col("f_street"), F.col("f_lat"))
    scored = pairs.withColumn("score", score).withColumn("status", F.when(F.col(candidate).isNull(), "not_found").otherwise(status))
    order = F.struct((-F.col("score")).alias("a"), F.col(candidate).alias("b"))
    return scored.groupBy(key).agg(F.min_by(F.struct(candidate, "score", "status"), order).alias("x")).select(key, "x.*")
