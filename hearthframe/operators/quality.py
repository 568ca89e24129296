"""Row acceptance with reasons, gates and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe import constants as K
from hearthframe.functions import text as T

COPIES_PER_CHUNK = 100_000


class GateError(ValueError):
    """A build rule did not hold."""


def first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """Text of the first rule that is true; NULL when none is."""
    out = None
    for condition, reason in rules:
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out


def reason_list(rules: Sequence[tuple[Column, str]]) -> Column:
    """All true rules as an array, in rule order."""
    return F.array_compact(F.array(*[F.when(c, r) for c, r in rules]))


def split_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``) as two lazy views of one input."""
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def number_identical_rows(df: DataFrame) -> DataFrame:
    """Add ``occurrence`` 1..n among rows equal in every column.

    Equal rows cannot be told apart, so they are counted (map-side combined) and
    written out again from the count. A row repeated a billion times is split in
    chunks that are spread over tasks before they expand.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    chunk = F.lit(COPIES_PER_CHUNK)
    chunked = counted.withColumn(
        "__start", F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("__n") - 1) / chunk).cast("bigint"))))
    spread = chunked.hint("rebalance")
    low = F.col("__start") * chunk + 1
    high = F.least(F.col("__n"), (F.col("__start") + 1) * chunk)
    return spread.select(*columns, F.explode(F.sequence(low, high)).alias("occurrence"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the smallest by ``order``. An aggregate, so it combines before shuffling."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def gate_report(features: DataFrame, source: DataFrame, id_column: str, required: Sequence[str],
                split_column: str, splits: Sequence[str]) -> DataFrame:
    """One row of named counts; all ``*_bad`` columns must be zero."""
    distinct = features.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("duplicate_ids_bad"))
    checks = features.agg(
        F.count(F.lit(1)).alias("feature_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_null_bad") for c in required],
        *[F.count_if(F.col(split_column) == s).alias(f"{s}_rows") for s in splits])
    rows = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = checks.withColumn("source_rows", rows).withColumn("duplicate_ids_bad", distinct.scalar())
    empty = sum([(F.col(f"{s}_rows") == 0).cast("bigint") for s in splits], F.lit(0))
    return out.withColumn("row_count_bad", F.abs(F.col("source_rows") - F.col("feature_rows"))) \
        .withColumn("empty_split_bad", empty.cast("bigint"))


def enforce(report: DataFrame) -> None:
    """Raise GateError when a one-row report has a non-zero ``*_bad`` column."""
    row = report.first().asDict()
    broken = {k: v for k, v in row.items() if k.endswith("_bad") and v}
    if broken:
        raise GateError(f"build gates failed: {broken}")


def coverage_gap(expected: DataFrame, predictions: DataFrame, keys: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """One row: keys missing, keys unexpected, actual prices that moved."""
    e = expected.select(*keys, F.col("actual_price").alias("expected_price"), F.lit(1).alias("e"))
    p = predictions.select(*keys, "actual_price", F.lit(1).alias("p"))
    both = e.join(p, list(keys), "full_outer")
    return both.agg(
        F.count_if(F.col("p").isNull()).alias("missing"),
        F.count_if(F.col("e").isNull()).alias("unexpected"),
        F.count_if(F.abs(F.col("actual_price") - F.col("expected_price")) > tolerance).alias("changed"))


def audit_listings(df: DataFrame, site: str, hosts: list[str]) -> DataFrame:
    """Add ``changes`` (field to corrected value) and ``issues`` (for a person)."""
    ours = F.col("source_site") == site
    heading = F.coalesce(F.nullif(F.get_json_object("raw_card_json", "$.heading"), F.lit("")), F.col("project_name"), F.lit(""))
    address = F.trim(F.coalesce(F.col("address"), F.lit("")))
    done = T.complete_address(address, heading)
    located = done["address"].rlike(K.CARD_BLOCK)
    block = F.upper(F.regexp_extract(done["address"], K.CARD_BLOCK, 1))
    street = F.upper(F.trim(F.regexp_extract(done["address"], K.CARD_BLOCK, 2)))
    fixes = [
        ("title", F.trim(F.coalesce(F.col("title"), F.lit(""))).rlike(r"^\d+$"), F.lit("")),
        ("address", located & (done["address"] != address), done["address"]),
        ("block", located & (F.coalesce(F.col("block"), F.lit("")) != block), block),
        ("street", located & (F.coalesce(F.col("street"), F.lit("")) != street), street),
        ("project_name", located & done["used_heading"]
         & (F.trim(F.coalesce(F.col("project_name"), F.lit(""))) == F.trim(heading)), F.lit("")),
    ]
    entries = F.array_compact(F.array(*[
        F.when(ours & when, F.struct(F.lit(name).alias("k"), value.alias("v"))) for name, when, value in fixes]))
    issues = reason_list([
        (ours & ~F.coalesce(T.listing_id_from_url(F.col("listing_url"), hosts) == F.col("listing_id"), F.lit(False)),
         "listing_url_id_mismatch"),
        (~ours & (F.coalesce(F.col("listing_url"), F.lit("")) == ""), "missing_listing_url"),
        (F.coalesce(F.col("asking_price_sgd"), F.lit(0)) <= 0, "missing_or_invalid_price"),
        (F.coalesce(F.col("floor_area_sqft"), F.lit(0)) <= 0, "missing_or_invalid_area"),
        (ours & F.try_parse_json("raw_card_json").isNull(), "invalid_raw_card_json"),
        (ours & ~located, "unresolved_address"),
    ])
    return df.withColumn("changes", F.map_from_entries(entries)).withColumn("issues", issues)


def apply_changes(audited: DataFrame) -> DataFrame:
    """Write the proposed corrections; auditing the result again proposes nothing."""
    out = audited
    for name in ("title", "address", "block", "street", "project_name"):
        out = out.withColumn(name, F.coalesce(F.try_element_at("changes", F.lit(name)), F.col(name)))
    return out.drop("changes", "issues")


def audit_counters(audited: DataFrame) -> DataFrame:
    """(kind, name, n): rows to fix, fields to fix, issues to review."""
    kinds = F.array_union(
        F.transform(F.map_keys("changes"), lambda k: F.struct(F.lit("field").alias("kind"), k.alias("name"))),
        F.transform("issues", lambda i: F.struct(F.lit("issue").alias("kind"), i.alias("name"))))
    whole = F.when(F.size(F.map_keys("changes")) > 0, F.array(F.struct(F.lit("rows").alias("kind"), F.lit("to_fix").alias("name"))))
    everything = F.concat(kinds, F.coalesce(whole, F.array().cast("array<struct<kind:string,name:string>>")))
    return audited.select(F.inline(everything)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
