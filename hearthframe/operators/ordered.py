"""Exact order statistics without putting a whole group in one task.

Everything ranked, cumulated or taken as a quantile goes through
``cumulative``: rows are first combined to distinct (key, value) cells on the
map side, each cell falls in a bucket of a monotone function of its value, and
the running total is the bucket's offset plus a running sum inside the bucket.
A key that holds a third of the table is thereby spread over its buckets, and
the only per-key window runs over the (few thousand at most) bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthframe.session import materialise

GROUP_RESOLUTION = 512   # large groups: buckets about 0.2 % wide
TARGET_RESOLUTION = 8    # many small groups: buckets about 13 % wide


def value_bucket(value: Column, resolution: int) -> Column:
    """Monotone non-decreasing bucket number (log1p is semi-monotonic on the JVM); NaN sorts last and has the last one."""
    number = value.cast("double")
    bucket = F.floor(F.signum(number) * F.log1p(F.abs(number)) * F.lit(float(resolution)))
    return F.when(F.isnan(number), F.lit(2 ** 62)).otherwise(bucket)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may hold NULL; the left side's keys are kept."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
    condition = None
    for key in keys:
        part = left[key].eqNullSafe(renamed[f"__r_{key}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])


def cumulative(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None,
               resolution: int = GROUP_RESOLUTION) -> DataFrame:
    """keys, ``v`` (distinct value), ``w``, ``upto`` (running weight), ``total``."""
    keys = list(keys)
    mass = F.count(F.lit(1)) if weight is None else F.sum(weight)
    # A struct compares equal field by field, NULLs included, so one packed key
    # serves the aggregates, the window and the join without extra exchanges.
    packed = F.struct(*keys) if keys else F.lit(1)
    cells = (
        df.filter(F.col(value).isNotNull())
        .select(packed.alias("__k"), value_bucket(F.col(value), resolution).alias("__b"), F.col(value).alias("v"),
                *([] if weight is None else [weight.alias("__m")]))
        .groupBy("__k", "__b", "v").agg((mass if weight is None else F.sum("__m")).alias("w"))
    )
    by_bucket = cells.groupBy("__k", "__b").agg(F.sum("w").alias("__bw"))
    per_key = Window.partitionBy("__k")
    running = per_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    offsets = by_bucket.select(
        "__k", "__b", (F.sum("__bw").over(running) - F.col("__bw")).alias("__before"),
        F.sum("__bw").over(per_key).alias("total"))
    inside = Window.partitionBy("__k", "__b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ran = cells.withColumn("__in", F.sum("w").over(inside))
    out = ran.join(offsets, ["__k", "__b"]).withColumn("upto", F.col("__before") + F.col("__in"))
    return out.select(*[F.col(f"__k.{k}").alias(k) for k in keys], "v", "w", "upto", "total")


def small_cumulative(df: DataFrame, keys: Sequence[str], value: str, weight: Column) -> DataFrame:
    """The same for keys of few rows: windows by key, which need no shuffle where the rows of a key are together."""
    per_key = Window.partitionBy(*keys)
    by_value = per_key.orderBy("v")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), weight.alias("__m"))
    return rows.select(*keys, "v", F.sum("__m").over(by_value.rangeBetween(Window.currentRow, Window.currentRow)).alias("w"),
                       F.sum("__m").over(by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
                       F.sum("__m").over(per_key).alias("total"))


def _pick(cells: DataFrame, keys: Sequence[str], wanted: list[tuple[str, Column]], count_as: str | None) -> DataFrame:
    """Value at each 1-based position; only covering cells reach the last shuffle."""
    first = F.col("upto") - F.col("w") + 1
    covers = [(name, (position >= first) & (position <= F.col("upto"))) for name, position in wanted]
    any_cover = covers[0][1]
    for _, cover in covers[1:]:
        any_cover = any_cover | cover
    aggs = [F.max(F.when(cover, F.col("v"))).alias(name) for name, cover in covers]
    if count_as:
        aggs.append(F.max("total").alias(count_as))
    return cells.filter(any_cover).groupBy(*keys).agg(*aggs)


def near_cells(df: DataFrame, keys: Sequence[str], value: str, wanted: list[tuple[str, Column]], resolution: int = GROUP_RESOLUTION) -> DataFrame:
    """Rows of ``cumulative`` in the buckets that hold one of the 1-based positions ``wanted``.

    Buckets are counted first, which combines on the map side; then only rows of the buckets found are shuffled. ``df`` is
    read twice.
    """
    packed = F.struct(*keys) if keys else F.lit(1)
    rows = df.filter(F.col(value).isNotNull()).select(
        packed.alias("__k"), value_bucket(F.col(value), resolution).alias("__b"), F.col(value).alias("v"))
    per_key = Window.partitionBy("__k")
    running = per_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("w")).select(
        "__k", "__b", "w", F.sum("w").over(running).alias("upto"), F.sum("w").over(per_key).alias("total"))
    covers = F.lit(False)
    for _, position in wanted:
        covers = covers | ((position > F.col("upto") - F.col("w")) & (position <= F.col("upto")))
    held = materialise(counts.filter(covers).select("__k", "__b", (F.col("upto") - F.col("w")).alias("__before"), "total"), "buckets")
    close = rows.join(held, ["__k", "__b"]).groupBy("__k", "__b", "__before", "total", "v").agg(F.count(F.lit(1)).alias("w"))
    inside = Window.partitionBy("__k", "__b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    out = close.withColumn("upto", F.col("__before") + F.sum("w").over(inside))
    return out.select(*[F.col(f"__k.{k}").alias(k) for k in keys], "v", "w", "upto", "total")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              count: Column | None = None, count_as: str | None = None,
              resolution: int = GROUP_RESOLUTION, small: bool = False, reread: bool = False) -> DataFrame:
    """Linear-interpolated quantiles, one column per entry of ``probs``; ``small`` where every key has few rows.

    ``reread`` where many rows of few keys are cheap to read twice; not with ``count``.
    """
    wanted: list[tuple[str, Column]] = []
    for name, p in probs.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        wanted += [(f"__lo_{name}", F.floor(at) + 1), (f"__hi_{name}", F.ceil(at) + 1)]
    if small:
        cells = small_cumulative(df, keys, value, F.lit(1) if count is None else count)
    elif reread and count is None:
        cells = near_cells(df, keys, value, wanted, resolution)
    else:
        cells = cumulative(df, keys, value, count, resolution)
    picked = _pick(cells, keys, wanted, "__n")
    outputs = []
    for name, p in probs.items():
        at = (F.col("__n") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        outputs.append((low + (high - low) * (at - F.floor(at))).alias(name))
    extra = [F.col("__n").alias(count_as)] if count_as else []
    return picked.select(*keys, *outputs, *extra)


def finite_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                     count_as: str | None = None, resolution: int = GROUP_RESOLUTION, reread: bool = False) -> DataFrame:
    """Finite-sample order statistic: the value at rank ceil((n+1)p), clipped to 1..n."""
    wanted = [
        (name, F.least(F.col("total"), F.greatest(F.lit(1), F.ceil((F.col("total") + 1) * F.lit(float(p))))))
        for name, p in probs.items()
    ]
    cells = near_cells(df, keys, value, wanted, resolution) if reread else cumulative(df, keys, value, None, resolution)
    return _pick(cells, keys, wanted, count_as)


def step_marks(probs: dict[str, float]) -> list[tuple[str, Column]]:
    """Marks of the cell where the running weight first reaches p x total."""
    return [
        (name, (F.col("upto") >= F.col("total") * F.lit(float(p)))
         & (F.col("upto") - F.col("w") < F.col("total") * F.lit(float(p))))
        for name, p in probs.items()
    ]


def step_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: Column, probs: dict[str, float],
                   resolution: int = TARGET_RESOLUTION) -> DataFrame:
    """Weighted step quantile: smallest value whose running weight reaches p x total."""
    marks = step_marks(probs)
    anything = marks[0][1]
    for _, mark in marks[1:]:
        anything = anything | mark
    return cumulative(df, keys, value, weight, resolution).filter(anything).groupBy(*keys).agg(
        *[F.min(F.when(mark, F.col("v"))).alias(name) for name, mark in marks])


def average_rank_cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, ``v``, ``avg_rank`` with ties sharing the mean of their positions."""
    cells = cumulative(df, keys, value)
    return cells.select(*keys, "v", (F.col("upto") - (F.col("w") - 1) / F.lit(2.0)).alias("avg_rank"))
