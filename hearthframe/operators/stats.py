"""Aggregations: error metrics, associations, market summaries, bins, quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe import constants as K
from hearthframe.functions import measures as M
from hearthframe.operators import ordered as O
from hearthframe.session import materialise

SORTED_ROWS = 20_000


def training_quartiles(train: DataFrame, value: str) -> tuple[Column, Column, Column]:
    """Three scalar-subquery cut points, exact."""
    cuts = O.quantiles(train, [], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return tuple(cuts.select(name).scalar() for name in ("q1", "q2", "q3"))


def with_errors(predictions: DataFrame) -> DataFrame:
    error = F.col("predicted_price") - F.col("actual_price")
    return (
        predictions.withColumn("error", error).withColumn("abs_error", F.abs(error))
        .withColumn("ape", F.try_divide(F.abs(error), F.nullif(F.col("actual_price"), F.lit(0.0))) * 100)
    )


def covered() -> Column:
    return F.col("actual_price").between(F.col("lower_estimate"), F.col("upper_estimate"))


def join_quantiles(aggregated: DataFrame, source: DataFrame, keys: Sequence[str], value: str,
                   probs: dict[str, float], finite: bool = False) -> DataFrame:
    pick = O.finite_quantiles if finite else O.quantiles
    return O.null_safe_join(aggregated, pick(source, keys, value, probs, reread=True), keys)


def baseline_metrics(predictions: DataFrame, keys: Sequence[str] = ("model_id", "dataset_split")) -> DataFrame:
    """Count, mean and median absolute and percentage error, share of actuals inside the range."""
    e = with_errors(predictions)
    means = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prediction_count"), F.avg("abs_error").alias("mean_absolute_error"),
        F.avg("ape").alias("mean_absolute_percentage_error"),
        (F.avg(covered().cast("double")) * 100).alias("interquartile_range_coverage_pct"))
    out = join_quantiles(means, e, keys, "abs_error", {"median_absolute_error": 0.5})
    return join_quantiles(out, e, keys, "ape", {"median_absolute_percentage_error": 0.5})


def evaluation_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds RMSE, R squared, bias, coverage and width over rows that carry bounds."""
    e = with_errors(predictions)
    bounded = F.col("lower_estimate").isNotNull() & F.col("upper_estimate").isNotNull()
    out = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prediction_count"), F.avg("abs_error").alias("mae"), F.avg("ape").alias("mape_pct"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(F.col("error") * F.col("error")),
                                   F.nullif(F.var_pop("actual_price") * F.count(F.lit(1)), F.lit(0.0)))).alias("r_squared"),
        F.avg("error").alias("mean_bias"),
        (F.avg(F.when(bounded, covered().cast("double"))) * 100).alias("interval_coverage_pct"),
        F.avg(F.when(bounded, F.col("upper_estimate") - F.col("lower_estimate"))).alias("mean_interval_width"))
    out = join_quantiles(out, e, keys, "abs_error", {"median_absolute_error": 0.5})
    return join_quantiles(out, e, keys, "ape", {"median_ape_pct": 0.5})


def segment_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per segment: error averages plus the finite-sample 90th percentile of the absolute error."""
    e = with_errors(predictions)
    out = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prediction_count"), F.avg("abs_error").alias("mae"),
        F.avg("ape").alias("mape_pct"), F.avg("error").alias("mean_bias"),
        (F.avg(covered().cast("double")) * 100).alias("interval_coverage_pct"),
        F.avg(F.col("upper_estimate") - F.col("lower_estimate")).alias("mean_interval_width"))
    return join_quantiles(out, e, keys, "abs_error", {"p90_absolute_error": 0.9}, finite=True)


def stack_dimensions(df: DataFrame, dimensions: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per (row, dimension): ``dimension`` and ``group`` beside the kept columns."""
    entries = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("group"))
                        for n, c in dimensions.items()])
    return df.select(*keep, F.inline(entries))


def reliability(segments: DataFrame, reference_mae: Column, min_group: int = K.MIN_GROUP_SIZE) -> DataFrame:
    ratio = F.try_divide(F.col("mae"), reference_mae)
    return segments.withColumn("mae_vs_selected", ratio).withColumn(
        "reliability_status",
        F.when(F.col("prediction_count") < min_group, "too_few_to_judge")
        .when(ratio >= K.WATCH_RATIO, "higher_error_watch").otherwise("within_overall_range"))


# Associations ---------------------------------------------------------------

def _pair(df: DataFrame, x: str, y: str) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    return df.filter(both)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson from moments; NULL for fewer than two rows or no variance."""
    n = F.count(F.lit(1))
    top = F.covar_pop(x, y)
    bottom = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(n >= 2, F.try_divide(top, F.nullif(bottom, F.lit(0.0))))


def pearson(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    pair = _pair(df, x, y)
    return pair.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson_r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson of average ranks. Ranks belong to distinct values, so no window sees all rows."""
    pair = _pair(df, x, y).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w"))
    rx = O.cumulative(pair, [], "x", F.col("w"))
    ry = O.cumulative(pair, [], "y", F.col("w"))

    def ranks(cells: DataFrame, name: str) -> DataFrame:
        return cells.select(F.col("v").alias(name), (F.col("upto") - (F.col("w") - 1) / F.lit(2.0)).alias(f"r{name}"))
    ranked = pair.join(ranks(rx, "x"), "x").join(ranks(ry, "y"), "y")
    # Weighted moments centred on the exact mean rank (n+1)/2.
    n = pair.agg(F.sum("w").alias("n")).scalar()
    centre = (n + 1) / F.lit(2.0)
    dx, dy, w = F.col("rx") - centre, F.col("ry") - centre, F.col("w")
    return ranked.agg(
        F.sum("w").alias("n"),
        F.try_divide(F.sum(w * dx * dy), F.nullif(F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy)), F.lit(0.0))).alias("spearman_rho"))


def eta_squared(df: DataFrame, category: str, value: str) -> DataFrame:
    """Between-group share of the total sum of squares; a missing category is its own group."""
    g = df.filter(F.col(value).isNotNull()).groupBy(F.coalesce(F.col(category).cast("string"), F.lit("<missing>")).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    means = g.agg(grand.alias("gm")).scalar()
    between = F.sum(F.col("n") * (F.col("m") - means) * (F.col("m") - means))
    within = F.sum(F.col("n") * F.col("v"))
    return g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
                 F.try_divide(between, F.nullif(between + within, F.lit(0.0))).alias("eta_squared"))


def within_group_pearson(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Pearson after removing group means, from per-group moments in two small aggregates."""
    pair = _pair(df, x, y)
    n = F.count(F.lit(1))
    m = pair.groupBy(group).agg(
        n.alias("n"), (F.covar_pop(x, y) * n).alias("sxy"), (F.var_pop(x) * n).alias("sxx"), (F.var_pop(y) * n).alias("syy"))
    return m.agg(F.sum("n").alias("n"), F.try_divide(
        F.sum("sxy"), F.nullif(F.sqrt(F.sum("sxx") * F.sum("syy")), F.lit(0.0))).alias("within_r"))


def strength(value: Column, cuts: Sequence[tuple[float, str]], noun: str) -> Column:
    out = F.when(value.isNull(), "not measurable")
    for limit, word in cuts:
        out = out.when(F.abs(value) >= limit, f"{word} {noun}")
    return out.otherwise(f"very {cuts[-1][1]} {noun}")


def correlation_strength(value: Column) -> Column:
    return strength(value, K.ASSOCIATION_CUTS, "univariate association")


def eta_strength(value: Column) -> Column:
    return strength(value, K.ETA_CUTS, "group association")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows, missing, distinct per column. Values are stacked and reduced to distinct first."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    cells = df.select(F.inline(entries)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_rows"),
        F.count("value").alias("distinct_values"))


def numeric_associations(df: DataFrame, numeric: Sequence[str], target: str, group: str) -> DataFrame:
    """column, pearson_r, spearman_rho, within_r of all numeric columns against the target.

    The columns are stacked and reduced to distinct (column, value, target, group) once; ranks, moments and moments within
    groups of all columns come from those cells, so the table is read once however many columns there are.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in numeric]) if numeric else \
        F.array().cast("array<struct<column:string,x:double>>")
    stacked = df.select(F.inline(entries), F.col(target).cast("double").alias("y"), F.col(group).alias("g"))
    cells = materialise(_pair(stacked, "x", "y").groupBy("column", "x", "y", "g").agg(F.count(F.lit(1)).alias("w")), "association-cells")
    w = F.col("w")

    def centred(keys: list[str]) -> DataFrame:
        """Weighted cross products about the means of each key."""
        means = cells.groupBy(*keys).agg(F.sum("w").alias("n"), (F.sum(w * F.col("x")) / F.sum("w")).alias("mx"), (F.sum(w * F.col("y")) / F.sum("w")).alias("my"))
        dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
        return O.null_safe_join(cells, means, keys).groupBy("column").agg(
            F.sum("w").alias("n"), F.try_divide(F.sum(w * dx * dy), F.nullif(F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy)), F.lit(0.0))).alias("r"))
    plain = centred(["column"]).select("column", F.when(F.col("n") >= 2, F.col("r")).alias("pearson_r"))
    within = centred(["column", "g"]).select("column", F.col("r").alias("within_r"))

    def ranks(value: str) -> DataFrame:
        ranked = O.cumulative(cells, ["column"], value, w)
        centre = (F.col("total") + 1) / F.lit(2.0)
        return ranked.select("column", F.col("v").alias(value), (F.col("upto") - (F.col("w") - 1) / F.lit(2.0) - centre).alias(f"r{value}"))
    pairs = cells.groupBy("column", "x", "y").agg(F.sum("w").alias("w")).join(ranks("x"), ["column", "x"]).join(ranks("y"), ["column", "y"])
    rho = pairs.groupBy("column").agg(F.try_divide(
        F.sum(w * F.col("rx") * F.col("ry")), F.nullif(F.sqrt(F.sum(w * F.col("rx") * F.col("rx")) * F.sum(w * F.col("ry") * F.col("ry"))), F.lit(0.0))).alias("spearman_rho"))
    return plain.join(rho, "column").join(within, "column")


def category_associations(df: DataFrame, categorical: Sequence[str], target: str) -> DataFrame:
    """column, eta_squared of all categories against the target in one pass; a missing category is its own group."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias("v")) for c in categorical]) if categorical else \
        F.array().cast("array<struct<column:string,v:string>>")
    groups = df.filter(F.col(target).isNotNull()).select(F.inline(entries), F.col(target).alias("y")).groupBy("column", "v").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("s"))
    grand = groups.groupBy("column").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    gap = F.col("m") - F.col("gm")
    between, inside = F.sum(F.col("n") * gap * gap), F.sum(F.col("n") * F.col("s"))
    return groups.join(grand, "column").groupBy("column").agg(F.try_divide(between, F.nullif(between + inside, F.lit(0.0))).alias("eta_squared"))


def association_profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], excluded: Sequence[str],
                        target: str, group: str) -> DataFrame:
    """One row per column: profile, the fitting association measure and its label."""
    profile = column_profile(df, [*numeric, *categorical, *excluded])
    scored = numeric_associations(df, numeric, target, group).join(category_associations(df, categorical, target), "column", "full_outer")
    joined = profile.join(scored, "column", "left")
    is_cat, is_num = F.col("column").isin(*categorical), F.col("column").isin(*numeric)
    many = is_cat & (F.col("distinct_values") > K.MAX_SCORED_CATEGORIES)
    constant = ~F.col("column").isin(*excluded) & (F.col("distinct_values") <= 1)
    method = (F.when(constant, "constant").when(many, "not_scored_many_categories").when(is_cat, "eta_squared")
              .when(is_num, "pearson_spearman").otherwise("excluded"))
    chosen = F.coalesce(F.col("spearman_rho"), F.col("pearson_r"))
    out = joined.withColumn("method", method)
    for measure in ("pearson_r", "spearman_rho", "within_r", "eta_squared"):
        out = out.withColumn(measure, F.when(F.col("method").isin("eta_squared", "pearson_spearman"), F.round(measure, 6)))
    return out.withColumn(
        "strength",
        F.when(F.col("method") == "eta_squared", eta_strength(F.col("eta_squared")))
        .when(F.col("method") == "pearson_spearman", correlation_strength(chosen))
        .when(F.col("method") == "constant", "no variation").otherwise("not scored"))


def association_order() -> list[Column]:
    """|rho| (else |r|) descending, then eta squared descending, then the unscored, by name."""
    chosen = F.coalesce(F.col("spearman_rho"), F.col("pearson_r"))
    bucket = F.when(chosen.isNotNull(), 0).when(F.col("eta_squared").isNotNull(), 1).otherwise(2)
    return [bucket.asc(), F.coalesce(F.abs(chosen), F.col("eta_squared"), F.lit(0.0)).desc(), F.col("column").asc()]


# Summaries and bins ----------------------------------------------------------

def median_table(df: DataFrame, keys: Sequence[str], values: Sequence[str], aggs: Sequence[Column] = (), most: int = SORTED_ROWS) -> DataFrame:
    """Plain aggregates plus exact medians of several columns.

    Keys of up to ``most`` rows sort their values in place; the rows of larger ones are stacked and spread over buckets.
    """
    if not keys:
        return _stacked_medians(df, keys, values, df.agg(F.count(F.lit(1)).alias("n"), *aggs))
    base = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs), "median-groups")
    large = base.filter(F.col("n") > most).select(*keys, F.lit(True).alias("__large"))
    if large.isEmpty():
        return _sorted_medians(df, keys, values, base)
    marked = O.null_safe_join(df, large, keys, "left")
    few = _sorted_medians(marked.filter("__large IS NULL"), keys, values, base.filter(F.col("n") <= most))
    return few.unionByName(_stacked_medians(marked.filter("__large"), keys, values, base.filter(F.col("n") > most)))


def _sorted_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], base: DataFrame) -> DataFrame:
    lists = df.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.col(v).cast("double"))).alias(f"median_{v}") for v in values])

    def middle(x: Column) -> Column:
        at = (F.size(x) - 1) * F.lit(0.5)
        low, high = F.get(x, F.floor(at).cast("int")), F.get(x, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))
    wide = lists.select(*keys, *[middle(F.col(f"median_{v}")).alias(f"median_{v}") for v in values])
    return O.null_safe_join(base, wide, keys, "left")


def _stacked_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], base: DataFrame) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(v).alias("__measure"), F.col(v).cast("double").alias("__x")) for v in values])
    stacked = df.select(*keys, F.inline(entries))
    med = O.quantiles(stacked, [*keys, "__measure"], "__x", {"med": 0.5})
    wide = med.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__measure") == v, F.col("med"))).alias(f"median_{v}") for v in values])
    if not keys:
        return base.select("*", *[wide.select(f"median_{v}").scalar().alias(f"median_{v}") for v in values])
    return O.null_safe_join(base, wide, keys, "left")


def histogram(df: DataFrame, value: str, width: int) -> DataFrame:
    """Fixed-width buckets with gaps filled by zero."""
    band = (F.floor(F.col(value) / width) * width).cast("bigint")
    counts = df.filter(F.col(value).isNotNull()).groupBy(band.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter(F.col("lo").isNotNull())
    spine = span.select(F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(width).cast("bigint"))).alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def equal_width_bins(df: DataFrame, x: str, y: str, bins: int = K.BIN_COUNT) -> DataFrame:
    """At most ``bins`` equal bins between min and max; mean x, mean y and count of each."""
    lo, hi = df.agg(F.min(x).alias("m")).scalar(), df.agg(F.max(x).alias("m")).scalar()
    share = F.try_divide(F.col(x) - lo, F.nullif(hi - lo, F.lit(0.0)))
    at = F.coalesce(F.least(F.lit(bins - 1), F.floor(share * bins)), F.lit(0))
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(
        F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n"))


def local_evidence(train: DataFrame, start_month_no: int | Column) -> DataFrame:
    """Recent training sales per (town, type) and whether they are too few."""
    return train.groupBy("town", "flat_type").agg(
        F.count_if(F.col("month_no") >= start_month_no).alias("recent_training_sales")) \
        .withColumn("limited_local", F.col("recent_training_sales") < K.MIN_LOCAL_SALES)


def status_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return stack_dimensions(df, {c: F.col(c) for c in columns}, []).groupBy("dimension", "group").agg(F.count(F.lit(1)).alias("n"))


def quality_checks(row: DataFrame) -> DataFrame:
    """Seven named checks from a one-row table of totals."""
    def pct(c: str) -> Column:
        return F.try_divide(F.lit(100.0) * F.col(c), F.col("total"))

    def check(name: str, value: Column, unit: str, status: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), value.cast("double").alias("observed_value"),
                        F.lit(unit).alias("unit"), status.alias("status"))

    def verdict(good: Column, bad: str = "review") -> Column:
        return F.when(good, "pass").otherwise(bad)
    return row.select(F.inline(F.array(
        check("current_listing_count", F.col("total"), "count", F.lit("informational")),
        check("block_match_coverage", pct("matched"), "percent", verdict(pct("matched") >= 95)),
        check("valuation_coverage", pct("valued"), "percent", verdict(pct("valued") >= 90)),
        check("listing_url_coverage", pct("linked"), "percent", verdict(F.col("linked") == F.col("total"))),
        check("floor_area_coverage", pct("with_area"), "percent", verdict(pct("with_area") >= 95)),
        check("unusually_low_price_flags", F.col("low_price_flags"), "count", verdict(F.col("low_price_flags") == 0)),
        check("complete_snapshot_count", F.col("snapshots"), "count", verdict(F.col("snapshots") >= 2, "pending")))))


def paired_gains(pairs: DataFrame, dimensions: dict[str, Column], keys: Sequence[str] = ("dataset_split",)) -> DataFrame:
    """Same sales under two models: MAE of each, gain, bias, wins, losses and ties."""
    old = F.abs(F.col("old_price") - F.col("actual_price"))
    new = F.abs(F.col("new_price") - F.col("actual_price"))
    d = stack_dimensions(pairs.withColumn("old_error", old).withColumn("new_error", new), dimensions,
                         [*keys, "actual_price", "old_price", "new_price", "old_error", "new_error"])
    gain = F.col("old_error") - F.col("new_error")
    return d.groupBy(*keys, "dimension", "group").agg(
        F.count(F.lit(1)).alias("sales"), (F.count(F.lit(1)) < 100).alias("limited_evidence"),
        F.avg("old_error").alias("old_mae"), F.avg("new_error").alias("new_mae"), F.avg(gain).alias("mae_improvement"),
        F.avg(F.col("old_price") - F.col("actual_price")).alias("old_bias"),
        F.avg(F.col("new_price") - F.col("actual_price")).alias("new_bias"),
        F.count_if(gain > 0.005).alias("new_wins"), F.count_if(gain < -0.005).alias("old_wins"),
        F.count_if(F.abs(gain) <= 0.005).alias("ties"))


def paired_error_breakdown(rows: DataFrame, cuts: tuple[Column, Column, Column], min_group: int = K.MIN_GROUP_SIZE) -> DataFrame:
    """Model against the comparable estimate on the same sales, by (dimension, town, group).

    ``rows`` has one row per sale: town, flat_type, remaining_lease_months, transaction_month, actual_price, predicted_price,
    lower_estimate, upper_estimate, and the comparable estimate as baseline_price, comparable_tier and comparable_count. ``cuts``
    are the training quartiles that band the model's own price. Months are compared over all towns.
    """
    lease = M.lease_band(F.coalesce("remaining_lease_months", F.lit(0)))
    town = F.col("town").cast("string")
    keys = {"town": (town, town), "town_flat_type": (town, F.col("flat_type")), "town_lease_band": (town, lease),
            "town_predicted_price_band": (town, M.quartile_band(F.col("predicted_price"), *cuts)),
            "town_comparable_tier": (town, F.col("comparable_tier")),
            "town_comparable_count_band": (town, M.count_band(F.coalesce("comparable_count", F.lit(0)))),
            "transaction_month": (F.lit("ALL"), F.date_format("transaction_month", "yyyy-MM"))}
    entries = F.array(*[F.struct(F.lit(name).alias("dimension"), t.alias("town"), g.cast("string").alias("group")) for name, (t, g) in keys.items()])
    stacked = with_errors(rows).withColumn("baseline_error", F.abs(F.col("baseline_price") - F.col("actual_price"))).select(
        F.inline(entries), "error", "abs_error", "ape", "baseline_error", covered().cast("double").alias("inside"))
    by = ["dimension", "town", "group"]
    out = stacked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sale_count"), F.avg("abs_error").alias("model_mae"), F.avg("baseline_error").alias("baseline_mae"),
        F.avg("ape").alias("model_mape_pct"), F.avg("error").alias("model_mean_bias"), (F.avg("inside") * 100).alias("range_coverage_pct"))
    out = join_quantiles(out, stacked, by, "abs_error", {"model_p90_absolute_error": 0.9}, finite=True)
    return out.withColumn("model_minus_baseline_mae", F.col("model_mae") - F.col("baseline_mae")).withColumn(
        "evidence_status", F.when(F.col("sale_count") < min_group, "limited_sales").when(F.col("model_mae") > F.col("baseline_mae"), "model_higher_mae")
        .otherwise("model_lower_mae"))


def worst_segments(segments: DataFrame, minimum: int = 100, k: int = 10) -> DataFrame:
    """(dimension, town, group, priority): the k town and flat type pairs of at least ``minimum`` sales with the highest percentage error."""
    from pyspark.sql import Window
    order = Window.orderBy(F.col("model_mape_pct").desc(), F.col("sale_count").desc(), "town", "group")
    big = segments.filter((F.col("dimension") == "town_flat_type") & (F.col("sale_count") >= minimum))
    # The limit keeps the ranking window to k rows.
    top = big.orderBy(F.col("model_mape_pct").desc(), F.col("sale_count").desc(), "town", "group").limit(k)
    return top.select("dimension", "town", "group", F.row_number().over(order).alias("priority"))
