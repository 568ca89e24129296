"""Residual offsets, calibrated ranges, method choice and the release gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe import constants as K
from hearthframe.operators import ordered as O


def with_residual(df: DataFrame) -> DataFrame:
    return df.withColumn("residual", F.col("actual_price") - F.col("predicted_price")) \
        .withColumn("abs_residual", F.abs(F.col("actual_price") - F.col("predicted_price")))


def residual_offsets(df: DataFrame, keys: Sequence[str], level: float) -> DataFrame:
    """keys, lower_offset and upper_offset (tails), radius (symmetric), rows."""
    r = with_residual(df)
    tail = (1 - level) / 2
    ends = O.finite_quantiles(r, keys, "residual", {"lower_offset": tail, "upper_offset": 1 - tail}, count_as="rows")
    ball = O.finite_quantiles(r, keys, "abs_residual", {"radius": level})
    if keys:
        return O.null_safe_join(ends, ball, keys)
    return ends.withColumn("radius", ball.select("radius").scalar())


def calibrated_interval(point: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds that contain the point, at least 1, in cents."""
    return (F.round(F.greatest(F.lit(1.0), F.least(point, point + low)), 2), F.round(F.greatest(point, point + high), 2))


def half_of(months: DataFrame) -> DataFrame:
    """Distinct months to early/late halves: index below n//2 is early. At most a few dozen rows."""
    from pyspark.sql import Window
    distinct = months.select("month_no").distinct()
    n = distinct.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = distinct.withColumn("i", F.row_number().over(Window.orderBy("month_no")) - 1)
    return ranked.select("month_no", F.when(F.col("i") >= F.floor(n / 2), "late").otherwise("early").alias("half"))


def compare_calibrators(validation: DataFrame, minimum: int = K.MIN_CALIBRATION_GROUP) -> DataFrame:
    """Early-half residual tails applied to the late half: global against (town, type) offsets."""
    halves = validation.join(half_of(validation), "month_no")
    early, late = halves.filter("half = 'early'"), halves.filter("half = 'late'")
    rows = None
    for level in (0.90, 0.95):
        whole = residual_offsets(early, [], level)
        low, high = whole.select("lower_offset").scalar(), whole.select("upper_offset").scalar()
        by_group = residual_offsets(early, ["town", "flat_type"], level).filter(F.col("rows") >= minimum) \
            .select("town", "flat_type", F.col("lower_offset").alias("g_low"), F.col("upper_offset").alias("g_high"))
        x = late.join(by_group, ["town", "flat_type"], "left")
        offsets = F.array(
            F.struct(F.lit("global").alias("calibration_method"), low.alias("lo"), high.alias("hi")),
            F.struct(F.lit("town_flat_type").alias("calibration_method"), F.coalesce(F.col("g_low"), low).alias("lo"),
                     F.coalesce(F.col("g_high"), high).alias("hi")))
        x = x.select("actual_price", "predicted_price", F.inline(offsets))
        inside = F.col("actual_price").between(F.col("predicted_price") + F.col("lo"), F.col("predicted_price") + F.col("hi"))
        part = x.groupBy("calibration_method").agg(
            F.count(F.lit(1)).alias("assessment_rows"), (F.avg(inside.cast("double")) * 100).alias("observed_coverage_pct"),
            F.avg(F.col("hi") - F.col("lo")).alias("mean_interval_width")).withColumn("nominal_coverage_pct", F.lit(level * 100))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def method_check(validation: DataFrame) -> DataFrame:
    """Symmetric and asymmetric offsets at two levels, fitted early and judged late."""
    halves = validation.join(half_of(validation), "month_no")
    early, late = halves.filter("half = 'early'"), halves.filter("half = 'late'")
    rows = None
    for level in (0.95, 0.975):
        fit = residual_offsets(early, [], level)
        lo, hi, ball = (fit.select(c).scalar() for c in ("lower_offset", "upper_offset", "radius"))
        options = F.array(
            F.struct(F.lit("asymmetric_residual").alias("calibration_method"), lo.alias("lo"), hi.alias("hi")),
            F.struct(F.lit("symmetric_absolute_residual").alias("calibration_method"), (-ball).alias("lo"), ball.alias("hi")))
        x = late.select("actual_price", "predicted_price", F.inline(options))
        low, high = calibrated_interval(F.col("predicted_price"), F.col("lo"), F.col("hi"))
        part = x.groupBy("calibration_method").agg(
            F.round(F.avg(F.col("actual_price").between(low, high).cast("double")) * 100, 2).alias("observed_coverage_pct"),
            F.round(F.avg(high - low), 2).alias("mean_interval_width")).withColumn("nominal_coverage_pct", F.lit(level * 100))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def choose_method(check: DataFrame) -> DataFrame:
    """Smallest total coverage miss, then the smallest total width."""
    total = check.groupBy("calibration_method").agg(
        F.sum(F.abs(F.col("observed_coverage_pct") - F.col("nominal_coverage_pct"))).alias("miss"),
        F.sum("mean_interval_width").alias("width"))
    return total.agg(F.min_by("calibration_method", F.struct("miss", "width", "calibration_method")).alias("calibration_method"))


def confidence_label(comparables: Column, limited_local: Column) -> Column:
    return (F.when(comparables < 3, "insufficient_comparable_evidence").when(limited_local, "limited_local_training_data")
            .when(comparables < 5, "low_wide_range").when(comparables < 20, "moderate").otherwise("supported_by_comparables"))


def calibrated_ranges(test: DataFrame, validation: DataFrame, local: DataFrame, method: str = "symmetric_absolute_residual") -> DataFrame:
    """Ranges for test predictions: 95 %, or 97.5 % with few comparables or thin local evidence.

    Needs comparable_count on ``test``; ``local`` holds town, flat_type, recent_training_sales.
    """
    def offsets(df: DataFrame, level: float) -> tuple[Column, Column]:
        fit = residual_offsets(df, [], level)
        if method == "symmetric_absolute_residual":
            ball = fit.select("radius").scalar()
            return -ball, ball
        return fit.select("lower_offset").scalar(), fit.select("upper_offset").scalar()
    keys = ["town", "flat_type"]
    counts = local.select(*keys, "recent_training_sales")

    def mark(df: DataFrame) -> DataFrame:
        return df.join(counts, keys, "left").withColumn("recent_training_sales", F.coalesce("recent_training_sales", F.lit(0))) \
            .withColumn("limited_local", F.col("recent_training_sales") < K.MIN_LOCAL_SALES)
    normal, wide = offsets(validation, 0.95), offsets(validation, 0.975)
    thin = offsets(mark(validation).filter("limited_local"), 0.975)
    # Thin-evidence ranges are never narrower than the national wide ones.
    thin = (F.least(thin[0], wide[0]), F.greatest(thin[1], wide[1]))
    x = mark(test)
    few = F.col("comparable_count") < 5

    def side(i: int) -> Column:
        return F.when(F.col("limited_local"), thin[i]).when(few, wide[i]).otherwise(normal[i])
    low, high = calibrated_interval(F.col("predicted_price"), side(0), side(1))
    return x.withColumn("lower_estimate", low).withColumn("upper_estimate", high) \
        .withColumn("nominal_coverage_pct", F.when(F.col("limited_local") | few, 97.5).otherwise(95.0)) \
        .withColumn("confidence_label", confidence_label(F.col("comparable_count"), F.col("limited_local"))) \
        .withColumn("interval_covered", F.col("actual_price").between(F.col("lower_estimate"), F.col("upper_estimate")))


def release_gate(pairs: DataFrame, model: str, baseline: str) -> DataFrame:
    """One row: the model is released only when its MAE is strictly lower on every split."""
    per = pairs.groupBy("dataset_split").agg(
        F.avg(F.abs(F.col("new_price") - F.col("actual_price"))).alias("model_mae"),
        F.avg(F.abs(F.col("old_price") - F.col("actual_price"))).alias("baseline_mae"))
    passed = F.bool_and(F.col("model_mae") < F.col("baseline_mae")) & (F.count(F.lit(1)) == 2)
    return per.agg(F.count(F.lit(1)).alias("splits"), passed.alias("passed")) \
        .withColumn("released_model", F.when(F.col("passed"), model).otherwise(baseline))


def exit_facts(ranges: DataFrame, explanations: DataFrame, evidence: DataFrame, simple: DataFrame) -> DataFrame:
    """One row of facts for ``exit_criteria``, over the test sales of ``ranges``.

    A sale is explained if ``explanations`` rebuilds its estimate to 0.02 (column gap), traced if ``evidence`` holds comparable
    sales for it. Its range is unwidened if it rests on fewer than 5 comparables without the 97.5 % level, or on fewer than 3
    without being marked as insufficient. ``simple`` has the simple baseline's price of the same sales.
    """
    key = "transaction_id"
    explained = explanations.filter(F.col("gap") <= 0.02).select(key).distinct().withColumn("explained", F.lit(True))
    traced = evidence.select(key).distinct().withColumn("traced", F.lit(True))
    x = ranges.join(explained, key, "left").join(traced, key, "left").join(simple.select(key, "simple_price"), key, "left")
    few, none = F.col("comparable_count") < 5, F.col("comparable_count") < 3
    narrow = (few & (F.col("nominal_coverage_pct") < 97.5)) | (none & (F.col("confidence_label") != "insufficient_comparable_evidence"))
    return x.agg(
        F.avg(F.abs(F.col("predicted_price") - F.col("actual_price"))).alias("model_mae"),
        F.avg(F.abs(F.col("simple_price") - F.col("actual_price"))).alias("simple_mae"), F.count_distinct("town").alias("towns"),
        F.count(F.lit(1)).alias("test_rows"), F.count_if("explained").alias("explained"), F.count_if("traced").alias("traced"),
        F.count_if(narrow).alias("unwidened"), (F.avg(F.col("interval_covered").cast("double")) * 100).alias("observed_coverage"),
        F.avg("nominal_coverage_pct").alias("nominal_coverage"))


def exit_criteria(facts: DataFrame) -> DataFrame:
    """Five named criteria and the overall status from one row of facts."""
    def item(name: str, status: Column) -> Column:
        return F.struct(F.lit(name).alias("criterion"), status.alias("status"))
    accuracy = F.when(F.col("model_mae") < F.col("simple_mae"), "pass").otherwise("fail")
    scope = F.when(F.col("towns") == 1, "pass_pilot_scope").otherwise("pass")
    traced = F.col("traced") == F.col("test_rows")
    trace = F.when(traced & (F.col("explained") == F.col("test_rows")), "pass").when(traced, "review").otherwise("fail")
    low_data = F.when(F.col("unwidened") == 0, "pass").otherwise("review")
    near = F.abs(F.col("observed_coverage") - F.col("nominal_coverage")) <= K.COVERAGE_TOLERANCE_PCT
    coverage = F.when(near, "pass").otherwise("needs_more_calibration")
    core = accuracy.startswith("pass") & trace.startswith("pass") & low_data.startswith("pass")
    overall = F.when(core & near & (F.col("towns") > 1), "phase1_exit_ready").otherwise("pilot_exit_with_open_gaps")
    return facts.select(F.inline(F.array(
        item("beats_simple_baseline", accuracy), item("accuracy_by_segment", scope), item("traceable_estimates", trace),
        item("low_data_widening", low_data), item("range_coverage", coverage), item("overall", overall))))
