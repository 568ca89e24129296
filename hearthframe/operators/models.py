"""Feature engineering and MLlib models trained on the residual to a past-only anchor."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthframe.functions import measures as M
from hearthframe.session import materialise, shared_dir


def engineered_features(df: DataFrame) -> DataFrame:
    """Needs transaction_month, storey_midpoint, max_floor_lvl, year_completed, nearest_m."""
    near = F.greatest(F.lit(0.0), F.col("nearest_m"))
    age = F.year("transaction_month") - F.col("year_completed")
    sin, cos = M.month_angle(F.month("transaction_month"))
    floors = F.coalesce(F.col("max_floor_lvl"), F.lit(0))
    known = F.col("nearest_m").isNotNull()
    return (
        df.withColumn("relative_storey", F.when(floors > 0, F.coalesce("storey_midpoint", F.lit(0.0)) / floors).otherwise(0.0))
        .withColumn("age_squared", (F.coalesce(age, F.lit(0)) * F.coalesce(age, F.lit(0))).cast("double"))
        .withColumn("log_nearest_m", F.when(known, F.log1p(near)))
        .withColumn("within_400m", F.when(known, (near <= 400).cast("double")))
        .withColumn("within_800m", F.when(known, (near <= 800).cast("double")))
        .withColumn("month_sin", sin).withColumn("month_cos", cos)
    )


def interactions(df: DataFrame, flat_types: list[str]) -> DataFrame:
    """Area and remaining lease, one column per training flat type, zero elsewhere."""
    out = df
    for level in flat_types:
        here = F.col("flat_type") == level
        name = level.lower().replace(" ", "_")
        out = out.withColumn(f"area_x_{name}", F.when(here, F.coalesce("floor_area_sqm", F.lit(0.0))).otherwise(0.0)) \
            .withColumn(f"lease_x_{name}", F.when(here, F.coalesce("remaining_lease_months", F.lit(0)).cast("double")).otherwise(0.0))
    return out


def top_contributions(parts, k: int):
    """struct(positive, negative): the k largest of each sign of an array<struct<name,value>>."""
    ordered = F.array_sort(F.transform(parts, lambda x: F.struct((-x["value"]).alias("less"), x["name"].alias("name"), x["value"].alias("value"))))
    up = F.slice(F.filter(ordered, lambda x: x["value"] > 0), 1, k)
    down = F.slice(F.reverse(F.filter(ordered, lambda x: x["value"] < 0)), 1, k)
    return F.struct(up.alias("positive"), down.alias("negative"))


# Training ------------------------------------------------------------------------

NUMERIC = ["floor_area_sqm", "storey_midpoint", "remaining_lease_months", "latitude", "longitude", "relative_storey", "age_squared",
           "log_nearest_m", "within_400m", "within_800m", "month_sin", "month_cos", "anchor_price"]
CATEGORICAL = ["town", "flat_type", "flat_model"]
MIN_LEVEL_ROWS = 10
# Rows of a partition that boosting keeps and reads again in every round.
ROWS_AT_ONCE = 100_000
POOLED = "infrequent"


def pool_rare_levels(df: DataFrame, train: DataFrame, columns: list[str], minimum: int = MIN_LEVEL_ROWS) -> DataFrame:
    """Levels with fewer training rows than ``minimum`` (or unseen) become one pooled level.

    The levels are counted once and written, not anew in every job that reads the result.
    """
    out = df
    for c in columns:
        kept = train.groupBy(c).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= minimum).select(c, F.lit(True).alias("__keep"))
        kept = materialise(kept, "levels")
        out = out.join(kept, c, "left").withColumn(c, F.when(F.col("__keep"), F.col(c)).otherwise(POOLED)).drop("__keep")
    return out


def preprocess_stages(numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL, one_hot: bool = True) -> list:
    """Median imputation and scaling of numbers; indexed (and one-hot) categories."""
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    filled = [f"{c}__f" for c in numeric]
    indexed = [f"{c}__i" for c in categorical]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=filled, relativeError=0.001),
              VectorAssembler(inputCols=filled, outputCol="numbers"),
              StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
              StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep")]
    if one_hot:
        encoded = [f"{c}__o" for c in categorical]
        return stages + [OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep", dropLast=False),
                         VectorAssembler(inputCols=["scaled", *encoded], outputCol="features")]
    return stages + [VectorAssembler(inputCols=[*filled, *indexed], outputCol="features")]


def residual_frame(df: DataFrame) -> DataFrame:
    """Rows with a usable anchor and the residual target."""
    usable = F.col("anchor_price").isNotNull() & ~F.isnan("anchor_price") & (F.col("anchor_price") > 0)
    return df.filter(usable).withColumn("label", F.col("resale_price") - F.col("anchor_price"))


def estimator(kind: str, rows: int, **over):
    """MLlib estimator of a model family.

    The boosted family uses absolute loss and quantile trees the leaf members of a forest; Huber and quantile
    boosting are in ``boosting``.
    """
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    if kind == "ridge":
        return LinearRegression(regParam=over.get("alpha", 20.0) / rows, elasticNetParam=0.0, standardization=False, solver="normal")
    common = {"seed": 42, "maxBins": over.get("max_bins", 64)}
    if kind == "boosted":
        return GBTRegressor(lossType="absolute", maxIter=over.get("trees", 650), maxDepth=over.get("depth", 6), stepSize=0.04,
                            validationIndicatorCol="is_validation", **common)
    if kind in ("random_forest", "quantile_forest"):
        return RandomForestRegressor(numTrees=over.get("trees", 80), maxDepth=over.get("depth", 16), minInstancesPerNode=20,
                                     featureSubsetStrategy="0.6", subsamplingRate=0.8, leafCol="leaf" if kind == "quantile_forest" else "", **common)
    raise ValueError(f"unknown model kind {kind}")


def dealt(df: DataFrame) -> DataFrame:
    """Rows in partitions of a bounded size, whatever files they come from."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / ROWS_AT_ONCE)))


def fit(kind: str, train: DataFrame, validation: DataFrame | None = None, **over):
    """Pipeline fitted on the residual target."""
    from pyspark.ml import Pipeline
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        # Boosting checkpoints its row predictions every few rounds, else the lineage grows with the rounds.
        context.setCheckpointDir(shared_dir(train.sparkSession))
    rows = train.count()
    data = train
    if kind == "boosted":
        if validation is None:
            raise ValueError("boosting with early stopping needs validation rows")
        data = train.withColumn("is_validation", F.lit(False)).unionByName(validation.withColumn("is_validation", F.lit(True)))
        data = dealt(data.select(*NUMERIC, *CATEGORICAL, "label", "is_validation"))
    stages = preprocess_stages(one_hot=kind == "ridge")
    return Pipeline(stages=[*stages, estimator(kind, rows, **over)]).fit(data)


def predict(model, df: DataFrame, model_id: str) -> DataFrame:
    """max(1, anchor + residual) with the model's id."""
    return anchored(model.transform(df), model_id)


def anchored(scored: DataFrame, model_id: str) -> DataFrame:
    price = F.greatest(F.lit(1.0), F.col("anchor_price") + F.col("prediction"))
    return scored.withColumn("predicted_price", price).withColumn("model_id", F.lit(model_id))


def prediction_rows(scored: DataFrame) -> DataFrame:
    """Errors, percentages and bounds in their published rounding."""
    p = F.greatest(F.lit(1.0), F.col("predicted_price"))
    return scored.select(
        "model_id", "transaction_id", "dataset_split", F.round(p, 2).alias("predicted_price"), "actual_price",
        F.round(F.abs(p - F.col("actual_price")), 2).alias("absolute_error"),
        F.round(F.abs(p - F.col("actual_price")) / F.col("actual_price") * 100, 4).alias("absolute_percentage_error"),
        F.round(F.greatest(F.lit(1.0), F.col("lower_estimate")), 2).alias("lower_estimate"),
        F.round(F.greatest(p, F.col("upper_estimate")), 2).alias("upper_estimate"))


def leaf_quantiles(model, train: DataFrame, rows: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantile forest: each tree's leaf contributes its training residuals with weight 1/size.

    Training residuals are first reduced to (tree, leaf, residual) counts. Leaves of
    a row are few (one per tree), so the join is row x trees, and the weighted step
    quantile runs on the combined (row, residual) weights. The three are sorted, so
    they cannot cross.
    """
    from pyspark.ml.functions import vector_to_array

    from hearthframe.operators import ordered as O
    unit = 2 ** 30

    def leaves(df: DataFrame, *keep: str) -> DataFrame:
        return model.transform(df).select(*keep, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf_no"))
    members = leaves(train.withColumn("label_r", F.col("label")), "label_r").groupBy("tree", "leaf_no", "label_r").agg(F.count(F.lit(1)).alias("n"))
    size = members.groupBy("tree", "leaf_no").agg(F.sum("n").alias("size"))
    weighted = members.join(size, ["tree", "leaf_no"]).select(
        "tree", "leaf_no", "label_r", F.greatest(F.lit(1), F.round(F.col("n") / F.col("size") * unit).cast("bigint")).alias("mass"))
    # Rows falling in the same leaves share their answer.
    keyed = model.transform(rows).select("transaction_id", "anchor_price", vector_to_array("leaf").alias("path")) \
        .withColumn("path_id", F.md5(F.array_join(F.col("path").cast("array<string>"), ",")))
    paths = keyed.select("path_id", "path").distinct().select("path_id", F.posexplode("path").alias("tree", "leaf_no"))
    pool = paths.join(weighted, ["tree", "leaf_no"]).groupBy("path_id", "label_r").agg(F.sum("mass").alias("mass"))
    q = O.step_quantiles(pool, ["path_id"], "label_r", F.col("mass"), probs)
    ordered = F.array_sort(F.array(*probs))
    q = q.select("path_id", *[F.get(ordered, i).alias(n) for i, n in enumerate(probs)])
    return keyed.join(q, "path_id").select(
        "transaction_id", *[F.greatest(F.lit(1.0), F.col("anchor_price") + F.col(n)).alias(n) for n in probs])


def linear_contributions(model, df: DataFrame) -> DataFrame:
    """Per row: intercept, the sum of coefficient x value, and how far that is from the prediction."""
    from pyspark.ml.functions import vector_to_array
    line = model.stages[-1]
    weights = F.array(*[F.lit(float(w)) for w in line.coefficients.toArray()])
    scored = model.transform(df)
    parts = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    named = F.zip_with(F.sequence(F.lit(0), F.size(parts) - 1), parts, lambda i, v: F.struct(F.concat(F.lit("f"), i).alias("name"), v.alias("value")))
    return scored.withColumn("contributions", top_contributions(named, 5)).withColumn(
        "gap", F.abs(F.lit(float(line.intercept)) + total - F.col("prediction")))


def select_recent(predictions: DataFrame) -> DataFrame:
    """Model with the lowest MAE in the later half of validation months; overall MAE, then id, break ties.

    Returns no row when the models do not cover the same recent sales.
    """
    from hearthframe.operators.calibration import half_of
    v = predictions.filter("dataset_split = 'validation'")
    halves = v.join(half_of(v), "month_no")
    late = F.col("half") == "late"
    err = F.abs(F.col("predicted_price") - F.col("actual_price"))
    m = halves.groupBy("model_id").agg(
        F.avg(F.when(late, err)).alias("recent_mae"), F.avg(err).alias("mae"), F.count_if(late).alias("recent_rows"),
        F.sum(F.when(late, F.xxhash64("transaction_id").cast("decimal(38,0)"))).alias("ids"))
    best = m.agg(F.min_by(F.struct("model_id", "recent_mae", "mae"), F.struct("recent_mae", "mae", "model_id")).alias("b"),
                 F.count_distinct("recent_rows", "ids").alias("coverages"))
    return best.filter("coverages = 1").select("b.*")


def choose_blend(pairs: DataFrame, steps: int = 20) -> DataFrame:
    """Weight in 0..1 with the smallest MAE of the blend, ties nearest one half. One pass over the pairs."""
    weights = [i / steps for i in range(steps + 1)]
    maes = [F.avg(F.abs(F.col("old_price") * F.lit(1 - w) + F.col("new_price") * F.lit(w) - F.col("actual_price"))).alias(f"w{i}")
            for i, w in enumerate(weights)]
    row = pairs.agg(*maes)
    options = F.array(*[F.struct(F.col(f"w{i}").alias("mae"), F.lit(abs(w - 0.5)).alias("off"), F.lit(w).alias("weight")) for i, w in enumerate(weights)])
    best = F.array_min(options)
    return row.select(best["weight"].alias("weight"), best["mae"].alias("mae"))


def paired_bootstrap(pairs: DataFrame, replicates: int = 5000) -> DataFrame:
    """95 % interval of the mean paired error difference by Poisson bootstrap.

    Rows stay where they are: each task draws weights for its rows and emits one
    partial sum per replicate, so the shuffle is tasks x replicates.
    """
    import numpy as np
    import pandas as pd
    gain = F.abs(F.col("new_price") - F.col("actual_price")) - F.abs(F.col("old_price") - F.col("actual_price"))
    slim = pairs.select(gain.cast("double").alias("d"), F.xxhash64("transaction_id").alias("h"))
    # Smallest uniform number of each Poisson(1) count.
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 12)]))
    salt = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def weights(rows):
        """Weights that depend on the row and the replicate alone, however rows are dealt out."""
        x = rows[:, None] ^ salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.searchsorted(steps, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53, side="right")

    def draw(batches):
        total, weight = np.zeros(replicates), np.zeros(replicates)
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start:start + 512]
                w = weights(part["h"].to_numpy(np.int64).view(np.uint64))
                total += part["d"].to_numpy() @ w
                weight += w.sum(axis=0)
        yield pd.DataFrame({"replicate": np.arange(replicates), "total": total, "weight": weight})
    sums = slim.mapInPandas(draw, "replicate int, total double, weight double").groupBy("replicate").agg(
        (F.try_divide(F.sum("total"), F.sum("weight"))).alias("mean"))
    from hearthframe.operators import ordered as O
    ends = O.quantiles(sums, [], "mean", {"low": 0.025, "high": 0.975})
    facts = pairs.agg(F.avg(gain).alias("mae_difference"), F.count_if(gain < 0).alias("new_better"), F.count_if(gain > 0).alias("old_better"))
    return facts.select("*", ends.select("low").scalar().alias("low"), ends.select("high").scalar().alias("high"))
