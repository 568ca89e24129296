"""Writes: checked copies, report files, idempotent publication, run history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered_copy(df: DataFrame, predicate: Column, path: str) -> DataFrame:
    """Persist a subset; an empty subset is an error and writes nothing."""
    subset = df.filter(predicate)
    if subset.isEmpty():
        raise ValueError("the subset has no rows")
    subset.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parquet_sink(df: DataFrame, path: str, partition: Sequence[str] = ()) -> DataFrame:
    """Write to a fresh path after the gates; the caller publishes the path."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def report_files(df: DataFrame, path: str) -> tuple[str, str]:
    """Header CSV and JSON lines beside each other, written in parallel parts."""
    csv, json = f"{path}/csv", f"{path}/json"
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(csv)
    df.write.mode("errorifexists").json(json)
    return csv, json


def replace_by_key(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the republished keys give way to the new ones."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def update_from(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str],
                where: Column | None = None) -> DataFrame:
    """UPDATE ... FROM: matched rows that pass ``where`` take the other table's values, NULLs included."""
    other = updates.select(*keys, F.lit(True).alias("__matched"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(other, list(keys), "left")
    allowed = F.col("__matched") if where is None else F.col("__matched") & where
    changed = {c: F.when(allowed, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changed).select(*target.columns)


def append_run(history: DataFrame, current: DataFrame) -> DataFrame:
    """Earlier runs stay, the same run is replaced, the current one is added."""
    return replace_by_key(history, current, ["run_id"])


def nested_to_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(column))
