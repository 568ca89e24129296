"""Tables that are published in one step.

A table is a folder: ``data`` holds what each publication wrote, in one folder per key value, ``versions`` one small
manifest per version that says which folder holds the rows of which key. A publication first writes its data, then
creates the next manifest, which fails if another writer was there first. A reader takes one manifest, so it sees the
table before or after a publication, never half of it, and a job that fails before its manifest changes nothing.
Replacing keys writes only their rows; the others stay where they are.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthframe.sources.sinks import update_from

#: Key values of one table; the manifest is held on the driver.
MOST_KEYS = 100_000


class PublishConflict(RuntimeError):
    """Another writer changed what this publication was computed from."""


@dataclass(frozen=True)
class Version:
    number: int
    #: Digest of the key values to the folder of their rows.
    parts: dict[str, str]


class PublishedTable:
    """``keys`` are the columns by which rows are replaced; they may hold nulls."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: Sequence[str]):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, list(keys)
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Versions ------------------------------------------------------------------

    def _manifest(self, number: int) -> str:
        return f"{self.root}/versions/{number:012d}.json"

    def _load(self, name: str) -> Version | None:
        """None while another writer has created the file but not yet closed it."""
        stream = self._fs.open(self._path(name))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return Version(found["number"], found["parts"])

    def version(self, number: int | None = None) -> Version:
        """The newest version, or a given one; version 0 is the empty table."""
        if number == 0:
            return Version(0, {})
        if number is not None:
            return self._load(self._manifest(number))
        folder = self._path(f"{self.root}/versions")
        if self._fs.exists(folder):
            for name in sorted((s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")), reverse=True):
                found = self._load(f"{self.root}/versions/{name}")
                if found:
                    return found
        return Version(0, {})

    def _create(self, version: Version) -> bool:
        """Create the manifest of a version unless it exists."""
        try:
            stream = self._fs.create(self._path(self._manifest(version.number)), False)
        except Exception as error:  # noqa: BLE001
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        stream.write(bytearray(json.dumps({"number": version.number, "parts": version.parts}).encode()))
        stream.close()
        return True

    def _commit(self, base: Version, changes: dict[str, str | None], reads: set[str], attempts: int = 50) -> Version:
        """Put ``changes`` on top of the newest version; parts in ``reads`` must be as they were in ``base``."""
        for _ in range(attempts):
            now = self.version()
            if any(now.parts.get(p) != base.parts.get(p) for p in reads):
                raise PublishConflict(f"version {now.number} changed rows that this publication read in version {base.number}")
            parts = {k: v for k, v in (now.parts | changes).items() if v is not None}
            if len(parts) > MOST_KEYS:
                raise ValueError(f"more than {MOST_KEYS} key values")
            new = Version(now.number + 1, parts)
            if self._create(new):
                return new
            time.sleep(0.05)
        raise PublishConflict(f"version {now.number + 1} was begun by another writer and not finished")

    # Rows ----------------------------------------------------------------------

    def _digest(self) -> Column:
        return F.md5(F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"}))

    def _store(self, rows: DataFrame) -> dict[str, str]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn("__part", self._digest()).write.partitionBy("__part").parquet(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        return {n.removeprefix("__part="): f"{folder}/{n}" for n in names if n.startswith("__part=")}

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(sorted(self.version(number).parts.values()))

    def _rows(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace(self, rows: DataFrame, also: DataFrame | None = None) -> Version:
        """The keys of ``rows``, and those of ``also`` without new rows, give way to ``rows``; the same call twice changes nothing."""
        base = self.version()
        changes: dict[str, str | None] = dict(self._store(rows))
        if also is not None:
            gone = {r["part"] for r in also.select(self._digest().alias("part")).distinct().limit(MOST_KEYS + 1).collect()}
            changes = dict.fromkeys(gone) | changes
        return self._commit(base, changes, set())

    def update(self, updates: DataFrame, on: Sequence[str], columns: Sequence[str], where: Column | None = None, retries: int = 3,
               before_commit: Callable[[], None] | None = None) -> Version:
        """UPDATE ... FROM over the published rows; only keys with a matching row are written again.

        Refuses updates whose ``on`` columns repeat. When another writer changes those keys meanwhile, the update is computed anew.
        ``before_commit`` is called between writing and committing.
        """
        if set(columns) & set(self.keys):
            raise ValueError("key columns cannot be updated")
        twice = updates.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"more than one update for {[twice[0][c] for c in on]}")
        for turn in range(retries + 1):
            base = self.version()
            rows = self._rows(sorted(base.parts.values()))
            touched = rows.join(updates.select(*on), list(on), "left_semi").select(self._digest().alias("part")).distinct().limit(MOST_KEYS + 1)
            parts = sorted(r["part"] for r in touched.collect())
            if not parts:
                return base
            changed = update_from(self._rows([base.parts[p] for p in parts]), updates, on, columns, where)
            stored = self._store(changed)
            if before_commit:
                before_commit()
            try:
                return self._commit(base, stored, set(parts))
            except PublishConflict:
                if turn == retries:
                    raise
        raise AssertionError


def clustered_write(df: DataFrame, path: str, partition: Sequence[str], cluster: Sequence[str], files: int | None = None) -> DataFrame:
    """Partition folders by ``partition``, rows in the order of ``cluster`` inside them; read back.

    Ranges over both deal out the rows, so a partition with a third of all rows is written by many tasks, each of them with
    a narrow range of the cluster columns that a pushed-down filter can skip by the file's statistics.
    """
    by = [*partition, *cluster]
    ranged = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.mode("errorifexists").partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
