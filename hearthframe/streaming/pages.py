"""Result pages arriving over time: validation, merge, progress and price changes.

A stream's table is a folder: ``checkpoint`` holds offsets and state, ``rows`` what each micro-batch wrote, one folder
per batch. A batch costs what it brings, not what is already stored, a batch delivered again overwrites its own folder,
and a later run with the same root goes on where the last one ended. Progress and changes keep keyed state in a state
store, so their rows come out of the batch that brings the page.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hearthframe.operators.quality import first_reason
from hearthframe.operators.snapshots import change_type
from hearthframe.session import new_path

RUN_ID = r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"
KEY = ["source_site", "run_id", "listing_id"]


def payload_reason(sites: list[str]) -> Column:
    """First broken rule of a page, NULL when it can be ingested."""
    n, total = F.col("page_number"), F.col("total_pages")
    count, cards = F.col("advertised_count"), F.col("card_count")
    return first_reason([
        (~F.coalesce(F.col("run_id").rlike(RUN_ID), F.lit(False)), "invalid_run_id"),
        (~F.coalesce((n >= 1) & (n <= total) & (total <= 1000), F.lit(False)), "page_out_of_range"),
        (~F.coalesce(F.col("source_site").isin(*sites), F.lit(False)), "unsupported_source"),
        (~F.coalesce(count.between(1, 50000), F.lit(False)), "bad_count"),
        (~F.coalesce(cards.between(1, 50), F.lit(False)), "bad_card_count")])


class StreamTable:
    """Rows of each micro-batch of a stream and its checkpoint under one root."""

    def __init__(self, spark: SparkSession, name: str, schema: str, root: str | None = None):
        self.spark, self.schema = spark, schema
        self.root = root or new_path(spark, name)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch_id}")

    def read(self) -> DataFrame:
        """Every row with its ``batch``; empty before the first batch."""
        path = f"{self.root}/rows"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], f"{self.schema}, batch bigint")
        return self.spark.read.schema(f"{self.schema}, batch bigint").parquet(path)

    def latest(self, keys: list[str]) -> DataFrame:
        """The row of each key that the latest batch wrote."""
        rows = self.read()
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[f"r.{c}" for c in rest if c != "batch"])

    def run(self, rows: DataFrame, mode: str = "append", after=None) -> None:
        """Drain what is available; ``after(batch_id)`` is called when a batch is stored."""
        def store(batch: DataFrame, batch_id: int) -> None:
            self.write(batch, batch_id)
            if after:
                after(batch_id)
        q = (rows.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{self.root}/checkpoint")
             .trigger(availableNow=True).start())
        q.awaitTermination()


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

LISTING_STATE = ("source_site string, run_id string, listing_id bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, "
                 "last_event bigint, asking_price_sgd double, pages_seen array<int>")


def batch_rows(batch: DataFrame) -> DataFrame:
    """One row per listing key of a micro-batch."""
    newest = F.struct("observed_at", "event_id")
    return batch.groupBy(*KEY).agg(
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"),
        F.max_by("event_id", newest).alias("last_event"), F.max_by("asking_price_sgd", newest).alias("asking_price_sgd"),
        F.array_sort(F.collect_set("page_number")).alias("pages_seen"))


def merge_rows(rows: DataFrame) -> DataFrame:
    """Pages united, first sight kept, the latest card's price wins; order-free and idempotent."""
    newest = F.struct("last_seen", "last_event")
    pages = rows.select(*KEY, F.explode("pages_seen").alias("page")).distinct() \
        .groupBy(*KEY).agg(F.array_sort(F.collect_set("page")).alias("pages_seen"))
    merged = rows.groupBy(*KEY).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max_by("asking_price_sgd", newest).alias("asking_price_sgd"))
    return merged.join(pages, KEY)


def ingest_stream(stream: DataFrame, spark: SparkSession, root: str | None = None) -> DataFrame:
    """Stream of observations to merged listing rows."""
    log = StreamTable(spark, "listing-log", LISTING_STATE, root)

    q = (stream.writeStream.foreachBatch(lambda batch, batch_id: log.write(batch_rows(batch), batch_id)).option("checkpointLocation", f"{log.root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return merge_rows(log.read().drop("batch"))


# Progress --------------------------------------------------------------------------

PROGRESS = "source_site string, run_id string, share int, pages array<int>, listings bigint"


class RunPages(StatefulProcessor):
    """Pages and listings of one share of a run; forgotten when event time has passed its last sight by ``hours``."""

    def __init__(self, hours: int):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "seen boolean")
        self.listings = handle.getMapState("listings", "listing_id long", "seen boolean")
        self.facts = handle.getValueState("facts", "listings long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, timer = self.facts.get() if self.facts.exists() else (0, -1)
        latest = timer
        for part in rows:
            for page in set(part["page_number"].dropna().astype(int)):
                self.pages.updateValue((page,), (True,))
            for listing in set(part["listing_id"].dropna().astype(int)):
                if not self.listings.containsKey((listing,)):
                    self.listings.updateValue((listing,), (True,))
                    count += 1
            latest = max(latest, int(part["observed_at"].max().timestamp() * 1000) + self.hours * 3_600_000)
        if latest != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest)
        self.facts.update((count, latest))
        yield pd.DataFrame({"source_site": [key[0]], "run_id": [key[1]], "share": [key[2]],
                            "pages": [sorted(k[0] for k in self.pages.keys())], "listings": [count]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pages.clear()
        self.listings.clear()
        self.facts.clear()
        yield from ()

    def close(self) -> None:
        pass


def merge_progress(shares: DataFrame, expected_pages: int) -> DataFrame:
    """One row per run from the latest row of each of its shares."""
    run = ["source_site", "run_id"]
    saved = F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages"))))
    found = shares.groupBy(*run).agg(saved.alias("saved"), F.sum("listings").alias("unique_listing_ids"))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(expected_pages)), F.col("saved"))
    return found.select(
        *run, F.size("saved").cast("bigint").alias("saved_pages"), F.size(missing).cast("bigint").alias("missing_pages"),
        "unique_listing_ids", F.when(F.size(missing) == 0, "complete").otherwise("partial").alias("status"))


def progress_stream(stream: DataFrame, spark: SparkSession, expected_pages: int, root: str | None = None, shares: int = 8,
                    late: str = "2 days", hours: int = 24 * 14, after=None) -> DataFrame:
    """Saved pages, missing pages and distinct listings of every run, renewed by every batch.

    The listings of a run are dealt out to ``shares`` keys of state. Watermark and timers forget a run's state ``hours``
    after its last page; its rows stay in the table. ``after(table)`` sees the table of progress after each batch.
    """
    table = StreamTable(spark, "progress", PROGRESS, root)
    spark.conf.set(*STATE_STORE)
    keyed = stream.select("source_site", "run_id", F.pmod(F.hash("listing_id"), F.lit(shares)).cast("int").alias("share"), "page_number",
                          "listing_id", F.col("observed_at").cast("timestamp").alias("observed_at")).withWatermark("observed_at", late)
    rows = keyed.groupBy("source_site", "run_id", "share").transformWithStateInPandas(RunPages(hours), PROGRESS, "Update", "EventTime")

    def now() -> DataFrame:
        return merge_progress(table.latest(["source_site", "run_id", "share"]), expected_pages)
    table.run(rows, "update", (lambda _: after(now())) if after else None)
    return now()


# Changes ---------------------------------------------------------------------------

CHANGES = ("source_site string, listing_id bigint, snapshot_sequence int, run_id string, asking_price_sgd double, "
           "previous_asking_price_sgd double, was_there boolean, expired boolean")
SEEN = "snapshot_sequence int, run_id string, asking_price_sgd double, last_seen bigint, last_event bigint"


class ListingRuns(StatefulProcessor):
    """Price of one listing in each of its last ``keep`` runs, by run number.

    A listing's runs are one value of state, read and written once a batch, and rows come as rows: a batch brings a
    listing few pages, for which a data frame and a call per run would cost more than the work.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", f"runs array<struct<{SEEN.replace(' ', ':').replace(',:', ',')}>>")

    def add(self, known: dict, rows: Iterable[Row]) -> set:
        """Take in observations; the newest of each run wins. Returns the run numbers that they touch."""
        touched = set()
        for r in rows:
            old = known.get(r.snapshot_sequence)
            if old is None or old[2:] <= (r.seen_us, r.event_id):
                known[r.snapshot_sequence] = (r.run_id, r.asking_price_sgd, r.seen_us, r.event_id)
            touched.add(r.snapshot_sequence)
        return touched

    def store(self, known: dict) -> None:
        oldest = max(known) - self.keep
        self.runs.update(([(number, *known[number]) for number in sorted(known) if number > oldest],))

    def known(self) -> dict:
        value = self.runs.get()
        return {run[0]: tuple(run[1:]) for run in value[0]} if value else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.known()
        oldest = max(known) - self.keep if known else None
        touched = self.add(known, rows)
        self.store(known)
        # A late page also changes what the run after it is compared with.
        for n in sorted(touched | {n + 1 for n in touched if n + 1 in known}):
            before = known.get(n - 1)
            yield Row(source_site=key[0], listing_id=key[1], snapshot_sequence=n, run_id=known[n][0], asking_price_sgd=known[n][1],
                      previous_asking_price_sgd=before[1] if before else None, was_there=before is not None,
                      expired=oldest is not None and n - 1 <= oldest)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        known = self.known()
        self.add(known, [initialState])
        self.store(known)

    def close(self) -> None:
        pass


def change_stream(stream: DataFrame, spark: SparkSession, runs: DataFrame, root: str | None = None, initial: DataFrame | None = None,
                  keep: int = 100, after=None) -> DataFrame:
    """Each listing of a run against the run directly before it, out of the batch that brings the page.

    ``runs`` registers the runs of a site with their numbers (source_site, run_id, snapshot_sequence), 1 and up without gaps;
    pages of runs that are not registered raise an error, so that none is lost. State holds a listing's prices of its last
    ``keep`` runs; a page older than that is told as ``expired`` where its predecessor is no longer known. ``initial`` are
    observations of earlier runs, with the stream's columns, that only fill the state. A row told again, by a late page or
    a replay, replaces the former one. ``after(table)`` sees the table of changes after each batch.
    """
    table = StreamTable(spark, "changes", CHANGES, root)
    spark.conf.set(*STATE_STORE)
    columns = ["source_site", "listing_id", "snapshot_sequence", "run_id", "asking_price_sgd", "seen_us", "event_id"]
    # A page without a time counts as the earliest.
    seen = F.expr("coalesce(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(observed_at AS TIMESTAMP_NTZ)), -9223372036854775808L)")

    def numbered(df: DataFrame) -> DataFrame:
        joined = df.join(runs.select("source_site", "run_id", "snapshot_sequence"), ["source_site", "run_id"], "left")
        number = F.coalesce(F.col("snapshot_sequence").cast("int"), F.raise_error(F.concat(F.lit("run is not registered: "), "run_id")).cast("int"))
        return joined.withColumn("snapshot_sequence", number).withColumn("seen_us", seen).select(*columns)
    key = ["source_site", "listing_id"]
    rows = numbered(stream).groupBy(*key).transformWithState(
        ListingRuns(keep), CHANGES, "Update", "None", initialState=numbered(initial).groupBy(*key) if initial is not None else None)

    def now() -> DataFrame:
        x = table.latest([*key, "snapshot_sequence"])
        price, previous = F.col("asking_price_sgd"), F.col("previous_asking_price_sgd")
        kind = F.when(F.col("expired") & ~F.col("was_there"), "expired").otherwise(change_type(F.col("was_there"), price, previous))
        return x.select(*KEY, "snapshot_sequence", "asking_price_sgd", "previous_asking_price_sgd", (price - previous).alias("price_change_sgd"),
                        kind.alias("change_type"))
    table.run(rows, "update", (lambda _: after(now())) if after else None)
    return now()
