"""Streams with keyed state: rows after each batch, restarts, late pages, expiry, state from earlier runs."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from hearthframe.operators.snapshots import merge_cards, snapshot_changes
from hearthframe.streaming import pages as P

SCHEMA = "source_site string, run_id string, listing_id long, event_id long, asking_price_sgd double, observed_at timestamp_ntz, page_number int"
DAY = dt.datetime(2024, 1, 1)


def card(event, run, listing, price, day, page=1, site="s"):
    return site, f"R{run}", listing, event, price, DAY + dt.timedelta(days=day), page


BATCHES = [
    [card(1, 1, 10, 100.0, 0), card(2, 1, 11, 200.0, 0, 2), card(3, 1, 10, 101.0, 0, 2)],
    [card(4, 2, 10, 90.0, 7), card(5, 2, 12, 300.0, 7, 2), card(6, 1, 13, 50.0, 1, 3)],
    [card(7, 3, 10, 95.0, 14), card(8, 3, 11, None, 14, 2), card(9, 3, 12, 300.0, 14, 3), card(10, 2, 13, 60.0, 8, 3)]]
RUNS = [("s", f"R{i}", i) for i in (1, 2, 3, 4)]


class Feed:
    """A folder in which files arrive one after the other."""

    def __init__(self, spark):
        self.spark, self.path = spark, tempfile.mkdtemp(prefix="feed-") + "/in"

    def put(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)


def batch_changes(spark, rows):
    found = snapshot_changes(merge_cards(spark.createDataFrame(rows, SCHEMA))).drop("observed_at")
    return sorted(map(tuple, found.collect()))


def runs_of(spark):
    return spark.createDataFrame(RUNS, "source_site string, run_id string, snapshot_sequence int")


def test_changes_come_out_of_each_batch_and_survive_restarts(spark):
    feed, root, seen, states = Feed(spark), tempfile.mkdtemp(prefix="changes-"), [], []
    for rows in BATCHES[:2]:
        feed.put(rows)
    first = lambda table: states.append(sorted(map(tuple, table.collect())))
    P.change_stream(feed.stream(), spark, runs_of(spark), root, after=first)
    feed.put(BATCHES[2])
    P.change_stream(feed.stream(), spark, runs_of(spark), root, after=first)
    assert len(states) == 3
    for i, state in enumerate(states):
        seen += BATCHES[i]
        assert state == batch_changes(spark, seen)
    # Nothing new: the table of a third run is the same.
    again = P.change_stream(feed.stream(), spark, runs_of(spark), root)
    assert sorted(map(tuple, again.collect())) == states[-1] and len(states) == 3


def test_state_from_earlier_runs(spark):
    feed = Feed(spark)
    for rows in BATCHES[1:]:
        feed.put(rows)
    told = P.change_stream(feed.stream(), spark, runs_of(spark), initial=spark.createDataFrame(BATCHES[0], SCHEMA))
    got = {tuple(r) for r in told.collect()}
    whole = set(batch_changes(spark, sum(BATCHES, [])))
    touched = {(r[1], r[2]) for rows in BATCHES[1:] for r in rows}
    assert got == {r for r in whole if (r[1], r[2]) in touched}


def test_expiry_and_unregistered_runs(spark):
    feed = Feed(spark)
    feed.put([card(1, 1, 10, 100.0, 0)])
    feed.put([card(2, 4, 10, 90.0, 21)])
    feed.put([card(3, 2, 10, 80.0, 8)])
    got = {r.snapshot_sequence: r.change_type for r in P.change_stream(feed.stream(), spark, runs_of(spark), keep=2).collect()}
    assert got == {1: "new", 4: "new", 2: "expired"}
    feed = Feed(spark)
    feed.put([card(1, 9, 10, 100.0, 0)])
    with pytest.raises(Exception, match="not registered"):
        P.change_stream(feed.stream(), spark, runs_of(spark))


def test_progress_after_each_page_and_restart(spark):
    feed, root, states = Feed(spark), tempfile.mkdtemp(prefix="progress-"), []
    keep = lambda table: states.append({r.run_id: (r.saved_pages, r.missing_pages, r.unique_listing_ids, r.status) for r in table.collect()})
    feed.put(BATCHES[0])
    feed.put(BATCHES[1])
    P.progress_stream(feed.stream(), spark, 3, root, after=keep)
    feed.put(BATCHES[2])
    P.progress_stream(feed.stream(), spark, 3, root, after=keep)
    assert states[0] == {"R1": (2, 1, 2, "partial")}
    assert states[1] == {"R1": (3, 0, 3, "complete"), "R2": (2, 1, 2, "partial")}
    assert states[-1] == {"R1": (3, 0, 3, "complete"), "R2": (3, 0, 3, "complete"), "R3": (3, 0, 3, "complete")}
    # State is forgotten long after a run's last page, its row stays.
    feed.put([card(20, 4, 10, 1.0, 200)])
    feed.put([card(21, 4, 11, 1.0, 201, 2)])
    P.progress_stream(feed.stream(), spark, 3, root, after=keep)
    assert states[-1]["R1"] == (3, 0, 3, "complete") and states[-1]["R4"] == (2, 1, 2, "partial")


def test_ingest_goes_on_in_the_same_folder(spark):
    feed, root = Feed(spark), tempfile.mkdtemp(prefix="ingest-")
    feed.put(BATCHES[0])
    P.ingest_stream(feed.stream(), spark, root)
    feed.put(BATCHES[1])
    feed.put(BATCHES[2])
    got = P.ingest_stream(feed.stream(), spark, root)
    want = merge_cards(spark.createDataFrame(sum(BATCHES, []), SCHEMA))
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert rows(got) == rows(want)
    assert P.StreamTable(spark, "x", P.CHANGES).read().filter(F.lit(True)).collect() == []


def test_slices_of_time_are_written_and_read_by_several_tasks(spark):
    from hearthframe.plans.streams import timed_stream
    folder, batches = tempfile.mkdtemp(prefix="events-"), []
    rows = [(i, DAY + dt.timedelta(hours=i), i % 7, "view", float(i), '{"k": 1}') for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{folder}/events.parquet")

    def take(batch, _):
        got = batch.select("event_id", "file").collect()
        batches.append((len({r.file for r in got}), sorted(r.event_id for r in got)))
    stream = timed_stream(spark, folder, slices=2, rows_per_file=50).withColumn("file", F.input_file_name())
    stream.writeStream.foreachBatch(take).option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start().awaitTermination()
    assert [ids for _, ids in batches] == [list(range(200)), list(range(200, 400))]
    assert all(files > 1 for files, _ in batches)
