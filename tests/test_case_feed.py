"""The feed of case changes: equal to a batch rebuild, late rows one by one, deletion, closing, restart and replay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.streaming.changes import CaseFeed, file_stream

FIELDS = "event_id long, case_id long, activity string, ts timestamp, op string"
DAY = dt.datetime(2024, 1, 1)


def at(days):
    return DAY + dt.timedelta(days=days)


def add(spark, path, *rows):
    spark.createDataFrame([(e, c, a, None if d is None else at(d), op) for e, c, a, d, op in rows], FIELDS).coalesce(1).write.mode("append").parquet(path)


def held(feed):
    return {r["case_id"]: (r["n_events"], r["current_state"], r["status"]) for r in feed.cases().collect()}


def test_feed_of_changes(spark, tmp_path):
    inputs, path = f"{tmp_path}/in", f"file://{tmp_path}/feed"
    feed = CaseFeed(spark, path, "1 day", "20 days", 4)
    add(spark, inputs, (1, 1, "a", 0, "insert"), (2, 1, "b", 2, "insert"), (3, 2, "a", 1, "insert"), (4, 3, "x", 2, "insert"), (None, 9, "x", 2, "insert"))
    feed.start(file_stream(spark, inputs, FIELDS), f"{tmp_path}/at").awaitTermination(120)
    assert held(feed) == {1: (2, "b", "open"), 2: (1, "a", "open"), 3: (1, "x", "open")}
    # the watermark is day 1: an event of day 1 is late, one of day 1.5 is not; an update, and a case whose only event goes
    add(spark, inputs, (5, 1, "c", 1.5, "insert"), (6, 2, "late", 1, "insert"), (2, 1, "B", 2.5, "update"), (4, 3, "x", 2.5, "delete"))
    feed = CaseFeed(spark, path, "1 day", "20 days", 4)  # a restart
    feed.start(file_stream(spark, inputs, FIELDS), f"{tmp_path}/at").awaitTermination(120)
    assert held(feed) == {1: (3, "B", "open"), 2: (1, "a", "open"), 3: (0, None, "deleted")}
    add(spark, inputs, (7, 4, "z", 22.5, "insert"), (8, 2, "late", 0.5, "delete"))
    feed.start(file_stream(spark, inputs, FIELDS), f"{tmp_path}/at").awaitTermination(120)
    assert held(feed)[2] == (1, "a", "closed") and held(feed)[1] == (3, "B", "open") and held(feed)[4] == (1, "z", "open")
    assert {r["case_id"] for r in feed.state.read().collect()} == {1, 4}, "closed and deleted cases leave the state"
    assert sorted((r["event_id"], r["reason"]) for r in feed.late().where("event_id is not null").collect()) == [(6, "late"), (8, "late")]
    assert feed.late().groupBy("reason").count().collect() and feed.late().where("reason = 'incomplete'").count() == 1
    before, versions = held(feed), feed.state.versions()
    feed.apply(spark.read.schema(FIELDS).parquet(inputs), 2)  # a replayed batch changes nothing
    assert held(feed) == before and feed.state.versions() == versions


@pytest.mark.parametrize("broken", [False, True])
def test_feed_equals_a_batch_rebuild(spark, tmp_path, broken):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("user_id").alias("case_id"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("ts"), F.lit("insert").alias("op"))
    rows = events.orderBy("ts").collect()
    feed = CaseFeed(spark, f"file://{tmp_path}/feed", "3650 days", "36500 days", 4)
    for n in range(2):
        part = spark.createDataFrame(rows[n::2], FIELDS)
        if broken and n:
            done, feed.batches._commit = feed.batches._commit, lambda *_: 1 / 0
            with pytest.raises(ZeroDivisionError):
                feed.apply(part, n)
            feed.batches._commit = done
        feed.apply(part, n)
    want = {r["case_id"]: (r["n"], r["s"], "open") for r in events.groupBy("case_id").agg(F.count("*").alias("n"), F.max_by("activity", F.struct("ts", "event_id")).alias("s")).collect()}
    assert held(feed) == want and feed.late().count() == 0
