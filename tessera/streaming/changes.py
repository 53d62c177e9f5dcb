"""Structured Streaming: change feeds merged by micro-batch, event-time windows, and cases kept as a
state that ends.

Each function takes a streaming frame and returns one, or starts a query that
keeps its place in the checkpoint folder it is given, so a restart goes on
where the last batch was committed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window as W

from tessera.operators.staging import staged
from tessera.sources.versioned import Snapshot, VersionedTable


def file_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def tumbling(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by window and key; with ``slide`` the windows overlap. Rows later than ``late`` are dropped when streaming."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    window = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def merge_stream(changes: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands every micro-batch to ``apply`` with its number, which makes the write idempotent, until none is left."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class CaseFeed:
    """Cases rebuilt from a feed of event changes, with a state that ends.

    A change is (event_id, case_id, activity, ts, op), ``op`` being insert, update or delete. A
    batch's changes join the open events of the cases they touch; those cases are made anew and
    written with their status: ``open``; ``deleted`` where no event is left; ``closed`` once a
    case has been idle for ``idle`` before the watermark, and then its events leave the state.
    Changes as old as the watermark or older are not applied, for their case may be gone; they
    are kept, all of them, in an output of their own. The watermark is the latest time of earlier
    batches less ``delay``, so a replayed batch treats every row as it did at first.

    Everything lies under ``path``: ``state`` (a versioned table of open events by case),
    ``cases/batch=n``, ``late/batch=n`` and ``batches/n.json``, which is created last and once; a
    batch that was broken off is done again and overwrites what it had written. Of several changes
    of an event in one batch the latest stays. Rows without a case, an id or a time are late rows
    with the reason ``incomplete``.
    """

    def __init__(self, spark: SparkSession, path: str, delay: str = "1 day", idle: str = "30 days", n_buckets: int = 16) -> None:
        self.spark, self.path, self.delay, self.idle = spark, path.rstrip("/"), delay, idle
        self.state = VersionedTable(spark, f"{self.path}/state", "case_id", n_buckets)
        self.batches = VersionedTable(spark, f"{self.path}/batches", "n")

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return merge_stream(changes, checkpoint, self.apply)

    def cases(self) -> DataFrame:
        """Each case as its last batch left it."""
        rows = self.spark.read.parquet(f"{self.path}/cases").groupBy("case_id").agg(F.max_by(F.struct("n_events", "current_state", "last_at", "status"), "batch").alias("c"))
        return rows.select("case_id", "c.*")

    def late(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/late")

    def apply(self, batch: DataFrame, number: int) -> None:
        done = self.batches.snapshot()
        held = json.loads(done.schema) if done else {"batch": -1, "watermark": None, "state": None}
        if held["batch"] >= number:
            return
        watermark = F.lit(held["watermark"]).cast("timestamp")
        incomplete = F.col("event_id").isNull() | F.col("case_id").isNull() | F.col("ts").isNull()
        reason = F.when(incomplete, "incomplete").when(F.col("ts") <= watermark, "late")
        rows = staged(batch.select("event_id", "case_id", "activity", "ts", "op").withColumn("reason", reason), "changes")
        rows.where("reason is not null").write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        last = W.partitionBy("case_id", "event_id").orderBy(F.desc("ts"), F.col("op") == "delete", F.desc("activity"))
        fresh = staged(rows.where("reason is null").withColumn("turn", F.row_number().over(last)).where("turn = 1").drop("turn", "reason"), "fresh")
        latest = fresh.agg(F.max("ts").alias("ts")).select(F.greatest(F.expr(f"ts - interval {self.delay}"), watermark).cast("string").alias("at")).collect()[0]["at"]  # one value
        if self.state.snapshot() is None:
            self.state.create(fresh.select("event_id", "case_id", "activity", "ts").limit(0))
        base = self.state.snapshot(held["state"]) if held["state"] is not None else self.state.snapshot(0)
        before = self.state.read(base)
        idle = F.expr(f"timestamp '{latest}' - interval {self.idle}") if latest else F.lit(None).cast("timestamp")
        # what may end: cases without a change whose last event is long past; only their keys and times are read
        resting = before.groupBy("case_id").agg(F.max("ts").alias("last_at")).where(F.col("last_at") <= idle).select("case_id")
        concerned = staged(self.state.bucket_of(fresh.select("case_id").unionByName(resting).distinct()), "concerned")
        touched = [r["bucket"] for r in concerned.select("bucket").distinct().collect()]  # buckets
        stored = self.state.read(base, touched)
        kept = stored.join(fresh.select("case_id", "event_id"), ["case_id", "event_id"], "left_anti")
        events = staged(kept.unionByName(fresh.where("op <> 'delete'").select(*kept.columns)), "events")
        made = events.join(concerned.select("case_id"), "case_id", "left_semi").groupBy("case_id").agg(F.count("*").alias("n_events"), F.max_by("activity", F.struct("ts", "event_id")).alias("current_state"), F.max("ts").alias("last_at"))
        out = concerned.select("case_id").join(made, "case_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
        out = staged(out.withColumn("status", F.when(F.col("n_events") == 0, "deleted").when(F.col("last_at") <= idle, "closed").otherwise("open")), "cases")
        out.write.mode("overwrite").parquet(f"{self.path}/cases/batch={number}")
        left = events.join(out.where("status = 'closed'").select("case_id"), "case_id", "left_anti")
        after = base
        if touched:
            ahead = [v for v in self.state.versions() if v > base.number]  # of a batch that was broken off
            after = self.state.replace(Snapshot(ahead[-1], base.schema, base.buckets) if ahead else base, left, touched)
        self.batches._commit(done, json.dumps({"batch": number, "watermark": latest or held["watermark"], "state": after.number}), {})
