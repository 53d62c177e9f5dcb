"""Incremental synchronisation over durable cursors: extraction, changes, checkpoints, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def after(rows: DataFrame, ts: str, tie: str, watermark: str | None, tie_value: int | None = None) -> DataFrame:
    """Rows beyond a cursor: later, or as late with a larger tie-breaker. Plain comparisons, so they reach the scan."""
    if watermark is None:
        return rows
    at = F.lit(watermark).cast(rows.schema[ts].dataType)
    beyond = F.col(ts) > at
    return rows.where(beyond if tie_value is None else beyond | ((F.col(ts) == at) & (F.col(tie) > tie_value)))


def batch(rows: DataFrame, ts: str, tie: str, size: int) -> DataFrame:
    return rows.orderBy(ts, tie).limit(size)


def operation(deleted: Column, first: bool) -> Column:
    return F.when(F.lower(deleted.cast("string")).isin("true", "1", "t"), "delete").otherwise("insert" if first else "update")


def merged(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins by key; a written table is never overwritten in place."""
    at = W.partitionBy(key).orderBy(F.desc(order), F.desc("_new_"))
    both = current.withColumn("_new_", F.lit(0)).unionByName(incoming.withColumn("_new_", F.lit(1)))
    return both.withColumn("_r_", F.row_number().over(at)).where("_r_ = 1").drop("_r_", "_new_")


def checkpoints(changes: DataFrame, run: str, order: str, failed: Column, policy: str) -> DataFrame:
    """(run, applied, checkpoint): BLOCK stops at the first failure, QUARANTINE goes on but keeps the cursor before it, SKIP passes it."""
    first = F.min(F.when(failed, F.col(order))).over(W.partitionBy(run))
    rows = changes.withColumn("_first_", first).withColumn("_failed_", failed)
    before = F.col("_first_").isNull() | (F.col(order) < F.col("_first_"))
    applied = {"BLOCK": before, "QUARANTINE": ~F.col("_failed_"), "SKIP": ~F.col("_failed_")}[policy]
    passed = F.lit(True) if policy == "SKIP" else before
    return rows.groupBy(run).agg(F.count_if(applied).alias("applied"), F.max(F.when(passed, F.col(order))).alias("checkpoint"))


def retired(current: DataFrame, item: str) -> DataFrame:
    """(item, state, cleanup_pending): every current row of a slot superseded, awaiting cleanup; a deleted record leaves none."""
    return current.select(item, F.lit("superseded").alias("state"), F.lit(True).alias("cleanup_pending"))


def replaced(current: DataFrame, incoming: DataFrame, slot: str, item: str) -> DataFrame:
    """(slot, item, outcome): promoted, superseded or unchanged, slot by slot that arrives."""
    a, b = current.select(slot, item, F.lit(True).alias("_old_")), incoming.select(slot, item, F.lit(True).alias("_new_"))
    arriving = incoming.select(slot).distinct()
    both = a.join(arriving, slot, "left_semi").join(b, [slot, item], "full")
    return both.select(slot, item, F.when(F.col("_old_").isNull(), "promoted").when(F.col("_new_").isNull(), "superseded").otherwise("unchanged").alias("outcome"))


def embedding_status(rows: DataFrame, content: str, was: str) -> DataFrame:
    """Adds ``status``: EMPTY_CONTENT, SKIPPED_UNCHANGED where the content has the hash that the ledger holds, else GENERATED."""
    now = F.sha2(F.col(content), 256)
    empty = F.btrim(F.coalesce(F.col(content), F.lit(""))) == ""
    return rows.withColumn("status", F.when(empty, "EMPTY_CONTENT").when(F.coalesce(now == F.col(was), F.lit(False)), "SKIPPED_UNCHANGED").otherwise("GENERATED"))


def identity_issues(rows: DataFrame, key: str, stored: str, derived: Column) -> DataFrame:
    """(key, issue): WRONG_ID where the stored id is not the one derived from the key, ID_TAKEN where another row lies under it."""
    named = rows.select(key, F.col(stored).alias("_stored_"), derived.alias("_derived_"))
    taken = named.where(~F.col("_stored_").eqNullSafe(F.col("_derived_"))).select(F.col("_stored_").alias("_derived_"), F.lit(True).alias("_taken_")).where("_derived_ is not null").distinct()
    issue = F.when(~F.col("_stored_").eqNullSafe(F.col("_derived_")), "WRONG_ID").when(F.col("_taken_"), "ID_TAKEN")
    return named.join(taken, "_derived_", "left").select(key, issue.alias("issue")).where("issue is not null")
