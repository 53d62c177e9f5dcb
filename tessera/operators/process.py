"""Process mining over event logs: cases, order, directly-follows, next states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def event_order(case: str, ts: str, ordinal: str):
    """Stamped events first, by time, then by ordinal; unstamped ones last."""
    return W.partitionBy(case).orderBy(F.col(ts).asc_nulls_last(), F.col(ordinal))


def follows(events: DataFrame, case: str, activity: str, ts: str, ordinal: str) -> DataFrame:
    """(activity, next_activity, n) over adjacent events with an activity."""
    named = events.where(F.col(activity).isNotNull())
    pairs = named.select(F.col(activity).alias("activity"), F.lead(activity).over(event_order(case, ts, ordinal)).alias("next_activity"))
    return pairs.where("next_activity is not null").groupBy("activity", "next_activity").agg(F.count("*").alias("n"))


def cases(events: DataFrame, case: str, activity: str, ts: str, ordinal: str) -> DataFrame:
    """One row a case: counts, bounds in time, duration, the ordered activities and those at the ends."""
    entry = F.struct(F.col(ts).isNull().alias("late"), F.col(ts).alias("ts"), F.col(ordinal).alias("ordinal"), F.col(activity).alias("activity"))
    rows = events.groupBy(F.col(case).alias("case_id")).agg(F.count("*").alias("n_events"), F.min(ts).alias("started"), F.max(ts).alias("ended"), F.sort_array(F.collect_list(entry)).alias("entries"))
    named = F.filter(F.transform("entries", lambda e: e["activity"]), lambda a: a.isNotNull())
    seconds = F.round((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6, 6)
    out = rows.withColumn("activities", named).withColumn("duration_s", seconds)
    return out.withColumns({"first_activity": F.try_element_at("activities", F.lit(1)), "current_state": F.try_element_at("activities", F.lit(-1)), "unique_activities": F.array_distinct("activities")}).drop("entries")


def ranked(counts: DataFrame, by: str, n: str = "n", within: str | None = None) -> DataFrame:
    """Adds ``rank`` by falling count, then name."""
    window = (W.partitionBy(within) if within else W.partitionBy(F.lit(1))).orderBy(F.desc(n), by)
    return counts.withColumn("rank", F.row_number().over(window))


def allowed_next(edges: DataFrame) -> DataFrame:
    """For each activity its successors, most frequent first."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("next_activity").alias("to"))))
    return edges.groupBy("activity").agg(F.array_join(F.transform(ordered, lambda e: e["to"]), ",").alias("next_states"))


def first_reference(events: DataFrame, case: str, ts: str, ordinal: str, value: Column) -> DataFrame:
    """The first non-empty value in each case's order."""
    entry = F.struct(F.col(ts).isNull(), F.col(ts), F.col(ordinal))
    return events.withColumn("_v_", F.when(value != "", value)).where("_v_ is not null").groupBy(case).agg(F.min_by("_v_", entry).alias("reference"))
