"""Fingerprints of sets that do not depend on the order in which members come.

A tree of two levels: members fall into ranges by the beginning of their hash, a
range's digest is that of its members in order, the set's digest that of its
ranges in order. No task sees more of a set than a range, ``1 / 16**DIGITS`` of
it, and two versions of a set are compared range by range, so members are looked
at only where something changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits that name a range: 4,096 ranges a set.
DIGITS = 3


def range_of(member: Column) -> Column:
    return F.substring(F.sha2(member, 256), 1, DIGITS)


def ranges(members: DataFrame, by: str, member: Column) -> DataFrame:
    """(by, range, n, digest) of the distinct members; null members are left out."""
    rows = members.select(by, member.cast("string").alias("member")).where("member is not null").distinct().withColumn("range", range_of(F.col("member")))
    return rows.groupBy(by, "range").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("member")), "|"), 256).alias("digest"))


def of_sets(digests: DataFrame, by: str) -> DataFrame:
    """(by, n, fingerprint) from ``ranges``."""
    entry = F.struct("range", "digest")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.concat_ws(":", x["range"], x["digest"])), "|")
    return digests.groupBy(by).agg(F.sum("n").alias("n"), F.sha2(listed, 256).alias("fingerprint"))


def changed_ranges(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """(by, range) where the digests differ or only one side has members."""
    a, b = (x.select(by, "range", F.col("digest").alias(d)) for x, d in ((old, "was"), (new, "now")))
    return a.join(b, [by, "range"], "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(by, "range")


def changes(old: DataFrame, new: DataFrame, by: str, key: str, content: Column) -> DataFrame:
    """(by, key, operation) between two versions of sets of keyed contents; only changed ranges are compared."""
    # a range is chosen by key, so that both versions of a row fall into the same one
    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select(by, key, content.alias("content")).withColumn("range", range_of(F.col(key).cast("string")))

    def digests(rows: DataFrame) -> DataFrame:
        pair = F.concat_ws("=", F.col(key).cast("string"), "content")
        return rows.groupBy(by, "range").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(pair)), "|"), 256).alias("digest"))

    before, after = keyed(old), keyed(new)
    moved = changed_ranges(digests(before), digests(after), by)
    a = before.join(moved, [by, "range"], "left_semi").select(by, key, F.col("content").alias("was"), F.lit(True).alias("there"))
    b = after.join(moved, [by, "range"], "left_semi").select(by, key, F.col("content").alias("now"), F.lit(True).alias("here"))
    kind = F.when(F.col("there").isNull(), "insert").when(F.col("here").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("now")), "update")
    return a.join(b, [by, key], "full").select(by, key, kind.alias("operation")).where("operation is not null")
