"""Exact order statistics of any group, without sorting or listing it.

The values between a group's ends are counted in equal bins; the bin that holds
the wanted rank becomes the next interval, with its own smallest and largest
value as ends. Each pass keeps at most ``BINS`` counts a rank, whatever the
group's size, and ends when an interval holds one value or ``FEW`` rows; those
are then ranked. A thousand million values take three passes.

Nulls and NaN are not counted; a group without values has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.staging import staged

BINS, FEW = 4096, 4096


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """A row a group: ``by``, ``n`` and the value at each rank (from 0), an expression of the group's ``n``.

    Ranks beyond the group give null. Without ``by``, one row for all.
    """
    keys = [f"_by{i}_" for i in range(len(by))] or ["_by0_"]
    named = [F.struct(F.col(c)).alias(k) for c, k in zip(by, keys, strict=False)] or [F.struct(F.lit(0)).alias("_by0_")]
    # a struct is never null itself, so null keys meet in plain joins
    base = rows.select(*named, F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    ends = staged(base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "ends")
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
    found = ends.select(*keys, "n", "lo", "hi", wanted.alias("w")).select(*keys, "n", "w.*", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).where("rank >= 0 and rank < n")
    found = staged(found, "ranks")
    while found.where(_open()).limit(1).count():
        found = staged(_narrowed(base, found, keys), "ranks")
    done = found.where("lo = hi").select(*keys, "name", F.col("lo").alias("at"))
    few = base.join(_intervals(found.where("lo < hi"), keys), keys).where("x between lo and hi")
    places = few.withColumn("place", F.row_number().over(W.partitionBy(*keys, "lo", "hi").orderBy("x")) - 1)
    left = found.where("lo < hi").join(places, [*keys, "lo", "hi"]).where("place = rank - below").select(*keys, "name", F.col("x").alias("at"))
    values = done.unionByName(left).groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("at"))).alias(name) for name in ranks))
    return ends.select(*keys, "n").join(values, keys, "left").select(*(F.col(k)[c].alias(c) for c, k in zip(by, keys, strict=False)), "n", *ranks)


def _open() -> Column:
    return (F.col("lo") < F.col("hi")) & (F.col("inside") > FEW)


def _intervals(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(*keys, "lo", "hi").distinct()


def _narrowed(base: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``found`` with each open interval replaced by the bin of it that holds the rank."""
    half = F.col("hi") / 2 - F.col("lo") / 2  # halves, so that no difference leaves the range of doubles
    number = F.least(F.lit(BINS - 1), F.floor((F.col("x") / 2 - F.col("lo") / 2) / half * BINS)).cast("int")
    inside = base.join(_intervals(found.where(_open()), keys), keys).where("x between lo and hi")
    bins = inside.groupBy(*keys, "lo", "hi", number.alias("bin")).agg(F.count("*").alias("held"), F.min("x").alias("low"), F.max("x").alias("high"))
    before = W.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    rank = F.col("rank") - F.col("below")
    moved = found.where(_open()).join(bins, [*keys, "lo", "hi"]).where((rank >= F.col("before")) & (rank < F.col("before") + F.col("held")))
    moved = moved.select(*keys, "n", "name", "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("held").alias("inside"))
    return found.where(~_open()).unionByName(moved)


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """A row a group: ``by``, ``n`` and each quantile, between neighbours in proportion."""
    where = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in at.items()}
    ranks = {f"{name}_{side}": f(place) for name, place in where.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    found = order_statistics(rows, by, value, ranks)
    between = [(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (place - F.floor(place))).alias(name) for name, place in where.items()]
    return found.select(*by, "n", *between)
