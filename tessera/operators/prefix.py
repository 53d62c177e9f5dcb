"""Running sums within groups of any size, without a sorted task a group.

Rows are dealt by range of group and order, so a large group spans many
partitions. Each partition sums up what it holds of a group; the sums of the
partitions before it, as many as there are partitions, are joined back, and only
a partition's own rows are summed up one by one. Rows of a group whose order is
equal lie in one partition; give an order without ties where their sums matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.staging import staged


def sums_before(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of the expression over the group's rows before this one; zero before the first.

    Null keys are a group; nulls sum as zero.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumns({f"_{name}_": F.coalesce(value, F.lit(0)) for name, value in sums.items()})
    keyed = valued.withColumn("_group_", F.struct(*by) if by else F.struct(F.lit(0)))  # never null itself, so that null keys meet in joins
    dealt = staged(keyed.repartitionByRange(n, *by, *order).withColumn("_part_", F.spark_partition_id()), "dealt")
    totals = dealt.groupBy("_group_", "_part_").agg(*(F.sum(f"_{name}_").alias(name) for name in sums))
    before = W.partitionBy("_group_").orderBy("_part_").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition that the group is in
    bases = totals.select("_group_", "_part_", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}_base_") for name in sums))
    own = W.partitionBy("_part_", "_group_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(bases, ["_part_", "_group_"])
    out = out.withColumns({name: F.col(f"_{name}_base_") + F.coalesce(F.sum(f"_{name}_").over(own), F.lit(0)) for name in sums})
    return out.select(*rows.columns, *sums)
