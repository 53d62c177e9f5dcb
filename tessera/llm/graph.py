"""Connected components by labels, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import erase, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches; a written table.

    Every round gives a node the least label among its neighbours and itself,
    then that label's own label, so long paths shorten by half or better.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        at = labels.select(F.col("u").alias("v"), F.col("label").alias("of_v"))
        seen = both.join(at, "v").groupBy("u").agg(F.min("of_v").alias("near"))
        stepped = labels.join(seen, "u").select("u", "label", F.least("label", "near").alias("step"))
        jump = labels.select(F.col("u").alias("step"), F.col("label").alias("far"))
        new = written(stepped.join(jump, "step", "left").select("u", F.least("step", F.coalesce("far", "step")).alias("label"), (F.least("step", F.coalesce("far", "step")) < F.col("label")).alias("moved")), "labels")
        erase(labels)
        if new.where("moved").isEmpty():
            erase(both)
            return new.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = new
