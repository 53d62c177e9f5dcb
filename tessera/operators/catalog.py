"""Field catalogs: listing, versions, differences, drift and their effect on mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

COMMON = {"bigint": "integer", "int": "integer", "double": "decimal", "string": "string", "timestamp_ntz": "datetime", "boolean": "boolean"}


def listing(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, field, type, position) of every column."""
    rows = [(t, f.name, COMMON.get(f.dataType.simpleString(), "array" if "array" in f.dataType.simpleString() else "unknown"), i) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "entity string, field string, type string, position int")


def diff(old: DataFrame, new: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """(entity, field, change, attribute, before, after): added, removed, or one row for each changed attribute."""
    keys = ["entity", "field"]
    a = old.select(*keys, F.lit(True).alias("_old_"), *[F.col(c).cast("string").alias(f"_old_{c}") for c in attributes])
    b = new.select(*keys, F.lit(True).alias("_new_"), *[F.col(c).cast("string").alias(f"_new_{c}") for c in attributes])
    both = a.join(b, keys, "full")
    none = F.lit(None).cast("string")

    def row(when, change, attribute, before, after):
        return F.when(when, F.struct(F.lit(change).alias("change"), attribute.alias("attribute"), before.alias("before"), after.alias("after")))

    changes = [row(F.col("_old_").isNull(), "added", none, none, none), row(F.col("_new_").isNull(), "removed", none, none, none)]
    changes += [row(F.col("_old_") & F.col("_new_") & ~F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")), "changed", F.lit(c), F.col(f"_old_{c}"), F.col(f"_new_{c}")) for c in attributes]
    return both.select(*keys, F.inline(F.filter(F.array(*changes), lambda x: x.isNotNull())))


def drift(changes: DataFrame) -> DataFrame:
    """Adds ``drift`` and ``severity``: removed fields and types that don't widen block, added ones inform."""
    widens = (F.col("before") == "integer") & (F.col("after") == "decimal") | (F.col("before") == "date") & (F.col("after") == "datetime")
    kind = F.when(F.col("change") == "added", "FIELD_ADDED").when(F.col("change") == "removed", "FIELD_REMOVED").when((F.col("attribute") == "type") & widens, "TYPE_WIDENED").when(F.col("attribute") == "type", "TYPE_CHANGED").otherwise("ATTRIBUTE_CHANGED")
    out = changes.withColumn("drift", kind)
    return out.withColumn("severity", F.when(F.col("drift").isin("FIELD_REMOVED", "TYPE_CHANGED"), "breaking").when(F.col("drift") == "ATTRIBUTE_CHANGED", "warning").otherwise("info"))


def versions(snapshots: DataFrame, scope: str, order: str, digest: str) -> DataFrame:
    """Adds ``version``: it rises with each snapshot whose hash differs from its predecessor's."""
    at = W.partitionBy(scope).orderBy(order)
    new = (~F.col(digest).eqNullSafe(F.lag(digest).over(at))).cast("int")
    return snapshots.withColumn("_new_", new).withColumn("version", F.sum("_new_").over(at).cast("int")).drop("_new_")
