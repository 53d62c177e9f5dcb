"""Sealed archives of vectors: a readable header, and a body that opens only with it.

The header says format, owner and dimension, and is the sealed body's associated
data, so a body under another header, an altered header or an altered body does
not open. What opens must agree with its header besides. An archive that does
not open is refused with a reason; it never raises and never returns a vector.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SETTING = "spark.tessera.archiveKey"
FORMAT = 1


def key(spark: SparkSession) -> Column:
    """The key that a deployment puts into the session's setting, 32 characters. Without one, only a local session goes
    on, with a key of its own that no later session can open."""
    if spark.conf.get(KEY_SETTING, None) is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {KEY_SETTING}: archives sealed with a passing key could not be opened again")
        spark.conf.set(KEY_SETTING, secrets.token_hex(16))
    return F.lit(spark.conf.get(KEY_SETTING))


def passing_key(spark: SparkSession) -> Column:
    """A key for what is sealed and opened within one query, on any cluster: the setting's, or else one made for this call and
    kept nowhere. Seal and open with the same returned column; for what is to be opened later, take ``key``."""
    return F.lit(spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16))


def sealed(owner: Column, vector: Column, secret: Column) -> Column:
    """struct<header, body> of a vector."""
    header = F.to_json(F.struct(F.lit(FORMAT).alias("format"), owner.cast("string").alias("owner"), F.size(vector).alias("dimension")))
    body = F.to_json(F.struct(owner.cast("string").alias("owner"), vector.cast("array<double>").alias("vector")))
    return F.struct(header.alias("header"), F.aes_encrypt(body, secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), header).alias("body"))


def opened(archives: DataFrame, archive: str, owner: str, secret: Column) -> DataFrame:
    """Adds ``vector`` (array of doubles) and ``refused``: FORMAT, OWNER, SEAL, IDENTITY or DIMENSION, or null."""
    said = F.from_json(F.col(archive)["header"], "format int, owner string, dimension int")
    body = F.try_aes_decrypt(F.col(archive)["body"], secret, F.lit("GCM"), F.lit("DEFAULT"), F.col(archive)["header"]).cast("string")
    rows = archives.withColumns({"_said_": said, "_open_": F.from_json(body, "owner string, vector array<double>")})
    refused = (
        F.when(~F.col("_said_.format").eqNullSafe(F.lit(FORMAT)), "FORMAT").when(~F.col("_said_.owner").eqNullSafe(F.col(owner).cast("string")), "OWNER")
        .when(F.col("_open_.vector").isNull(), "SEAL").when(~F.col("_open_.owner").eqNullSafe(F.col("_said_.owner")), "IDENTITY").when(F.size("_open_.vector") != F.col("_said_.dimension"), "DIMENSION")
    )
    rows = rows.withColumn("refused", refused)
    return rows.withColumn("vector", F.when(F.col("refused").isNull(), F.col("_open_.vector"))).drop("_said_", "_open_")
