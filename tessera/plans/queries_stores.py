"""Queries of placement with carried-over state, archives, migrations and schema texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import humanized
from tessera.operators import catalog
from tessera.plans.queries_catalog import tier_state
from tessera.plans.registry import query

SCHEMA_CHARS = 900


@query("tier_store_merge", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN vec_id % 30 ELSE 0 END AS accesses, CASE WHEN vec_id % 3 = 0 THEN 'kept' ELSE 'new' END AS origin FROM embeddings")
def tier_store_merge(load, spark):
    prior = tier_state(load).where("vec_id % 3 = 0").select("vec_id", F.col("accesses").alias("had"))
    rows = load("embeddings").select("vec_id").join(prior, "vec_id", "left")
    return rows.select("vec_id", F.coalesce("had", F.lit(0)).alias("accesses"), F.when(F.col("had").isNotNull(), "kept").otherwise("new").alias("origin"))


@query("schema_text_chunks")
def schema_text_chunks(load, spark):
    """Field lines packed greedily under a limit of characters, entity by entity; the fold restarts a chunk when one is full."""
    rows = catalog.listing(spark, {t: load(t) for t in ("customer", "orders", "part", "documents")})
    line = F.concat(F.lit("- "), humanized(F.col("field")), F.lit(" ("), F.col("type"), F.lit(")"))
    lines = rows.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]).alias("lines"))

    def fold(chunks, new):
        last = F.element_at(chunks, -1)
        joined = F.concat(F.slice(chunks, 1, F.size(chunks) - 1), F.array(F.concat_ws("\n", last, new)))
        return F.when(F.length(last) + F.length(new) + 1 > SCHEMA_CHARS, F.concat(chunks, F.array(new))).otherwise(joined)

    header = F.array(F.concat(F.lit("Entity: "), humanized(F.col("entity"))))
    return lines.select("entity", F.posexplode(F.aggregate("lines", header, fold)).alias("chunk_no", "content"))
