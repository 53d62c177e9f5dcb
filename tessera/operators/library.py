"""Search of a document library with rights and revisions.

Rights are an index, not a predicate: a point is filed under each audience that
may read its document (``role:...`` for its readers, ``actor:...`` for its owner)
and collection, and a query looks where its actor's audiences have something.
Only points of a document's current upload and revision are filed, so neither
outdated nor forbidden ones take places from others before the cut. A point is
copied once for each audience of its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators import search

#: Points asked of a collection for each document wanted, and at most.
OVERSAMPLE, MOST = 5, 100


def collection(workspace: str, part: Column, restricted: Column) -> Column:
    """The collection that a schema's documents lie in; restricted ones lie apart."""
    name = F.concat_ws("|", F.lit(workspace), part, F.when(restricted, "restricted").otherwise("open"))
    return F.concat(F.lit("c_"), F.substring(F.sha2(name, 256), 1, 12))


def audiences(documents: DataFrame, readers: DataFrame) -> DataFrame:
    """(document_id, audience) of the documents' owners and of the roles that may read them."""
    roles = readers.select("document_id", F.concat(F.lit("role:"), "role").alias("audience"))
    return roles.unionByName(documents.select("document_id", F.concat(F.lit("actor:"), F.col("owner_id").cast("string")).alias("audience"))).where("audience is not null").distinct()


def current(points: DataFrame, documents: DataFrame) -> DataFrame:
    """Points of the upload, revision and collection that their document names now."""
    now = documents.where("current_upload_id is not null").select("document_id", F.col("current_upload_id").alias("upload_id"), F.col("indexed_revision").alias("index_revision"), "collection")
    return points.join(now, ["document_id", "upload_id", "index_revision", "collection"], "left_semi")


def scoped(queries: DataFrame, actors: DataFrame, documents: DataFrame, readers: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, document_id, vec_id, score): the ``k`` best documents that each query's actor may read, by their best point."""
    may = audiences(documents, readers)
    filed = current(points, documents).join(may, "document_id")
    routes = documents.where("current_upload_id is not null").join(may, "document_id").select("audience", "collection").distinct()
    known = queries.join(actors, "actor_id").select("query_id", "vector", F.explode(F.array(F.concat(F.lit("role:"), "role"), F.concat(F.lit("actor:"), F.col("actor_id").cast("string")))).alias("audience"))
    most = min(OVERSAMPLE * k, MOST)
    hits = search.best(known.join(routes, "audience"), filed, most, ("audience", "collection"), ("document_id",))
    once = hits.groupBy("query_id", "collection", "vec_id", "document_id").agg(F.max("score").alias("score"))
    kept = search.ranked(once, most, ("query_id", "collection"))
    first = W.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "vec_id")
    documents_found = kept.withColumn("place", F.row_number().over(first)).where("place = 1").drop("rank")
    return search.ranked(documents_found, k).select("query_id", "rank", "document_id", "vec_id", "score")
