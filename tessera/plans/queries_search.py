"""Queries of vector search: single tiers, all tiers together, the library; order statistics and what is quantised by them.

The queries are the vectors whose id divides by 100 (or leaves 1 or 2), against all vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators import archive, library, search, selection, tiers
from tessera.operators.staging import staged
from tessera.plans.queries_catalog import _ROUTED, _STATE, tier_state
from tessera.plans.registry import query

_UNIT = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


def _corpus(load, *more):
    return load("embeddings").select("vec_id", *more, F.col("embedding").alias("vector"))


def _asked(load, rest=0, *more):
    return _corpus(load, *more).where(F.col("vec_id") % 100 == rest).withColumnRenamed("vec_id", "query_id")


def _nearest(load, k, rest=0):
    return search.best(_asked(load, rest), _corpus(load), k)


def _labelled(load, k, rest):
    """Hits with their own label and the query's."""
    hits = search.best(_asked(load, rest), _corpus(load, "label"), k, carry=("label",))
    return hits.join(_asked(load, rest, "label").select("query_id", F.col("label").alias("q_label")), "query_id")


def _rank_sql(where, k, e="embeddings", unit=_UNIT):
    return f"(SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, q.label AS q_label, e.label, round({unit}, 6) AS score FROM embeddings q JOIN {e} e ON q.vec_id <> e.vec_id WHERE {where}) QUALIFY rank <= {k})"


@query("vector_topk", f"SELECT query_id, rank, vec_id, score FROM {_rank_sql('q.vec_id % 100 = 0', 10)}")
def vector_topk(load, spark):
    return _nearest(load, 10).select("query_id", "rank", "vec_id", "score")


@query("knn_bruteforce", f"SELECT query_id, vec_id, score FROM {_rank_sql('q.vec_id % 100 = 0', 3)}")
def knn_bruteforce(load, spark):
    return _nearest(load, 3).select("query_id", "vec_id", "score")


@query("recall_at_k", f"SELECT round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 6) AS r5, round(avg(1 / first), 6) AS mrr FROM (SELECT query_id, coalesce(min(rank) FILTER (label = q_label), 1000000) AS first FROM {_rank_sql('q.vec_id % 100 = 1', 10)} GROUP BY 1)")
def recall_at_k(load, spark):
    first = _labelled(load, 10, 1).groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("label") == F.col("q_label"), F.col("rank"))), F.lit(1000000)).alias("first"))
    return first.agg(F.round(F.avg((F.col("first") <= 1).cast("int")), 6).alias("r1"), F.round(F.avg((F.col("first") <= 5).cast("int")), 6).alias("r5"), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"))


@query("retrieval_eval", f"SELECT query_id, min(rank) FILTER (label = q_label) AS rank_of_expected, coalesce(min(rank) FILTER (label = q_label) <= 3, false) AS in_top3 FROM {_rank_sql('q.vec_id % 100 = 2', 10)} GROUP BY 1")
def retrieval_eval(load, spark):
    hit = F.min(F.when(F.col("label") == F.col("q_label"), F.col("rank")))
    return _labelled(load, 10, 2).groupBy("query_id").agg(hit.alias("rank_of_expected")).withColumn("in_top3", F.coalesce(F.col("rank_of_expected") <= 3, F.lit(False)))


@query("similarity_separation", f"SELECT label = q_label AS related, round(avg(score), 4) AS mean, min(score) AS low, max(score) AS high FROM {_rank_sql('q.vec_id % 100 = 0', 100000000)} GROUP BY 1")
def similarity_separation(load, spark):
    return search.separation(_asked(load, 0, "label"), _corpus(load, "label"), "label")


@query("hits_join_state", f"SELECT query_id, vec_id, current_tier FROM {_rank_sql('q.vec_id % 100 = 0', 10)} JOIN {_STATE} USING (vec_id) WHERE current_tier IS NOT NULL")
def hits_join_state(load, spark):
    state = tier_state(load).where("current_tier is not null").select("vec_id", "current_tier")
    return _nearest(load, 10).join(state, "vec_id").select("query_id", "vec_id", "current_tier")


@query("hits_resolve_text", f"SELECT query_id, h.vec_id, d.text IS NOT NULL AS text_available FROM {_rank_sql('q.vec_id % 100 = 0', 10)} h LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) d ON d.doc_id = h.vec_id")
def hits_resolve_text(load, spark):
    texts = load("documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("there"))
    return _nearest(load, 10).join(texts, "vec_id", "left").select("query_id", "vec_id", F.coalesce("there", F.lit(False)).alias("text_available"))


@query("retrieve_min_score", f"SELECT query_id, vec_id FROM {_rank_sql('q.vec_id % 100 = 0', 10)} WHERE score >= 0.3")
def retrieve_min_score(load, spark):
    return _nearest(load, 10).where("score >= 0.3").select("query_id", "vec_id")


@query("retrieve_text_budget", f"SELECT query_id, rank, greatest(0, least(n_chars, 5000 - before)) AS taken, n_chars > 5000 - before AS truncated FROM (SELECT query_id, rank, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM {_rank_sql('q.vec_id % 100 = 0', 10)} JOIN documents ON doc_id = vec_id)")
def retrieve_text_budget(load, spark):
    hits = _nearest(load, 10).join(load("documents").select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id")
    left = F.lit(5000) - F.coalesce(F.sum("n_chars").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return hits.select("query_id", "rank", F.greatest(F.lit(0), F.least("n_chars", left)).alias("taken"), (F.col("n_chars") > left).alias("truncated"))


# -- order statistics, and vectors quantised by them ---------------------------------------------------------------
@query("latency_stats", """WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT event_type, len(v) AS n, round(median, 6) AS median, round(list_avg(v), 6) AS mean, CASE WHEN len(v) >= 20 THEN round(v[1 + CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER)], 6) ELSE 0 END AS p95, round(v[1], 6) AS low FROM (SELECT *, list_median(v) AS median FROM l)""")
def latency_stats(load, spark):
    last = F.col("n") - 1
    ranks = {"m1": F.floor(last / 2), "m2": F.ceil(last / 2), "tail": F.bround(F.lit(0.95) * last), "first": F.lit(0)}
    found = selection.order_statistics(load("events"), ["event_type"], "value", ranks)
    means = load("events").groupBy(F.col("event_type").alias("kind")).agg(F.round(F.avg("value"), 6).alias("mean"))
    middle, tail = F.round((F.col("m1") + F.col("m2")) / 2, 6).alias("median"), F.when(F.col("n") >= 20, F.round("tail", 6)).otherwise(0.0).alias("p95")
    return found.join(means, F.col("event_type").eqNullSafe(F.col("kind"))).select("event_type", "n", middle, "mean", tail, F.round("first", 6).alias("low"))


_SCALE = "(SELECT quantile_cont(abs(x), 0.99) AS scale FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings))"
_CODES = "list_transform(embedding::DOUBLE[], lambda x: CAST(round(greatest(-1.0, least(1.0, x / scale)) * 127) AS BIGINT))"
_WARM = f"(SELECT vec_id, label, scale, {_CODES} AS codes FROM embeddings, {_SCALE})"


def _scale(load):
    """One row: the quantile of all components' sizes beyond which a component is clipped."""
    components = load("embeddings").select(F.explode(F.col("embedding").cast("array<double>")).alias("x")).select(F.abs("x").alias("x"))
    return staged(selection.quantiles(components, [], "x", {"scale": 0.99}).select("scale"), "scale")


@query("warm_int8_quantize", f"SELECT vec_id, CAST(list_sum(codes) AS BIGINT) AS checksum, round(scale, 6) AS scale FROM {_WARM}")
def warm_int8_quantize(load, spark):
    rows = search.quantised(load("embeddings").select("vec_id", "embedding"), "embedding", _scale(load))
    return rows.select("vec_id", F.aggregate("codes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"), F.round("scale", 6).alias("scale"))


_UNIT_WARM = "list_cosine_similarity(q.embedding::DOUBLE[], e.codes::DOUBLE[])"


@query("hot_warm_overlap", f"""WITH h AS MATERIALIZED {_rank_sql('q.vec_id % 100 = 0', 5)}, w AS MATERIALIZED {_rank_sql('q.vec_id % 100 = 0', 5, _WARM, _UNIT_WARM)},
b AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, vec_id FROM h INTERSECT SELECT query_id, vec_id FROM w) GROUP BY 1)
SELECT DISTINCT h.query_id, coalesce(n, 0) / 5 AS overlap FROM h LEFT JOIN b ON b.query_id = h.query_id""")
def hot_warm_overlap(load, spark):
    warm = search.quantised(_corpus(load), "vector", _scale(load)).select("vec_id", F.col("codes").alias("vector"))
    found = search.best(_asked(load), warm, 5).select("query_id", "vec_id", F.lit(1).alias("both"))
    return _nearest(load, 5).join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("both") / 5).alias("overlap"))


# -- all tiers: each vector lies in its tier, and, where a move was broken off, in the one it was moving to too --------
# vectors without a tier are orphans in the hot one; every thirteenth is superseded but still there
_PLACED = f"(SELECT vec_id, coalesce(current_tier, 'hot') AS tier FROM {_STATE} UNION SELECT vec_id, selected FROM {_ROUTED} WHERE current_tier <> selected)"
_TIER_HITS = " UNION ALL ".join(
    f"SELECT query_id, vec_id, score, '{t}' AS tier, {i} AS turn FROM {_rank_sql(f'q.vec_id % 100 = 0 AND e.label % 2 = 0', 20, f'(SELECT x.* FROM {x} x JOIN {_PLACED} p ON p.vec_id = x.vec_id AND p.tier = {chr(39)}{t}{chr(39)})', u)}"
    for i, (t, x, u) in enumerate((("hot", "embeddings", _UNIT), ("warm", _WARM, _UNIT_WARM), ("cold", "embeddings", _UNIT)))
)


def placed(load):
    # written, for a filter on a tier would otherwise copy the whole policy's expression into itself
    routed = staged(tiers.routed(tier_state(load)).select("vec_id", "current_tier", F.col("selected").alias("tier")), "routed").where("current_tier <> tier").drop("current_tier")
    return tier_state(load).select("vec_id", F.coalesce("current_tier", F.lit("hot")).alias("tier")).unionByName(routed).distinct()


def _stored(load, spark):
    """Each tier's vectors in its own form: floats, codes, and archives that are opened to be searched."""
    rows, secret = staged(_corpus(load, "label").where("label % 2 = 0").join(placed(load), "vec_id"), "placed"), archive.passing_key(spark)
    cold = rows.where("tier = 'cold'").withColumn("archive", archive.sealed(F.col("vec_id"), F.col("vector"), secret)).select("vec_id", "archive")
    return {
        "hot": rows.where("tier = 'hot'").select("vec_id", "vector"),
        "warm": search.quantised(rows.where("tier = 'warm'").select("vec_id", "vector"), "vector", _scale(load)).select("vec_id", F.col("codes").alias("vector")),
        "cold": archive.opened(cold, "archive", "vec_id", secret).where("refused is null").select("vec_id", "vector"),
    }


@query("hybrid_search", f"""WITH hits AS (SELECT h.*, s.current_tier FROM ({_TIER_HITS}) h JOIN {_STATE} s USING (vec_id) WHERE s.current_tier IS NOT NULL AND vec_id % 13 <> 0),
once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY tier = current_tier DESC, turn) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score, tier FROM once QUALIFY rank <= 5""")
def hybrid_search(load, spark):
    state = tier_state(load).where("current_tier is not null").select("vec_id", "current_tier", (F.col("vec_id") % 13 != 0).alias("is_current"))
    return search.across_tiers(_asked(load), _stored(load, spark), state, 5)


@query("cold_search", f"SELECT query_id, rank, vec_id, score FROM {_rank_sql('q.vec_id % 100 = 0', 5, f'(SELECT * FROM embeddings JOIN {_STATE} s USING (vec_id) WHERE s.current_tier = {chr(39)}cold{chr(39)})')}")
def cold_search(load, spark):
    rows, secret = _corpus(load).join(tier_state(load).where("current_tier = 'cold'").select("vec_id"), "vec_id"), archive.passing_key(spark)
    kept = rows.select("vec_id", archive.sealed(F.col("vec_id"), F.col("vector"), secret).alias("archive"))
    found = archive.opened(kept, "archive", "vec_id", secret).where("refused is null").select("vec_id", "vector")
    return search.best(_asked(load), found, 5).select("query_id", "rank", "vec_id", "score")


# planted: one archive in seven under another owner's header, one in eleven with a body of another length
@query("cold_roundtrip", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'OWNER' WHEN vec_id % 11 = 0 THEN 'SEAL' END AS refused, CASE WHEN vec_id % 7 <> 0 AND vec_id % 11 <> 0 THEN true END AS lossless FROM embeddings")
def cold_roundtrip(load, spark):
    v, e, secret = F.col("vec_id"), load("embeddings"), archive.passing_key(spark)
    made = archive.sealed(F.when(v % 7 == 0, v + 1).otherwise(v), F.col("embedding"), secret)
    cut = F.expr("substring(archive.body, 1, octet_length(archive.body) - 1)")
    rows = e.withColumn("archive", made).withColumn("archive", F.struct(F.col("archive.header").alias("header"), F.when(v % 11 == 0, cut).otherwise(F.col("archive.body")).alias("body")))
    found = archive.opened(rows, "archive", "vec_id", secret)
    return found.select("vec_id", "refused", (F.col("vector") == F.col("embedding").cast("array<double>")).alias("lossless"))


@query("migration_execute", f"""WITH m AS (SELECT r.vec_id, selected, e.embedding, scale FROM {_ROUTED} r JOIN embeddings e USING (vec_id), {_SCALE} WHERE current_tier IS DISTINCT FROM selected),
d AS (SELECT vec_id, selected, CASE WHEN selected = 'warm' THEN list_max(list_transform(list_zip({_CODES}, embedding::DOUBLE[]), lambda x: abs(x[1] * scale / 127 - x[2]))) ELSE 0 END AS off, scale FROM m)
SELECT vec_id, selected, round(off, 6) AS deviation, CASE WHEN off <= CASE WHEN selected = 'warm' THEN scale / 250 ELSE 0.000001 END THEN 'retired_source' ELSE 'kept_source' END AS outcome FROM d""")
def migration_execute(load, spark):
    """Rows that move, written in the new tier's form, read back and compared: the largest deviation decides what is retired.
    A component that was clipped is off by more than a step of the codes, so its source stays."""
    routed = staged(tiers.routed(tier_state(load)).select("vec_id", "current_tier", "selected"), "routed")
    moves = routed.where(~F.col("current_tier").eqNullSafe(F.col("selected"))).select("vec_id", "selected")
    source = search.quantised(_corpus(load).join(moves, "vec_id"), "vector", _scale(load)).withColumn("vector", F.col("vector").cast("array<double>"))
    secret = archive.passing_key(spark)
    sealed = source.withColumn("archive", archive.sealed(F.col("vec_id"), F.col("vector"), secret)).withColumnRenamed("vector", "source")
    opened = archive.opened(sealed, "archive", "vec_id", secret)
    stored = F.when(F.col("selected") == "warm", search.restored()).when(F.col("selected") == "cold", F.col("vector")).otherwise(F.col("source"))
    off = F.array_max(F.zip_with(stored, "source", lambda a, b: F.abs(a - b)))
    rows = opened.select("vec_id", "selected", off.alias("off"), "scale")
    fits = F.col("off") <= F.when(F.col("selected") == "warm", F.col("scale") / 250).otherwise(1e-6)
    return rows.select("vec_id", "selected", F.round("off", 6).alias("deviation"), F.when(fits, "retired_source").otherwise("kept_source").alias("outcome"))


# -- the library: two points a document; every fifth point of an outdated revision; readers by source, owners by id ----
_ROLES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_ROLE_LIST = "['" + "', '".join(_ROLES) + "']"
_LIBRARY = "(SELECT doc_id AS document_id, 'c_' || substr(sha256('w1|' || lang || '|' || CASE WHEN doc_id % 10 = 3 THEN 'restricted' ELSE 'open' END), 1, 12) AS collection, CASE WHEN doc_id % 17 <> 0 THEN 'u' || doc_id || '.2' END AS current_upload_id, 2 AS indexed_revision, 1 + doc_id % 100 AS owner_id, source FROM documents)"


def _library(load):
    k = F.col("doc_id")
    where = library.collection("w1", F.col("lang"), k % 10 == 3)
    upload = F.when(k % 17 != 0, F.concat(F.lit("u"), k.cast("string"), F.lit(".2")))  # the rest have been taken back
    return load("documents").select(k.alias("document_id"), where.alias("collection"), upload.alias("current_upload_id"), F.lit(2).alias("indexed_revision"), (1 + k % 100).alias("owner_id"), "source")


def _readers(documents):
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    roles = F.array(*map(F.lit, _ROLES))
    return documents.select("document_id", F.explode(F.array(F.get(roles, n % 5), F.get(roles, (n + 2) % 5))).alias("role"))


def _points(load):
    v = F.col("vec_id")
    revision = F.when(v % 5 == 0, 1).otherwise(2)
    lies = _library(load).select("document_id", "collection")
    points = load("embeddings").select("vec_id", F.col("embedding").alias("vector"), F.floor(v / 2).alias("document_id"), revision.alias("index_revision"), F.concat(F.lit("u"), F.floor(v / 2).cast("string"), F.lit("."), revision.cast("string")).alias("upload_id"))
    return points.join(lies, "document_id")


@query("library_search", f"""WITH d AS {_LIBRARY}, r AS (SELECT document_id, unnest([{_ROLE_LIST}[1 + n % 5], {_ROLE_LIST}[1 + (n + 2) % 5]]) AS role FROM (SELECT document_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS n FROM d)),
p AS (SELECT vec_id, embedding, d.* FROM embeddings e JOIN d ON d.document_id = e.vec_id // 2 WHERE e.vec_id % 5 <> 0 AND current_upload_id IS NOT NULL),
q AS (SELECT e.vec_id AS query_id, e.embedding, c_custkey AS actor_id, c_mktsegment AS role FROM embeddings e JOIN customer ON c_custkey = 1 + e.vec_id // 100 % 100 WHERE e.vec_id % 100 = 0),
met AS (SELECT query_id, p.vec_id, document_id, collection, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM q JOIN p ON q.query_id <> p.vec_id AND (p.owner_id = q.actor_id OR EXISTS (SELECT 1 FROM r WHERE r.document_id = p.document_id AND r.role = q.role))),
near AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, vec_id) <= 25),
once AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, vec_id) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, document_id, vec_id, score FROM once QUALIFY rank <= 5""")
def library_search(load, spark):
    documents = _library(load)
    actors = load("customer").select(F.col("c_custkey").alias("actor_id"), F.col("c_mktsegment").alias("role"))
    asked = _asked(load).withColumn("actor_id", 1 + F.floor(F.col("query_id") / 100) % 100)
    return library.scoped(asked, actors, documents, _readers(documents), _points(load), 5)
