"""Queries of catalogs, mappings, tiers and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog, tiers
from tessera.plans.registry import query

@query("schema_version_sequence", "SELECT event_id, user_id, CAST(sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS version FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)")
def schema_version_sequence(load, spark):
    return catalog.versions(load("events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "version")


@query("latest_snapshot", "SELECT user_id, max(event_id) AS latest, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def latest_snapshot(load, spark):
    return load("events").groupBy("user_id").agg(F.max("event_id").alias("latest"), F.max_by("event_type", "event_id").alias("state"))


_TABLES = ("customer", "orders", "part", "supplier", "documents")


_LISTING = " UNION ALL ".join(
    f"SELECT '{t}' AS entity, column_name AS field, CASE WHEN column_type LIKE '%[]' THEN 'array' ELSE coalesce(MAP {{'BIGINT': 'integer', 'INTEGER': 'integer', 'DOUBLE': 'decimal', 'VARCHAR': 'string', 'TIMESTAMP': 'datetime', 'BOOLEAN': 'boolean'}}[column_type], 'unknown') END AS type, CAST(row_number() OVER () - 1 AS INTEGER) AS position FROM (DESCRIBE SELECT * FROM {t})"
    for t in _TABLES
)


@query("schema_catalog_listing", _LISTING)
def schema_catalog_listing(load, spark):
    return catalog.listing(spark, {t: load(t) for t in _TABLES})


@query("schema_summary", f"SELECT count(DISTINCT entity) AS entities, count(*) AS fields FROM ({_LISTING})")
def schema_summary(load, spark):
    return catalog.listing(spark, {t: load(t) for t in _TABLES}).agg(F.countDistinct("entity").alias("entities"), F.count("*").alias("fields"))


@query("search_field_catalog", f"SELECT entity, array_to_string(list(field ORDER BY field), ',') AS fields FROM ({_LISTING}) WHERE entity IN ('customer', 'orders') AND type <> 'array' GROUP BY 1")
def search_field_catalog(load, spark):
    rows = catalog.listing(spark, {t: load(t) for t in ("customer", "orders")}).where(~F.col("type").isin("array", "binary"))
    return rows.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_list("field")), ",").alias("fields"))


@query("fk_edges", "SELECT 'orders' AS child, 'customer' AS parent, count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS dangling FROM orders LEFT JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'lineitem', 'orders', count(*), count(*) FILTER (o_orderkey IS NULL) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def fk_edges(load, spark):
    def edge(child, parent, fk, key):
        known = load(parent).select(F.col(key).alias("_k_"))
        joined = load(child).select(fk).join(known, F.col(fk) == F.col("_k_"), "left")
        return joined.agg(F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.count("*").alias("n"), F.count_if(F.col("_k_").isNull()).alias("dangling"))

    return edge("orders", "customer", "o_custkey", "c_custkey").unionByName(edge("lineitem", "orders", "l_orderkey", "o_orderkey"))


@query("catalog_orphans", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def catalog_orphans(load, spark):
    return load("customer").select("c_custkey").join(load("orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


# -- tiers -----------------------------------------------------------------------------------------------------
_STATE = """(SELECT vec_id, vec_id % 250 AS age_days, CASE WHEN vec_id % 10 <> 0 THEN vec_id % 130 END AS idle_days, vec_id % 30 AS accesses, ['low', 'medium', 'high'][1 + vec_id % 3] AS criticality, ['low', 'medium', 'high'][1 + vec_id % 7 % 3] AS latency,
 ['public', 'restricted'][1 + CASE WHEN vec_id % 11 = 0 THEN 1 ELSE 0 END] AS sensitivity, vec_id % 17 = 0 AS legal_hold, CASE WHEN vec_id % 19 = 0 THEN 10 ELSE 0 END AS retention_days, CASE WHEN vec_id % 8 = 0 THEN NULL ELSE ['hot', 'warm', 'cold'][1 + vec_id % 3] END AS current_tier, vec_id % 20 AS resident_days FROM embeddings)"""
_FACTORS = f"""(SELECT *, round(least(age_days / 180, 1.0), 6) AS age, round(greatest(least(1 - coalesce(idle_days, age_days) / 120, 1.0), 0.0), 6) AS recency, round(least(accesses / 20, 1.0), 6) AS access, round(least(coalesce(idle_days, age_days) / 120, 1.0), 6) AS dormancy,
 CASE criticality WHEN 'low' THEN 0.0::DOUBLE WHEN 'medium' THEN 0.5 ELSE 1.0 END AS critical, CASE latency WHEN 'low' THEN 0.0::DOUBLE WHEN 'medium' THEN 0.5 ELSE 1.0 END AS fast FROM {_STATE})"""
_ROUTED = f"""(WITH p AS (SELECT *, CASE WHEN sensitivity = 'restricted' THEN 'SENSITIVITY' END AS no_hot, CASE WHEN latency = 'high' THEN 'LOW_LATENCY' WHEN criticality = 'high' THEN 'CRITICAL' WHEN legal_hold THEN 'LEGAL_HOLD' WHEN retention_days > 0 THEN 'RETENTION' END AS no_cold FROM {_FACTORS}),
 s AS (SELECT *, CASE WHEN no_hot IS NOT NULL THEN 0.0 ELSE round(0.2::DOUBLE * recency + 0.3::DOUBLE * access + 0.25::DOUBLE * critical + 0.25::DOUBLE * fast, 6) END AS hot_score, round(0.05::DOUBLE * recency + 0.1::DOUBLE * access + 0.05::DOUBLE * critical + 0.05::DOUBLE * fast + 0.4::DOUBLE * age + 0.35::DOUBLE * dormancy, 6) AS warm_score, CASE WHEN no_cold IS NOT NULL THEN 0.0 ELSE round(0.35::DOUBLE * age + 0.65::DOUBLE * dormancy, 6) END AS cold_score FROM p),
 b AS (SELECT *, CASE WHEN no_hot IS NULL AND hot_score >= warm_score AND (no_cold IS NOT NULL OR hot_score >= cold_score) THEN 'hot' WHEN no_cold IS NOT NULL OR warm_score >= cold_score THEN 'warm' ELSE 'cold' END AS best FROM s),
 g AS (SELECT *, round(CASE best WHEN 'hot' THEN hot_score WHEN 'warm' THEN warm_score ELSE cold_score END - CASE current_tier WHEN 'hot' THEN hot_score WHEN 'warm' THEN warm_score ELSE cold_score END, 6) AS gain, list_position(['hot', 'warm', 'cold'], best) < list_position(['hot', 'warm', 'cold'], current_tier) AS up FROM b),
 r AS (SELECT *, CASE WHEN current_tier IS NULL THEN 'INITIAL' WHEN (current_tier = 'hot' AND no_hot IS NOT NULL) OR (current_tier = 'cold' AND no_cold IS NOT NULL) THEN 'FORCED' WHEN best = current_tier THEN 'STAY' WHEN resident_days < 7 THEN 'RESIDENCE' WHEN gain < CASE WHEN up THEN 0.1 ELSE 0.15 END THEN 'MARGIN' ELSE 'MOVE' END AS reason FROM g)
 SELECT *, CASE WHEN reason IN ('INITIAL', 'FORCED', 'MOVE') THEN best ELSE current_tier END AS selected FROM r)"""


def tier_state(load):
    v = F.col("vec_id")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    return load("embeddings").select(
        "vec_id", (v % 250).alias("age_days"), F.when(v % 10 != 0, v % 130).alias("idle_days"), (v % 30).alias("accesses"), pick(("low", "medium", "high"), v % 3).alias("criticality"), pick(("low", "medium", "high"), v % 7 % 3).alias("latency"),
        F.when(v % 11 == 0, "restricted").otherwise("public").alias("sensitivity"), (v % 17 == 0).alias("legal_hold"), F.when(v % 19 == 0, 10).otherwise(0).alias("retention_days"), F.when(v % 8 != 0, pick(("hot", "warm", "cold"), v % 3)).alias("current_tier"), (v % 20).alias("resident_days"),
    )


@query("tier_factors", f"SELECT vec_id, age, recency, access, dormancy, critical, fast FROM {_FACTORS}")
def tier_factors(load, spark):
    return tiers.factors(tier_state(load)).select("vec_id", "age", "recency", "access", "dormancy", "critical", "fast")


@query("tier_prohibitions", f"SELECT vec_id, no_hot, no_cold FROM {_ROUTED}")
def tier_prohibitions(load, spark):
    return tiers.prohibited(tier_state(load)).select("vec_id", "no_hot", "no_cold")


@query("tier_route", f"SELECT vec_id, hot_score, warm_score, cold_score, best, reason, selected FROM {_ROUTED}")
def tier_route(load, spark):
    return tiers.routed(tier_state(load)).select("vec_id", "hot_score", "warm_score", "cold_score", "best", "reason", "selected")


@query("migration_plan", f"SELECT vec_id, current_tier, selected FROM {_ROUTED} WHERE current_tier IS DISTINCT FROM selected ORDER BY vec_id LIMIT 100")
def migration_plan(load, spark):
    moves = tiers.routed(tier_state(load)).where(~F.col("current_tier").eqNullSafe(F.col("selected")))
    return moves.orderBy("vec_id").limit(100).select("vec_id", "current_tier", "selected")


@query("tier_distribution", f"SELECT t AS tier, count(vec_id) AS n FROM (SELECT unnest(['hot', 'warm', 'cold']) AS t) LEFT JOIN {_STATE} ON t = current_tier GROUP BY 1")
def tier_distribution(load, spark):
    return tiers.cost(tier_state(load), 64).select("tier", "n")


@query("tier_cost", f"WITH c AS (SELECT t AS tier, w, m, count(vec_id) AS n FROM (SELECT unnest(['hot', 'warm', 'cold']) AS t, unnest([4, 1, 4]) AS w, unnest([1.0, 0.4, 0.05]) AS m) LEFT JOIN {_STATE} ON t = current_tier GROUP BY ALL) SELECT tier, n, n * 64 * w AS bytes, round(n * 64 * w * m, 6) AS cost, CASE WHEN n > 0 THEN round(w * m / 4, 6) ELSE 0 END AS relative FROM c")
def tier_cost(load, spark):
    return tiers.cost(tier_state(load), 64)


@query("retention_guard", f"SELECT vec_id, CASE WHEN legal_hold THEN 'LEGAL_HOLD' WHEN retention_days > 0 THEN 'RETENTION' END AS refused FROM {_STATE} WHERE vec_id % 5 = 0")
def retention_guard(load, spark):
    asked = tier_state(load).where("vec_id % 5 = 0")
    return asked.select("vec_id", F.when(F.col("legal_hold"), "LEGAL_HOLD").when(F.col("retention_days") > 0, "RETENTION").alias("refused"))


@query("access_stats", "SELECT user_id, count(*) AS accesses, max(ts) AS last_at FROM events GROUP BY 1")
def access_stats(load, spark):
    return load("events").groupBy("user_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_at"))


# -- retrieval without vectors ---------------------------------------------------------------------------------
@query("filtered_search_predicate", "SELECT vec_id FROM embeddings WHERE label = 3 AND vec_id % 2 = 0")
def filtered_search_predicate(load, spark):
    tags = F.array(F.col("vec_id") % 2, F.col("label").cast("bigint"))
    return load("embeddings").where((F.col("label") == 3) & F.array_contains(tags, F.lit(0).cast("bigint"))).select("vec_id")


@query("exact_fetch", "SELECT vec_id, 1.0 AS score FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 20")
def exact_fetch(load, spark):
    return load("embeddings").where("label = 2").orderBy("vec_id").limit(20).select("vec_id", F.lit(1.0).alias("score"))


@query("collection_route", "SELECT label, 'c_' || substr(sha256('w1|schema|' || label), 1, 12) AS collection FROM embeddings GROUP BY label")
def collection_route(load, spark):
    return load("embeddings").select("label").distinct().select("label", F.concat(F.lit("c_"), F.substring(F.sha2(F.concat_ws("|", F.lit("w1"), F.lit("schema"), F.col("label").cast("string")), 256), 1, 12)).alias("collection"))


_INDEXED = ("idle_days", "criticality", "latency", "sensitivity", "legal_hold", "retention_days")


@query("indexed_field_intersection", "WITH f AS (SELECT current_tier AS tier, unnest(['" + "', '".join(_INDEXED) + "']) AS field, unnest([" + ", ".join(f"CAST({c} AS VARCHAR)" for c in _INDEXED) + f"]) AS v FROM {_STATE} WHERE current_tier IS NOT NULL), k AS (SELECT tier, field FROM f GROUP BY 1, 2 HAVING count(DISTINCT v) > 1) SELECT field FROM k GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT current_tier) FROM {_STATE})")
def indexed_field_intersection(load, spark):
    """Fields worth an index (two values or more) in every tier."""
    state = tier_state(load).where("current_tier is not null")
    entries = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in _INDEXED))
    worth = state.select("current_tier", F.explode(entries).alias("e")).groupBy("current_tier", "e.field").agg(F.min("e.v").alias("a"), F.max("e.v").alias("b")).where("a <> b")
    n = state.agg(F.countDistinct("current_tier").alias("n"))  # one row
    return worth.groupBy("field").agg(F.count("*").alias("held")).crossJoin(F.broadcast(n)).where("held = n").select("field")


@query("paged_listing", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_listing(load, spark):
    return load("orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_orderdate")
