"""Queries of field catalogs and mappings, over what the rows of the given tables show.

The source fields are those of four extracts, their types inferred from all values; the canonical model and its
aliases are tables of their own. Schema versions are what two parts of a document collection show.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import catalog, mapping, nested
from tessera.plans.queries_nested import _NODES, _SEEN, orders_as_documents
from tessera.plans.registry import query

#: Extracts: table, and the name that each column has there.
_EXTRACTS = {
    "orders": {"o_orderkey": "order_no", "o_custkey": "cust_no", "o_orderstatus": "order_status", "o_totalprice": "tot_price", "o_orderdate": "order_dt", "o_orderpriority": "priority"},
    "customer": {"c_custkey": "cust_no", "c_name": "cust_name", "c_nationkey": "nation_key", "c_acctbal": "acct_balance", "c_mktsegment": "mkt_segment"},
    "part": {"p_partkey": "part_no", "p_name": "part_desc", "p_retailprice": "retail_price"},
    "supplier": {"s_suppkey": "supp_no", "s_name": "supp_name", "s_acctbal": "acct_balance"},
}
_MODEL = (
    ("order", "order_number", "integer"), ("order", "customer_number", "integer"), ("order", "status", "string"), ("order", "total_price", "decimal"), ("order", "order_date", "datetime"), ("order", "urgency", "string"),
    ("customer", "customer_number", "integer"), ("customer", "name", "string"), ("customer", "account_balance", "decimal"), ("customer", "customer_name", "string"), ("customer", "nation", "string"),
    ("part", "part_number", "binary"), ("part", "price", "decimal"), ("supplier", "supplier_number", "integer"), ("supplier", "name", "string"), ("supplier", "account_balance", "decimal"), ("supplier", "phone", "string"),
)
_ALIASES = (("mkt_segment", "customer", "name"), ("priority", "order", "urgency"), ("acct_balance", "customer", "account_balance"), ("acct_balance", "supplier", "account_balance"))


def source_fields(load):
    """(entity, field, type): a field's type is the one that is true of all its values; each table is read once."""
    out = None
    for table, names in _EXTRACTS.items():
        entries = F.array(*(F.struct(F.lit(name).alias("field"), text.csv_kind(F.col(c).cast("string")).alias("kind")) for c, name in names.items()))
        own = load(table).select(F.explode(entries).alias("e")).groupBy("e.field").agg(F.sort_array(F.collect_set("e.kind")).alias("kinds")).select(F.lit(table).alias("entity"), "field", "kinds")
        out = own if out is None else out.unionByName(own)
    kinds = F.col("kinds")
    kind = F.when(F.size(kinds) == 1, F.get(kinds, 0)).when(kinds == F.array(F.lit("decimal"), F.lit("integer")), "decimal").otherwise("string")
    return out.select("entity", "field", kind.alias("type"))


def _model(spark):
    return spark.createDataFrame(list(_MODEL), "target_entity string, target string, target_type string")


def _scores(load, spark):
    return mapping.scored(source_fields(load), _model(spark), spark.createDataFrame(list(_ALIASES), "alias string, target_entity string, target string"))


def _decided(load, spark):
    return mapping.decided(mapping.candidates(_scores(load, spark)), source_fields(load))


def _rows(rows, names):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows) + f") t({names})"


def _table(pairs):
    return "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in pairs.items()) + "}"


_OBSERVED = " UNION ALL ".join(f"SELECT '{t}' AS entity, unnest([{', '.join(repr(n) for n in names.values())}]) AS field, unnest([{', '.join(f'CAST({c} AS VARCHAR)' for c in names)}]) AS v FROM {t}" for t, names in _EXTRACTS.items())
_KIND = "CASE WHEN v IS NULL THEN NULL WHEN regexp_full_match(v, '[+-]?(0|[1-9]\\d*)') THEN 'integer' WHEN regexp_full_match(v, '[+-]?\\d+\\.\\d*([eE][+-]?\\d+)?') THEN 'decimal' WHEN regexp_full_match(v, '\\d{4}-\\d\\d-\\d\\d') THEN 'date' WHEN regexp_full_match(v, '\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d(\\.\\d+)?') THEN 'datetime' ELSE 'string' END"
_PAIR = "f.type || '>' || m.target_type"
_FIT_SQL = f"CASE WHEN f.type = m.target_type THEN 'exact' WHEN list_contains({list(mapping.WIDENING)}, {_PAIR}) THEN 'widening' WHEN list_contains({list(mapping.LOSSY)}, {_PAIR}) THEN 'lossy' ELSE 'incompatible' END"
_FIT_SCORE = "CASE fit " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in mapping.FIT.items()) + " END"
_JACCARD = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0 ELSE round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 6) END"
_SCORED = f"""observed AS ({_OBSERVED}),
kinds AS (SELECT entity, field, list_sort(list(DISTINCT {_KIND})) AS k FROM observed WHERE v IS NOT NULL GROUP BY 1, 2),
fields AS (SELECT entity, field, CASE WHEN len(k) = 1 THEN k[1] WHEN k = ['decimal', 'integer'] THEN 'decimal' ELSE 'string' END AS type FROM kinds),
model AS (SELECT * FROM {_rows(_MODEL, 'target_entity, target, target_type')}), aliases AS (SELECT * FROM {_rows(_ALIASES, 'alias, target_entity, target')}),
names AS (SELECT entity AS name FROM fields UNION SELECT field FROM fields UNION SELECT target_entity FROM model UNION SELECT target FROM model),
words AS (SELECT name, list_transform(flatten(list_transform(string_split(name, '_'), lambda w: string_split(coalesce({_table(text.ABBREVIATIONS)}[w], w), '_'))), lambda w: coalesce({_table(text.SYNONYMS)}[w], w)) AS w FROM names),
tokens AS (SELECT name, CASE WHEN len(list_filter(w, lambda x: NOT list_contains({list(text.NOISE_TOKENS)}, x))) > 0 THEN list_filter(w, lambda x: NOT list_contains({list(text.NOISE_TOKENS)}, x)) ELSE w END AS w FROM words),
met AS (SELECT f.*, m.*, {_FIT_SQL} AS fit, CASE WHEN f.field = m.target THEN 1.0::DOUBLE WHEN EXISTS (SELECT 1 FROM aliases a WHERE a.alias = f.field AND a.target_entity = m.target_entity AND a.target = m.target) THEN 0.94
 ELSE {_JACCARD.format(a='fw.w', b='tw.w')} END AS name_score,
 CASE WHEN list_sort(list_distinct(ew.w)) = list_sort(list_distinct(mw.w)) THEN 1.0::DOUBLE WHEN len(list_filter(mw.w, lambda x: NOT list_contains(ew.w, x))) = 0 THEN 0.85 WHEN len(list_filter(ew.w, lambda x: NOT list_contains(mw.w, x))) = 0 THEN 0.75 ELSE greatest({_JACCARD.format(a='ew.w', b='mw.w')}, 0.5) END AS entity_score
 FROM fields f, model m, tokens fw, tokens tw, tokens ew, tokens mw WHERE fw.name = f.field AND tw.name = m.target AND ew.name = f.entity AND mw.name = m.target_entity),
scores AS (SELECT *, round(0.5 * name_score + 0.2 * {_FIT_SCORE} + 0.2 * entity_score + 0.05, 6) AS score FROM met WHERE name_score >= 0.25),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity, field ORDER BY score DESC, target_entity, target) AS INTEGER) AS rank FROM scores WHERE score >= 0.2),
best AS (SELECT *, round(score - lead(score) OVER (PARTITION BY entity, field ORDER BY rank), 6) AS margin FROM ranked WHERE rank <= 5 QUALIFY rank = 1),
decided AS (SELECT f.entity, f.field, b.target_entity, b.target, b.score, CASE WHEN b.score IS NULL THEN 'unmapped' WHEN b.fit = 'incompatible' THEN 'review_type' WHEN b.score < 0.75 THEN 'review_score' WHEN b.margin < 0.05 THEN 'review_ambiguous' ELSE 'auto' END AS decision FROM fields f LEFT JOIN best b ON b.entity = f.entity AND b.field = f.field)"""


@query("mapping_scores", f"WITH {_SCORED} SELECT entity, field, target_entity, target, score FROM ranked")
def mapping_scores(load, spark):
    return _scores(load, spark).select("entity", "field", "target_entity", "target", "score")


@query("mapping_candidates", f"WITH {_SCORED} SELECT entity, field, target_entity, target, rank FROM ranked WHERE rank <= 5")
def mapping_candidates(load, spark):
    return mapping.candidates(_scores(load, spark)).select("entity", "field", "target_entity", "target", "rank")


@query("mapping_decisions", f"WITH {_SCORED} SELECT entity, field, decision FROM decided")
def mapping_decisions(load, spark):
    return _decided(load, spark).select("entity", "field", "decision")


@query("mapping_collisions", f"WITH {_SCORED} SELECT entity, field, CASE WHEN decision = 'auto' AND row_number() OVER (PARTITION BY decision, entity, target_entity, target ORDER BY score DESC, field) > 1 THEN 'review_collision' ELSE decision END AS decision FROM decided")
def mapping_collisions(load, spark):
    return mapping.without_collisions(_decided(load, spark)).select("entity", "field", "decision")


@query("mapping_coverage", f"WITH {_SCORED} SELECT entity, count(*) AS fields, count(*) FILTER (decision = 'auto') AS mapped, round(count(*) FILTER (decision = 'auto') / count(*), 6) AS share FROM decided GROUP BY ROLLUP (entity)")
def mapping_coverage(load, spark):
    rows = _decided(load, spark)
    return rows.rollup("entity").agg(F.count("*").alias("fields"), F.count_if(F.col("decision") == "auto").alias("mapped")).withColumn("share", F.round(F.col("mapped") / F.col("fields"), 6))


@query("mapping_profiles", f"WITH {_SCORED} SELECT entity, field, 'map.' || substr(sha256(entity || '|' || field), 1, 16) AS mapping_id FROM decided WHERE decision = 'auto'")
def mapping_profiles(load, spark):
    auto = _decided(load, spark).where("decision = 'auto'")
    return auto.select("entity", "field", F.concat(F.lit("map."), F.substring(F.sha2(F.concat_ws("|", "entity", "field"), 256), 1, 16)).alias("mapping_id"))


@query("profile_findings", f"WITH {_SCORED}, auto AS (SELECT * FROM decided WHERE decision = 'auto') SELECT target_entity, target, 'TARGET_COLLISION' AS finding FROM auto GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT target_entity, target, 'REQUIRED_TARGET_MISSING' FROM model m WHERE NOT EXISTS (SELECT 1 FROM auto a WHERE a.target_entity = m.target_entity AND a.target = m.target)")
def profile_findings(load, spark):
    auto = _decided(load, spark).where("decision = 'auto'").select("target_entity", "target")
    twice = auto.groupBy("target_entity", "target").agg(F.count("*").alias("n")).where("n > 1").select("target_entity", "target", F.lit("TARGET_COLLISION").alias("finding"))
    missing = _model(spark).select("target_entity", "target").join(auto, ["target_entity", "target"], "left_anti")
    return twice.unionByName(missing.withColumn("finding", F.lit("REQUIRED_TARGET_MISSING")))


@query("mapping_overrides", f"""WITH {_SCORED}, again AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY score DESC, target_entity, target) AS r FROM ranked WHERE NOT (field = 'cust_no' AND target_entity = 'customer')),
first AS (SELECT *, round(score - lead(score) OVER (PARTITION BY entity, field ORDER BY r), 6) AS margin FROM again WHERE r <= 5 QUALIFY r = 1)
SELECT f.entity, f.field, CASE WHEN f.field = 'nation_key' THEN 'override' WHEN b.score IS NULL THEN 'unmapped' WHEN b.fit = 'incompatible' THEN 'review_type' WHEN b.score < 0.75 THEN 'review_score' WHEN b.margin < 0.05 THEN 'review_ambiguous' ELSE 'auto' END AS decision
FROM fields f LEFT JOIN first b ON b.entity = f.entity AND b.field = f.field""")
def mapping_overrides(load, spark):
    """Candidates that a reviewer rejected are left out; a field that a reviewer has mapped is not decided."""
    rejected = spark.createDataFrame([("cust_no", "customer")], "field string, target_entity string")
    forced = spark.createDataFrame([("nation_key", "nation")], "field string, forced string")
    rows = mapping.decided(mapping.candidates(_scores(load, spark).join(rejected, ["field", "target_entity"], "left_anti")), source_fields(load))
    return rows.join(forced, "field", "left").select("entity", "field", F.when(F.col("forced").isNotNull(), "override").otherwise(F.col("decision")).alias("decision"))


@query("type_compatibility", f"WITH {_SCORED} SELECT entity, field, target_entity, target, fit, {_FIT_SCORE} AS score FROM ranked")
def type_compatibility(load, spark):
    return _scores(load, spark).select("entity", "field", "target_entity", "target", "fit", mapping.fit_score(F.col("fit")).alias("score"))


@query("alias_lookup", f"WITH {_SCORED} SELECT f.entity, f.field, a.target_entity, a.target FROM fields f LEFT JOIN aliases a ON a.alias = f.field")
def alias_lookup(load, spark):
    aliases = spark.createDataFrame(list(_ALIASES), "alias string, target_entity string, target string").withColumn("k", text.identifier(F.col("alias")))
    return source_fields(load).withColumn("k", text.identifier(F.upper("field"))).join(aliases, "k", "left").select("entity", "field", "target_entity", "target")


@query("entity_match", f"WITH {_SCORED}, e AS (SELECT entity, target_entity, max(entity_score) AS s FROM met GROUP BY 1, 2) SELECT entity, arg_max(CASE WHEN s >= 0.6 THEN target_entity END, s) FILTER (s >= 0.6) AS matched FROM e GROUP BY 1")
def entity_match(load, spark):
    return mapping.matched_entities(source_fields(load), _model(spark))


# -- versions of a collection's schema: what its documents show before and after a change of the feed ------------------
_BEFORE, _AFTER = "o_orderkey % 5 IN (0, 1) AND o_orderkey % 7 <> 0", "o_orderkey % 5 = 3"


def _shown(where):
    k = "list_sort(list_distinct(list_transform(list(DISTINCT kind) FILTER (kind <> 'null'), lambda x: CASE x WHEN 'int' THEN 'integer' WHEN 'long' THEN 'integer' WHEN 'double' THEN 'decimal' WHEN 'bool' THEN 'boolean' ELSE x END)))"
    return f"SELECT 'orders' AS entity, path AS field, CASE WHEN len(k) = 1 THEN k[1] WHEN k = ['decimal', 'integer'] THEN 'decimal' ELSE 'unknown' END AS type FROM (SELECT path, {k} AS k FROM seen WHERE names <= 8 AND path NOT LIKE '%[]' AND {where} GROUP BY 1)"


_DIFF = f"""{_NODES}, {_SEEN}, diff AS (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.field, b.field) AS field, CASE WHEN a.field IS NULL THEN 'added' WHEN b.field IS NULL THEN 'removed' ELSE 'changed' END AS change,
 CASE WHEN a.field IS NOT NULL AND b.field IS NOT NULL THEN 'type' END AS attribute, CASE WHEN b.field IS NOT NULL THEN a.type END AS before, CASE WHEN a.field IS NOT NULL THEN b.type END AS after
 FROM ({_shown(_BEFORE)}) a FULL JOIN ({_shown(_AFTER)}) b ON a.field = b.field WHERE a.type IS DISTINCT FROM b.type),
drift AS (SELECT *, CASE WHEN change = 'added' THEN 'FIELD_ADDED' WHEN change = 'removed' THEN 'FIELD_REMOVED' WHEN before = 'integer' AND after = 'decimal' THEN 'TYPE_WIDENED' ELSE 'TYPE_CHANGED' END AS drift FROM diff)"""
_SEVERE = "CASE WHEN drift IN ('FIELD_REMOVED', 'TYPE_CHANGED') THEN 'breaking' ELSE 'info' END"


def _versions(load):
    documents = orders_as_documents(load)
    for where in (_BEFORE, _AFTER):
        seen = nested.structure(documents.where(where), F.try_parse_json("body"))
        yield seen.select(F.lit("orders").alias("entity"), F.col("path").alias("field"), F.col("field_type").alias("type"))


def _drift(load):
    return catalog.drift(catalog.diff(*_versions(load), ("type",)))


@query("schema_diff", f"WITH {_DIFF} SELECT * FROM diff")
def schema_diff(load, spark):
    return catalog.diff(*_versions(load), ("type",))


@query("schema_set_diff", f"WITH {_DIFF} SELECT change, count(*) AS n FROM diff WHERE change <> 'changed' GROUP BY 1")
def schema_set_diff(load, spark):
    old, new = (c.select("entity", "field") for c in _versions(load))
    added, removed = new.exceptAll(old).withColumn("change", F.lit("added")), old.exceptAll(new).withColumn("change", F.lit("removed"))
    return added.unionByName(removed).groupBy("change").agg(F.count("*").alias("n"))


@query("drift_findings", f"WITH {_DIFF} SELECT entity, field, drift, {_SEVERE} AS severity FROM drift")
def drift_findings(load, spark):
    return _drift(load).select("entity", "field", "drift", "severity")


@query("drift_gate", f"WITH {_DIFF} SELECT count(*) FILTER ({_SEVERE} = 'breaking') AS breaking, count(*) FILTER ({_SEVERE} = 'breaking') > 0 AS blocked FROM drift")
def drift_gate(load, spark):
    return _drift(load).agg(F.count_if(F.col("severity") == "breaking").alias("breaking")).withColumn("blocked", F.col("breaking") > 0)


_MAPPED = (("orders", "order.id", "order_id"), ("orders", "gift", "is_gift"), ("orders", "weight", "weight"), ("orders", "tags", "labels"))


@query("mapping_impact", f"WITH {_DIFF} SELECT m.field, m.target, d.drift, CASE WHEN {_SEVERE} = 'breaking' THEN 'blocked' WHEN d.drift IS NOT NULL THEN 'review' ELSE 'unaffected' END AS impact FROM {_rows(_MAPPED, 'entity, field, target')} m LEFT JOIN drift d ON m.field = d.field".replace(") t(entity, field, target) m", ") m(entity, field, target)"))
def mapping_impact(load, spark):
    mapped = spark.createDataFrame(list(_MAPPED), "entity string, field string, target string")
    found = _drift(load).select("entity", "field", "drift", "severity")
    return mapped.join(found, ["entity", "field"], "left").select("field", "target", "drift", F.when(F.col("severity") == "breaking", "blocked").when(F.col("drift").isNotNull(), "review").otherwise("unaffected").alias("impact"))


@query("humanize_label", f"WITH {_NODES}, {_SEEN} SELECT path AS name, array_to_string(list_transform(list_filter(regexp_split_to_array(path, '[._]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM seen WHERE names <= 8 AND path NOT LIKE '%[]' GROUP BY 1")
def humanize_label(load, spark):
    seen = nested.structure(orders_as_documents(load), F.try_parse_json("body"))
    return seen.select(F.col("path").alias("name"), text.humanized(F.col("path")).alias("label"))
