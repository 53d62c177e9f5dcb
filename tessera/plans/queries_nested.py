"""Queries of nested records: an order with its lines, lists and deep parts as one JSON document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import nested
from tessera.plans.registry import query

_DEEP = '{"a":' * 14 + "1" + "}" * 14
#: Every document has a record, a list of records, a list of words that may be empty, and a field that is null or not;
#: some have a field of changing type, a list of lists, an empty record, and a chain deeper than is walked.
_LINE = """'{"mode":' || CASE WHEN l_returnflag = 'R' THEN '"' || l_linestatus || '"' ELSE 'null' END || ',"n":' || l_linenumber || ',"part":{"id":' || l_partkey || '}}'"""
_DOC = f"""'{{"order":{{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","customer":{{"id":' || o_custkey || ',"note":' || CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE '"n"' END || '}}}},"lines":' || lines
 || ',"tags":' || CASE WHEN o_orderkey % 3 = 0 THEN '[]' ELSE '["A","B"]' END || CASE WHEN o_orderkey % 5 = 0 THEN ',"gift":true' WHEN o_orderkey % 5 = 1 THEN ',"gift":"yes"' WHEN o_orderkey % 5 = 2 THEN ',"gift":{{}}' ELSE '' END
 || CASE WHEN o_orderkey % 7 = 0 THEN ',"grid":[[1,2],[3]],"weight":' || (o_orderkey % 10) || '.5' ELSE ',"weight":' || (CAST(o_orderkey AS BIGINT) * 100000) END || CASE WHEN o_orderkey % 50 = 0 THEN ',"deep":{_DEEP}' ELSE '' END || ',"version":7}}'"""
_DOCS = f"""docs AS (SELECT o_orderkey, {_DOC} AS body FROM (SELECT o.*, coalesce('[' || x.lines || ']', '[]') AS lines FROM orders o
 LEFT JOIN (SELECT l_orderkey, string_agg({_LINE}, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS lines FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey))"""
#: Nodes of the documents; ``depth`` counts names and list steps, ``first`` is the shape's own first elements only.
_NODES = f"""{_DOCS}, raw AS (SELECT o_orderkey, t.fullkey, t.type, CAST(t.value AS VARCHAR) AS value FROM docs, json_tree(docs.body) t WHERE t.fullkey <> '$'),
nodes AS (SELECT *, len(fullkey) - len(replace(replace(fullkey, '.', ''), '[', '')) AS depth, regexp_matches(fullkey, '\\[[1-9]') AS later, type IN ('OBJECT', 'ARRAY') AS container FROM raw)"""
_OPEN = "(container AND value NOT IN ('[]', '{}'))"
_PATH = "regexp_replace(substr(fullkey, 3), '\\[[0-9]+\\]', '[]', 'g')"


def orders_as_documents(load):
    """(o_orderkey, body) with ``body`` as text; ``orders`` and ``lineitem`` have few lines an order."""
    lines = load("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.expr(_LINE).alias("line")).groupBy("l_orderkey")
    lines = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "line"))), lambda x: x["line"]), ",").alias("x"))
    rows = load("orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("lines", F.coalesce(F.concat(F.lit("["), "x", F.lit("]")), F.lit("[]")))
    return rows.select("o_orderkey", F.expr(_DOC).alias("body"))


def _records(load):
    return orders_as_documents(load).select("o_orderkey", F.try_parse_json("body").alias("record"))


@query("flatten_props", f"""WITH {_NODES} SELECT o_orderkey, {_PATH} AS path, value FROM nodes n
WHERE NOT later AND depth <= 13 AND (depth = 13 OR NOT {_OPEN} OR (type = 'ARRAY' AND value[2] <> '{{')) AND NOT (fullkey LIKE '%[0]' AND type <> 'OBJECT') AND NOT fullkey LIKE '%[0][0]%'""")
def flatten_props(load, spark):
    return _records(load).select("o_orderkey", F.explode(nested.flattened(F.col("record"))).alias("path", "value"))


@query("representation_flatten", f"""WITH {_NODES} SELECT o_orderkey, substr(fullkey, 3) AS path, value FROM nodes WHERE fullkey NOT LIKE '%[%' AND fullkey <> '$.version' AND depth <= 13 AND type <> 'OBJECT'""")
def representation_flatten(load, spark):
    """Deep parts end in a record below the deepest level, which is no value and is left out; empty records likewise."""
    return _records(load).select("o_orderkey", F.explode(nested.business_leaves(F.col("record"), ("version",))).alias("path", "value"))


@query("json_leaf_count", f"WITH {_NODES} SELECT o_orderkey, CAST(count(*) AS INTEGER) AS leaves FROM nodes WHERE NOT later AND depth <= 13 AND (depth = 13 OR NOT {_OPEN}) GROUP BY 1")
def json_leaf_count(load, spark):
    return _records(load).select("o_orderkey", nested.leaf_count(F.col("record")).alias("leaves"))


_KIND = "CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'double' WHEN 'NULL' THEN 'null' ELSE CASE WHEN CAST(value AS BIGINT) <= 2147483647 THEN 'int' ELSE 'long' END END"
_SEEN = f"seen AS (SELECT o_orderkey, {_PATH} AS path, {_KIND} AS kind, container AND type = 'OBJECT' AND value <> '{{}}' AS record, len(fullkey) - len(replace(fullkey, '.', '')) AS names FROM nodes WHERE NOT regexp_matches(fullkey, '\\]\\['))"


@query("json_type_alias", f"WITH {_NODES}, {_SEEN} SELECT path, kind, count(*) AS n FROM seen WHERE names <= 8 GROUP BY 1, 2")
def json_type_alias(load, spark):
    return _records(load).select(F.explode(nested.observed(F.col("record"))).alias("x")).groupBy("x.path", "x.kind").agg(F.count("*").alias("n"))


_INNER = "CASE WHEN len(k) > 1 THEN 'mixed<' || array_to_string(k, '|') || '>' ELSE k[1] END"
_COMMON = "list_sort(list_distinct(list_transform(k, lambda x: CASE x WHEN 'int' THEN 'integer' WHEN 'long' THEN 'integer' WHEN 'double' THEN 'decimal' WHEN 'bool' THEN 'boolean' ELSE x END)))"


@query("infer_document_structure", f"""WITH {_NODES}, {_SEEN}, c AS (SELECT path, kind, count(*) AS n, max(record AND names = 8) AS truncated FROM seen WHERE names <= 8 GROUP BY 1, 2),
h AS (SELECT path, sum(n)::BIGINT AS n_values, coalesce(sum(n) FILTER (kind = 'null'), 0)::BIGINT AS nulls, string_agg(kind || ':' || n, ',' ORDER BY kind) AS types, coalesce(list(kind ORDER BY kind) FILTER (kind <> 'null'), []) AS k, max(truncated) AS truncated FROM c GROUP BY 1),
p AS (SELECT path, count(DISTINCT o_orderkey) AS present FROM seen WHERE names <= 8 GROUP BY 1)
SELECT h.path, present, h.n_values, h.nulls, round(present / (SELECT count(*) FROM orders), 6) AS presence, h.types, coalesce(e.types, '') AS element_types,
 CASE WHEN len(h.k) = 0 THEN 'null' WHEN h.k = ['array'] THEN 'array<' || CASE WHEN e.path IS NULL THEN 'empty' WHEN len(e.k) = 0 THEN 'null' ELSE {_INNER.replace('(k', '(e.k').replace(' k[', ' e.k[')} END || '>' ELSE {_INNER.replace('(k', '(h.k').replace(' k[', ' h.k[')} END AS source_type,
 CASE WHEN len(h.k) = 0 THEN 'unknown' WHEN len({_COMMON.replace('(k,', '(h.k,')}) = 1 THEN ({_COMMON.replace('(k,', '(h.k,')})[1] WHEN {_COMMON.replace('(k,', '(h.k,')} = ['decimal', 'integer'] THEN 'decimal' ELSE 'unknown' END AS field_type, h.truncated OR coalesce(e.truncated, false) AS truncated
FROM h JOIN p USING (path) LEFT JOIN h e ON e.path = h.path || '[]' WHERE h.path NOT LIKE '%[]'""")
def infer_document_structure(load, spark):
    return nested.structure(_records(load), F.col("record"))
