"""Queries of the scalar functions, casts, rules and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import casts, ident, rules, text
from tessera.plans.registry import query

# order totals as text, some of them unusable, as a raw source would deliver them
RAW_TOTAL = "CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' WHEN o_orderkey % 89 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END"


def raw_total():
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    return F.when(key % 97 == 0, "n/a").when(key % 89 == 0, "").when(key % 7 == 0, F.concat(F.floor(total).cast("string"), F.lit(".0"))).otherwise(total.cast("decimal(18,2)").cast("string"))


@query("type_name_normalize", """SELECT t AS raw, CASE WHEN upper(t) LIKE 'VARCHAR%' OR upper(t) LIKE 'CHAR%' OR upper(t) LIKE 'UUID%' THEN 'string' WHEN upper(t) LIKE 'DECIMAL%' OR upper(t) LIKE 'DOUBLE%' THEN 'decimal'
 WHEN upper(t) LIKE 'BIGINT%' OR upper(t) LIKE 'INT%' THEN 'integer' WHEN upper(t) LIKE 'DATETIME%' OR upper(t) LIKE 'TIMESTAMP%' THEN 'datetime' WHEN upper(t) LIKE 'DATE%' THEN 'date' WHEN upper(t) LIKE 'BOOL%' THEN 'boolean' WHEN upper(t) LIKE 'BYTEA%' THEN 'binary' WHEN upper(t) LIKE 'JSON%' THEN 'object' ELSE 'unknown' END AS kind, count(*) AS n
 FROM (SELECT ['varchar(20)','DECIMAL(12, 2)','double precision','bigint','int4','datetime2','timestamp with time zone','date','bool','bytea','jsonb','geometry','uuid'][1 + p_size % 13] AS t FROM part) GROUP BY 1, 2""")
def type_name_normalize(load, spark):
    names = ["varchar(20)", "DECIMAL(12, 2)", "double precision", "bigint", "int4", "datetime2", "timestamp with time zone", "date", "bool", "bytea", "jsonb", "geometry", "uuid"]
    raw = F.get(F.array(*map(F.lit, names)), (F.col("p_size") % 13).cast("int"))
    return load("part").select(raw.alias("raw"), text.common_type(raw).alias("kind")).groupBy("raw", "kind").agg(F.count("*").alias("n"))


@query("null_markers", "SELECT c_custkey, CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def null_markers(load, spark):
    return load("customer").select("c_custkey", text.null_if_marked(F.col("c_mktsegment"), ("BUILDING", "machinery")).alias("segment"))


@query("text_or_null", "SELECT doc_id, CASE WHEN lower(w) IN ('nan', 'none', 'null', 'nat', '') THEN NULL ELSE w END AS word FROM (SELECT doc_id, trim(CASE WHEN doc_id % 5 = 0 THEN ' NaN ' WHEN doc_id % 5 = 1 THEN 'null' WHEN doc_id % 5 = 2 THEN '  ' ELSE ' ' || source || ' ' END) AS w FROM documents)")
def text_or_null(load, spark):
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, " NaN ").when(k == 1, "null").when(k == 2, "  ").otherwise(F.concat(F.lit(" "), F.col("source"), F.lit(" ")))
    return load("documents").select("doc_id", text.text_or_null(raw).alias("word"))


@query("string_normalize", r"SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS value FROM documents")
def string_normalize(load, spark):
    return load("documents").select("doc_id", text.normalized(F.col("text"), case="lower").alias("value"))


_IDENT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\s+', '_', 'g'), '[^a-z0-9_.\-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("normalize_identifier", f"SELECT p_partkey, {_IDENT.format('p_name')} AS name_id, {_IDENT.format('p_type')} AS type_id FROM part")
def normalize_identifier(load, spark):
    return load("part").select("p_partkey", text.identifier(F.col("p_name")).alias("name_id"), text.identifier(F.col("p_type")).alias("type_id"))


@query("canonical_ids", f"SELECT c_custkey, 'rec:shop:customer:' || {_IDENT.format('c_name')} AS record_id, 'customer' AS entity, {_IDENT.format('c_name')} AS key FROM customer")
def canonical_ids(load, spark):
    made = ident.canonical_id(F.lit("Shop"), F.lit("Customer"), F.col("c_name"))
    return load("customer").select("c_custkey", made.alias("record_id")).withColumn("p", ident.parsed_id(F.col("record_id"))).select("c_custkey", "record_id", "p.entity", "p.key")


@query("surrogate_key_flag", "SELECT c_custkey, true AS number_key, regexp_full_match(trim(c_name), '[0-9]+') AS name_key FROM customer")
def surrogate_key_flag(load, spark):
    return load("customer").select("c_custkey", ident.is_surrogate(F.col("c_custkey")).alias("number_key"), ident.is_surrogate(F.col("c_name")).alias("name_key"))


@query("vector_ids", r"""WITH h AS (SELECT vec_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('engine/' || vec_id)) AS d FROM embeddings)
SELECT vec_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || printf('%02x', (CAST('0x' || substr(d, 17, 2) AS INTEGER) & 63) | 128) || substr(d, 19, 2) || '-' || substr(d, 21, 12) AS vector_id FROM h""")
def vector_ids(load, spark):
    return load("embeddings").select("vec_id", ident.uuid5(F.concat(F.lit("engine/"), F.col("vec_id"))).alias("vector_id"))


_ORDER_JSON = """'{"orderdate":"' || strftime(o_orderdate, '%Y-%m-%d') || '","orderkey":"' || o_orderkey || '","status":"' || o_orderstatus || '"}'"""


def order_fields():
    return {"orderkey": F.col("o_orderkey"), "status": F.col("o_orderstatus"), "orderdate": F.date_format("o_orderdate", "yyyy-MM-dd")}


@query("content_hash", f"SELECT o_orderkey, sha256({_ORDER_JSON}) AS content_hash FROM orders")
def content_hash(load, spark):
    return load("orders").select("o_orderkey", ident.content_hash(order_fields()).alias("content_hash"))


@query("representation_hash", f"SELECT o_orderkey, sha256({_ORDER_JSON}) AS representation_hash, true AS stable FROM orders")
def representation_hash(load, spark):
    volatile = {"ingested_at": F.lit("2026-01-01"), "run_id": F.lit("r1")}
    fields = order_fields() | volatile
    kept = {k: v for k, v in fields.items() if k not in volatile}
    made = ident.content_hash(kept)
    return load("orders").select("o_orderkey", made.alias("representation_hash"), (made == ident.content_hash(order_fields())).alias("stable"))


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in b"filter-key".ljust(64, b"\0")).hex()


@query("filter_tokens", f"SELECT c_custkey, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode('shop' || chr(31) || 'customer' || chr(31) || 'segment' || chr(31) || c_mktsegment)))) AS token FROM customer")
def filter_tokens(load, spark):
    message = F.concat_ws("\x1f", F.lit("shop"), F.lit("customer"), F.lit("segment"), F.col("c_mktsegment"))
    return load("customer").select("c_custkey", ident.hmac_sha256(b"filter-key", message).alias("token"))


_NAMES = ["customerID", "inv_no", "tbl_Cust", "XMLHttpRequest", "line1 total", "e_mail", "po_dt", "vend.code"]
_TOKENS = {"customerID": "customer id", "inv_no": "inv no", "tbl_Cust": "tbl cust", "XMLHttpRequest": "xml http request", "line1 total": "line 1 total", "e_mail": "e mail", "po_dt": "po dt", "vend.code": "vend code"}
_CANONICAL = {"customerID": "customer id", "inv_no": "invoice number", "tbl_Cust": "customer", "XMLHttpRequest": "xml http request", "line1 total": "line 1 total", "e_mail": "email email", "po_dt": "purchase order date", "vend.code": "supplier id"}


def _names(load):
    return load("nation").select("n_nationkey", F.get(F.array(*map(F.lit, _NAMES)), F.col("n_nationkey") % 8).alias("name"))


def _name_case(table):
    return "CASE [" + ",".join(f"'{n}'" for n in _NAMES) + "][1 + n_nationkey % 8] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query("split_tokens", f"SELECT n_nationkey, {_name_case(_TOKENS)} AS tokens FROM nation")
def split_tokens(load, spark):
    return _names(load).select("n_nationkey", F.array_join(text.split_tokens(F.col("name")), " ").alias("tokens"))


@query("canonical_tokens", f"SELECT n_nationkey, {_name_case(_CANONICAL)} AS tokens FROM nation")
def canonical_tokens(load, spark):
    return _names(load).select("n_nationkey", F.array_join(text.canonical_tokens(F.col("name")), " ").alias("tokens"))


@query("token_jaccard", """WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS similarity FROM t""")
def token_jaccard(load, spark):
    a, b = (F.split(F.lower(c), " ") for c in ("p_name", "p_type"))
    return load("part").select("p_partkey", text.jaccard(a, b).alias("similarity"))


@query("clip_text", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS clipped FROM documents")
def clip_text(load, spark):
    return load("documents").select("doc_id", text.clipped(F.col("text"), 200, "...").alias("clipped"))


@query("format_value", "SELECT o_orderkey, 'status: ' || lower(o_orderstatus) || '; total: ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '; on: ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS line FROM orders")
def format_value(load, spark):
    parts = {"status": F.lower("o_orderstatus"), "total": F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "on": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    return load("orders").select("o_orderkey", F.concat_ws("; ", *[F.concat(F.lit(k + ": "), v) for k, v in parts.items()]).alias("line"))


@query("representation_text", "SELECT o_orderkey, 'Entity: Order' || chr(10) || 'Source: shop' || chr(10) || 'Order Key: ' || o_orderkey || chr(10) || 'Order Priority: ' || o_orderpriority || chr(10) || 'Order Status: ' || o_orderstatus AS content FROM orders")
def representation_text(load, spark):
    from tessera.operators.documents import rendered

    fields = {"order_status": F.col("o_orderstatus"), "order_key": F.col("o_orderkey").cast("string"), "order_priority": F.col("o_orderpriority"), "note": F.lit(None).cast("string")}
    return load("orders").select("o_orderkey", rendered("Order", "shop", fields).alias("content"))


@query("coerce_timestamp", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE date_trunc('second', ts) END AS at FROM events")
def coerce_timestamp(load, spark):
    k, ts = F.col("event_id") % 4, F.col("ts")
    raw = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format(ts, "dd/MM/yyyy HH:mm:ss")).when(k == 2, F.date_format(ts, "dd-MM-yyyy")).otherwise("soon")
    found = casts.to_datetime(raw, ("dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy"))
    return load("events").select("event_id", found["value"].cast("timestamp_ntz").alias("at"))


@query("classify_csv_value", f"""SELECT o_orderkey, CASE WHEN v = '' THEN 'empty' WHEN v = 'n/a' THEN 'null_marker' WHEN regexp_full_match(v, '-?(0|[1-9][0-9]*)') THEN 'integer' WHEN regexp_full_match(v, '-?[0-9]+\\.[0-9]*') THEN 'decimal' ELSE 'string' END AS total_kind,
 'date' AS date_kind, 'string' AS priority_kind FROM (SELECT o_orderkey, {RAW_TOTAL} AS v FROM orders)""")
def classify_csv_value(load, spark):
    kind = lambda c: text.csv_kind(c, ("n/a",))
    return load("orders").select("o_orderkey", kind(raw_total()).alias("total_kind"), kind(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_kind"), kind(F.col("o_orderpriority")).alias("priority_kind"))


@query("cast_to_integer", f"SELECT o_orderkey, CASE WHEN v IN ('', 'n/a') OR CAST(v AS DECIMAL(18,2)) <> floor(CAST(v AS DECIMAL(18,2))) THEN NULL ELSE CAST(CAST(v AS DECIMAL(18,2)) AS BIGINT) END AS value, CASE WHEN v IN ('', 'n/a') OR CAST(v AS DECIMAL(18,2)) <> floor(CAST(v AS DECIMAL(18,2))) THEN 'INVALID_INTEGER' END AS issue FROM (SELECT o_orderkey, {RAW_TOTAL} AS v FROM orders)".replace("CAST(v AS", "TRY_CAST(v AS"))
def cast_to_integer(load, spark):
    return load("orders").select("o_orderkey", casts.to_integer(raw_total()).alias("c")).select("o_orderkey", "c.value", "c.issue")


@query("cast_to_decimal", f"SELECT o_orderkey, CAST(TRY_CAST(v AS DECIMAL(18,2)) AS DOUBLE) AS value, CASE WHEN TRY_CAST(v AS DECIMAL(18,2)) IS NULL THEN 'INVALID_DECIMAL' END AS issue FROM (SELECT o_orderkey, {RAW_TOTAL} AS v FROM orders)")
def cast_to_decimal(load, spark):
    return load("orders").select("o_orderkey", casts.to_decimal(raw_total()).alias("c")).select("o_orderkey", F.col("c.value").cast("double").alias("value"), "c.issue")


@query("cast_to_boolean", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS value, CASE WHEN o_orderkey % 3 = 2 THEN 'INVALID_BOOLEAN' END AS issue FROM orders")
def cast_to_boolean(load, spark):
    raw = F.get(F.array(F.lit("TRUE"), F.lit(" false "), F.lit("yes")), (F.col("o_orderkey") % 3).cast("int"))
    return load("orders").select("o_orderkey", casts.to_boolean(raw).alias("c")).select("o_orderkey", "c.value", "c.issue")


@query("cast_to_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS value, CASE WHEN o_orderkey % 3 = 2 THEN 'INVALID_DATE' END AS issue FROM orders")
def cast_to_date(load, spark):
    d = F.col("o_orderdate")
    raw = F.get(F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")), (F.col("o_orderkey") % 3).cast("int"))
    return load("orders").select("o_orderkey", casts.to_date(raw, ("dd/MM/yyyy",)).alias("c")).select("o_orderkey", "c.value", "c.issue")


@query("cast_to_datetime", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS value, CASE WHEN event_id % 3 = 2 THEN 'INVALID_DATETIME' END AS issue FROM events")
def cast_to_datetime(load, spark):
    ts = F.col("ts")
    raw = F.get(F.array(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy")), (F.col("event_id") % 3).cast("int"))
    return load("events").select("event_id", casts.to_datetime(raw).alias("c")).select("event_id", F.col("c.value").cast("timestamp_ntz").alias("value"), "c.issue")


@query("cast_to_string", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date_text, 'BOOLEAN_NOT_TEXT' AS flag_issue FROM orders")
def cast_to_string(load, spark):
    flag = casts.to_text(F.col("o_orderkey") % 2 == 0, "boolean")
    return load("orders").select("o_orderkey", casts.to_text(F.col("o_orderkey"), "bigint")["value"].alias("key_text"), casts.to_text(F.col("o_orderdate"), "timestamp")["value"].alias("date_text"), flag["issue"].alias("flag_issue"))


@query("cast_to_binary", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS value, CASE WHEN c_custkey % 2 = 1 THEN 'INVALID_BASE64' END AS issue FROM customer")
def cast_to_binary(load, spark):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.base64(F.encode("c_name", "UTF-8"))).otherwise("!not base64!")
    return load("customer").select("c_custkey", casts.to_binary(raw).alias("c")).select("c_custkey", F.decode("c.value", "UTF-8").alias("value"), "c.issue")


def _rule(load, table, key, value, chain):
    return load(table).select(key, rules.compiled(chain, value).alias("r")).select(key, "r.value", "r.issue")


_NO_ISSUE = "CAST(NULL AS VARCHAR) AS issue"


@query("rule_copy_rename", f"SELECT c_custkey, c_name AS value, {_NO_ISSUE} FROM customer")
def rule_copy_rename(load, spark):
    return _rule(load, "customer", "c_custkey", F.col("c_name"), [("copy", {}), ("rename", {})])


@query("rule_cast", f"SELECT o_orderkey, CASE WHEN TRY_CAST(v AS DECIMAL(18,2)) IS NOT NULL THEN v || CASE WHEN v LIKE '%.0' THEN '00000000000000000' ELSE '0000000000000000' END END AS value, CASE WHEN TRY_CAST(v AS DECIMAL(18,2)) IS NULL THEN 'INVALID_DECIMAL' END AS issue FROM (SELECT o_orderkey, {RAW_TOTAL} AS v FROM orders)")
def rule_cast(load, spark):
    return _rule(load, "orders", "o_orderkey", raw_total(), [("cast", {"to": "decimal"})])


@query("rule_default", f"SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN 'none given' ELSE c_mktsegment END AS value, {_NO_ISSUE} FROM customer")
def rule_default(load, spark):
    return _rule(load, "customer", "c_custkey", F.col("c_mktsegment"), [("null_markers", {"markers": ["building"]}), ("default", {"value_if_null": "none given"})])


@query("rule_enum_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS value, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'UNKNOWN_ENUM_VALUE' END AS issue FROM orders")
def rule_enum_map(load, spark):
    return _rule(load, "orders", "o_orderkey", F.col("o_orderstatus"), [("enum_map", {"mapping": {"O": "open", "F": "filled"}})])


@query("rule_nested_path", f"SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS value, {_NO_ISSUE} FROM events")
def rule_nested_path(load, spark):
    found = rules.at_key(F.col("props"), F.get(F.json_object_keys("props"), F.lit(0)))
    return load("events").select("event_id", found["value"].alias("value"), found["issue"].alias("issue"))


@query("rule_date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value, CASE WHEN o_orderkey % 11 = 0 THEN 'DATE_PARSE_FAILED' END AS issue FROM orders")
def rule_date_parse(load, spark):
    raw = F.when(F.col("o_orderkey") % 11 == 0, "tomorrow").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return _rule(load, "orders", "o_orderkey", raw, [("date_parse", {"format": "%d/%m/%Y"})])


@query("rule_concat", "SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS joined, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '-x' END AS strict, CASE WHEN o_orderkey % 2 = 1 THEN 'CONCAT_INPUT_NULL' END AS issue FROM orders")
def rule_concat(load, spark):
    maybe = F.when(F.col("o_orderkey") % 2 == 0, "x")
    strict = rules.concat([F.col("o_orderstatus"), maybe], "-", skip_missing=False)
    return load("orders").select("o_orderkey", rules.concat([F.col("o_orderstatus"), F.lit(None).cast("string"), F.col("o_orderpriority")], "-")["value"].alias("joined"), strict["value"].alias("strict"), strict["issue"].alias("issue"))


@query("rule_split", "SELECT p_partkey, string_split(p_name, ' ')[2] AS value, CASE WHEN len(string_split(p_name, ' ')) < 2 THEN 'SPLIT_INDEX_OUT_OF_RANGE' END AS issue FROM part")
def rule_split(load, spark):
    return _rule(load, "part", "p_partkey", F.col("p_name"), [("split", {"separator": " ", "index": 1})])


@query("rule_trim", f"SELECT p_partkey, p_brand AS value, {_NO_ISSUE} FROM part")
def rule_trim(load, spark):
    return _rule(load, "part", "p_partkey", F.concat(F.lit("*-"), F.col("p_brand"), F.lit("  ")), [("trim", {}), ("trim", {"chars": "*-"})])


@query("rule_constant", f"SELECT p_partkey, 'EUR' AS value, {_NO_ISSUE} FROM part")
def rule_constant(load, spark):
    return _rule(load, "part", "p_partkey", F.col("p_brand"), [("constant", {"to": "EUR"})])


@query("rule_redact", f"SELECT c_custkey, CASE WHEN lower(c_mktsegment) <> 'building' THEN '***' END AS value, {_NO_ISSUE} FROM customer")
def rule_redact(load, spark):
    return _rule(load, "customer", "c_custkey", F.col("c_mktsegment"), [("null_markers", {"markers": ["building"]}), ("redact", {})])


@query("rule_chain", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y') END AS value, CASE WHEN o_orderkey % 11 = 0 THEN 'DATE_PARSE_FAILED' END AS issue FROM orders")
def rule_chain(load, spark):
    raw = F.when(F.col("o_orderkey") % 11 == 0, " tomorrow ").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "dd/MM/yyyy")))
    return _rule(load, "orders", "o_orderkey", raw, [("trim", {}), ("date_parse", {"format": "%d/%m/%Y"}), ("split", {"separator": "-", "index": 0})])


@query("hash_embedding", "SELECT doc_id, round(CAST('0x' || substr(sha256(source), 1, 2) AS INTEGER) / 255.0, 6) AS first, round(CAST('0x' || substr(sha256(source), 31, 2) AS INTEGER) / 255.0, 6) AS last FROM documents")
def hash_embedding(load, spark):
    v = ident.hash_embedding(F.col("source"))
    return load("documents").select("doc_id", F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(F.get(v, F.lit(15)), 6).alias("last"))


@query("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(load, spark):
    e = load("embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(ident.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("sensitivity_resolve", "SELECT doc_id, ['public', 'internal', 'confidential', 'restricted'][1 + greatest(doc_id % 4, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 2 END)] AS sensitivity FROM documents")
def sensitivity_resolve(load, spark):
    from tessera.operators.documents import most_sensitive

    levels = F.array(*map(F.lit, ("public", "internal", "confidential", "restricted")))
    declared = F.get(levels, (F.col("doc_id") % 4).cast("int"))
    other = F.when(F.col("doc_id") % 3 != 0, F.get(levels, (F.col("doc_id") % 2).cast("int")))
    return load("documents").select("doc_id", most_sensitive(declared, F.coalesce(other, F.lit("internal"))).alias("sensitivity"))


@query("serialized_size", "SELECT o_orderkey, CAST(octet_length(encode('{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}')) AS BIGINT) AS size FROM orders")
def serialized_size(load, spark):
    return load("orders").select("o_orderkey", F.octet_length(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))).cast("bigint").alias("size"))
