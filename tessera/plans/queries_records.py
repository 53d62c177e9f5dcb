"""Queries of transformation, validation, profiling and process mining."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import casts, ident, text
from tessera.operators import documents, prefix, process, transform
from tessera.plans.queries_scalar import RAW_TOTAL, raw_total
from tessera.plans.registry import query

_ORDERS = f"(SELECT *, {RAW_TOTAL} AS v FROM orders)"
_AMOUNT = "TRY_CAST(v AS DECIMAL(18,2))"


def canonical(load):
    """Raw orders as canonical purchase orders, with all their issues."""
    amount = casts.to_decimal(raw_total())
    rows = load("orders").select("o_orderkey", ident.canonical_id(F.lit("shop"), F.lit("order"), F.concat(F.lit("ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))).alias("record_id"), "o_custkey", amount["value"].alias("amount"), amount["issue"].alias("amount_issue"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    found = transform.gathered(
        transform.issue(F.col("amount_issue").isNotNull(), "INVALID_DECIMAL", "amount"), *transform.required(F.col("record_id"), "record_id"), *transform.in_range(F.col("amount"), "amount", high=300000.0),
        transform.allowed(F.col("status"), "status", ("O", "F")), *transform.matching(F.col("priority"), "priority", pattern=r"\d-[A-Z ]+"),
    )
    return rows.withColumn("issues", found).withColumn("outcome", F.when(transform.blocking(F.col("issues")), "rejected").otherwise("accepted"))


_CODES = f"""list_filter([CASE WHEN {_AMOUNT} IS NULL THEN 'INVALID_DECIMAL' END, CASE WHEN {_AMOUNT} > 300000 THEN 'ABOVE_MAXIMUM' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'VALUE_NOT_ALLOWED' END, CASE WHEN NOT regexp_full_match(o_orderpriority, '[0-9]-[A-Z ]+') THEN 'PATTERN_MISMATCH' END], lambda x: x IS NOT NULL)"""


@query("canonical_orders", f"SELECT o_orderkey, 'rec:shop:order:ord-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS record_id, o_custkey, CAST({_AMOUNT} AS DOUBLE) AS amount, o_orderstatus AS status, array_to_string({_CODES}, ',') AS codes, CASE WHEN len({_CODES}) > 0 THEN 'rejected' ELSE 'accepted' END AS outcome FROM {_ORDERS}")
def canonical_orders(load, spark):
    return canonical(load).select("o_orderkey", "record_id", "o_custkey", F.col("amount").cast("double").alias("amount"), "status", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), "outcome")


@query("rejected_records", f"SELECT o_orderkey, array_to_string({_CODES}, ',') AS reasons FROM {_ORDERS} WHERE len({_CODES}) > 0")
def rejected_records(load, spark):
    return canonical(load).where("outcome = 'rejected'").select("o_orderkey", F.array_join(transform.reasons(F.col("issues")), ",").alias("reasons"))


@query("issue_rows", f"SELECT o_orderkey, code, CASE code WHEN 'VALUE_NOT_ALLOWED' THEN 'status' WHEN 'PATTERN_MISMATCH' THEN 'priority' ELSE 'amount' END AS field, 'error' AS severity, 'iss.' || substr(sha256(code || '|' || o_orderkey || '|' || CASE code WHEN 'VALUE_NOT_ALLOWED' THEN 'status' WHEN 'PATTERN_MISMATCH' THEN 'priority' ELSE 'amount' END), 1, 20) AS issue_id FROM (SELECT o_orderkey, unnest({_CODES}) AS code FROM {_ORDERS})")
def issue_rows(load, spark):
    return transform.issue_rows(canonical(load), "o_orderkey")


@query("issue_counts", f"SELECT 'error' AS severity, code, count(*) AS n FROM (SELECT unnest({_CODES}) AS code FROM {_ORDERS}) GROUP BY code")
def issue_counts(load, spark):
    return canonical(load).select(F.explode("issues").alias("i")).groupBy("i.severity", "i.code").agg(F.count("*").alias("n"))


@query("run_summary", f"""WITH o AS (SELECT CASE WHEN len({_CODES}) > 0 THEN 1 ELSE 0 END AS bad FROM {_ORDERS}), s AS (SELECT count(*) AS n_read, sum(1 - bad)::BIGINT AS n_transformed, sum(bad)::BIGINT AS n_failed, 0::BIGINT AS n_skipped FROM o)
SELECT *, round(n_failed / n_read, 6) AS failed_ratio, round(n_transformed / n_read, 6) AS transformed_ratio, CASE WHEN n_failed / n_read > 0.5 OR n_transformed / n_read < 0.1 THEN 'FAILED' WHEN n_failed > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status FROM s""")
def run_summary(load, spark):
    return transform.run_summary(canonical(load))


@query("validate_required", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'REQUIRED_FIELD_MISSING' WHEN o_orderkey % 5 = 1 THEN 'NULL_NOT_ALLOWED' END AS code FROM orders")
def validate_required(load, spark):
    k = F.col("o_orderkey") % 5
    found = transform.gathered(*transform.required(F.when(k > 1, F.col("o_orderstatus")), "status", present=k != 0))
    return load("orders").select("o_orderkey", F.get(found, F.lit(0))["code"].alias("code"))


@query("validate_allowed_values", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1")
def validate_allowed_values(load, spark):
    bad = load("orders").where(transform.allowed(F.col("o_orderstatus"), "status", ("O", "F")).isNotNull())
    return bad.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("validate_range", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'BELOW_MINIMUM' WHEN l_quantity > 45 THEN 'ABOVE_MAXIMUM' END AS code FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45")
def validate_range(load, spark):
    found = transform.gathered(*transform.in_range(F.col("l_quantity"), "quantity", 5, 45))
    return load("lineitem").select("l_orderkey", "l_linenumber", F.get(found, F.lit(0))["code"].alias("code")).where("code is not null")


@query("validate_pattern", "SELECT p_partkey, CASE WHEN length(p_brand) > 8 THEN 'TOO_LONG' WHEN NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]*') THEN 'PATTERN_MISMATCH' END AS code FROM part")
def validate_pattern(load, spark):
    found = transform.gathered(*transform.matching(F.col("p_brand"), "brand", pattern="Brand#[1-3][0-9]*", longest=8))
    return load("part").select("p_partkey", F.get(found, F.lit(0))["code"].alias("code"))


@query("validate_reference", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') AS reference_exists FROM orders")
def validate_reference(load, spark):
    known = load("customer").where("c_mktsegment <> 'BUILDING'")
    return transform.referenced(load("orders").select("o_orderkey", "o_custkey"), "o_custkey", known, "c_custkey").select("o_orderkey", "reference_exists")


@query("form_validation", "SELECT conv_id, turn, concat_ws(',', CASE WHEN role NOT IN ('user', 'assistant') THEN 'VALUE_NOT_ALLOWED' END, CASE WHEN length(text) > 400 THEN 'TOO_LONG' END) AS codes FROM conversations")
def form_validation(load, spark):
    found = transform.gathered(transform.allowed(F.col("role"), "role", ("user", "assistant")), *transform.matching(F.col("text"), "text", longest=400))
    return load("conversations").select("conv_id", "turn", F.array_join(F.transform(found, lambda i: i["code"]), ",").alias("codes"))


@query("acl_filter", "SELECT doc_id FROM documents WHERE source = 'src1' OR list_contains(['en', CASE WHEN doc_id % 2 = 0 THEN 'fr' ELSE 'de' END], lang)")
def acl_filter(load, spark):
    readers = F.array(F.lit("en"), F.when(F.col("doc_id") % 2 == 0, "fr").otherwise("de"))
    return load("documents").where((F.col("source") == "src1") | F.array_contains(readers, F.col("lang"))).select("doc_id")


@query("computed_fields", "SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE o_orderstatus END AS tag, 'EUR' AS currency FROM orders")
def computed_fields(load, spark):
    even = F.when(F.col("o_orderkey") % 2 == 0, "even")
    return load("orders").select("o_orderkey", F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("label"), F.coalesce(even, F.col("o_orderstatus")).alias("tag"), F.lit("EUR").alias("currency"))


@query("source_native_customer", "SELECT 'CUST|' || c_custkey AS business_key, c_name, CAST(round(c_acctbal, 2) AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def source_native_customer(load, spark):
    balance = F.coalesce(F.round("c_acctbal", 2), F.col("c_acctbal"))
    return load("customer").select(F.concat_ws("|", F.lit("CUST"), F.col("c_custkey").cast("string")).alias("business_key"), "c_name", balance.alias("c_acctbal"), "c_mktsegment")


@query("duplicate_policy", """SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS occurrence, first_value(o_orderkey) OVER w AS first_seen, CASE WHEN row_number() OVER w > 1 THEN 'skipped' ELSE 'accepted' END AS outcome FROM orders
WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey)""")
def duplicate_policy(load, spark):
    out = transform.duplicates(load("orders"), [F.col("o_custkey"), F.col("o_orderstatus")], ["o_orderkey"], "SKIP")
    return out.select("o_orderkey", "occurrence", "first_seen", "outcome")


@query("fail_fast_cutoff", "SELECT o_orderkey, f AS failures_before FROM (SELECT o_orderkey, coalesce(sum(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM orders) WHERE f <= 2")
def fail_fast_cutoff(load, spark):
    return transform.before_threshold(load("orders"), "o_orderpriority", "o_orderkey", F.col("o_totalprice") > 300000, 2).select("o_orderkey", "failures_before")


@query("duplicate_ids", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(load, spark):
    return load("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


@query("infer_csv_types", f"""WITH v AS (SELECT 'date' AS c, 'date' AS k, count(*) AS n FROM orders UNION ALL SELECT 'total', CASE WHEN v = '' THEN 'empty' WHEN v = 'n/a' THEN 'null_marker' ELSE 'decimal' END, count(*) FROM {_ORDERS} GROUP BY 2 UNION ALL SELECT 'key', 'integer', count(*) FROM orders)
SELECT c AS column_name, string_agg(k || '=' || n, ',' ORDER BY k) AS kinds, max(CASE c WHEN 'total' THEN 'decimal' WHEN 'key' THEN 'integer' ELSE 'date' END) AS inferred FROM v GROUP BY c""")
def infer_csv_types(load, spark):
    raw = load("orders").select(F.col("o_orderkey").cast("string").alias("key"), raw_total().alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return widened(raw.unpivot([], ["key", "total", "date"], "column_name", "value").withColumn("kind", text.csv_kind(F.col("value"), ("n/a",))))


def widened(kinds):
    """Histogram of value kinds by column and the type that holds them all."""
    counts = kinds.groupBy("column_name", "kind").agg(F.count("*").alias("n"))
    per = counts.groupBy("column_name").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ",").alias("kinds"), F.collect_set(F.when(~F.col("kind").isin("empty", "null_marker"), F.col("kind"))).alias("seen"))
    n, only = F.size("seen"), F.get(F.col("seen"), F.lit(0))
    both = lambda *names: F.size(F.array_except("seen", F.array(*map(F.lit, names)))) == 0
    return per.select("column_name", "kinds", F.when(n == 0, "unknown").when(n == 1, only).when(both("integer", "decimal"), "decimal").when(both("date", "datetime"), "datetime").otherwise("string").alias("inferred"))


@query("presence_ratio", "SELECT round(count(props) / count(*), 6) AS present, round(count(*) FILTER (value IS NULL) / count(*), 6) AS nulls FROM events")
def presence_ratio(load, spark):
    return load("events").agg(F.round(F.count("props") / F.count("*"), 6).alias("present"), F.round(F.count_if(F.col("value").isNull()) / F.count("*"), 6).alias("nulls"))


_LOG = ("user_id", "event_type", "ts", "event_id")


@query("directly_follows", "SELECT event_type AS activity, nxt AS next_activity, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY 1, 2")
def directly_follows(load, spark):
    return process.follows(load("events"), *_LOG)


@query("allowed_next_states", """WITH e AS (SELECT event_type AS activity, nxt, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY 1, 2)
SELECT activity, string_agg(nxt, ',' ORDER BY n DESC, nxt) AS next_states FROM e GROUP BY 1""")
def allowed_next_states(load, spark):
    return process.allowed_next(process.follows(load("events"), *_LOG))


@query("event_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END NULLS LAST, event_id) AS INTEGER) AS place FROM events")
def event_order(load, spark):
    stamped = load("events").withColumn("ts", F.when(F.col("event_id") % 9 != 0, F.col("ts")))
    return stamped.select("event_id", F.row_number().over(process.event_order("user_id", "ts", "event_id")).alias("place"))


_CASES = "SELECT user_id AS case_id, count(*) AS n_events, min(ts) AS started, max(ts) AS ended, list(event_type ORDER BY ts, event_id) AS acts FROM events GROUP BY 1"


@query("process_cases", f"SELECT case_id, n_events, started, ended, array_to_string(acts, '>') AS trace FROM ({_CASES})")
def process_cases(load, spark):
    return process.cases(load("events"), *_LOG).select("case_id", "n_events", "started", "ended", F.array_join("activities", ">").alias("trace"))


@query("case_duration", f"SELECT case_id, round(epoch_us(ended) / 1e6 - epoch_us(started) / 1e6, 3) AS duration_s, round((epoch_us(ended) - epoch_us(started)) / 86400e6, 6) AS days FROM ({_CASES})")
def case_duration(load, spark):
    c = process.cases(load("events"), *_LOG)
    return c.select("case_id", F.round("duration_s", 3).alias("duration_s"), F.round(F.col("duration_s") / 86400, 6).alias("days"))


@query("case_current_state", f"SELECT case_id, acts[1] AS first_activity, acts[-1] AS current_state FROM ({_CASES})")
def case_current_state(load, spark):
    return process.cases(load("events"), *_LOG).select("case_id", "first_activity", "current_state")


@query("unique_activities", "SELECT user_id AS case_id, string_agg(event_type, ',' ORDER BY f) AS seen FROM (SELECT user_id, event_type, min(ROW(ts, event_id)) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def unique_activities(load, spark):
    return process.cases(load("events"), *_LOG).select("case_id", F.array_join("unique_activities", ",").alias("seen"))


@query("start_end_activities", f"""WITH c AS ({_CASES}), n AS (SELECT 'start' AS side, acts[1] AS activity, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'end', acts[-1], count(*) FROM c GROUP BY 2)
SELECT *, CAST(row_number() OVER (PARTITION BY side ORDER BY n DESC, activity) AS INTEGER) AS rank FROM n""")
def start_end_activities(load, spark):
    c = process.cases(load("events"), *_LOG)
    sides = c.select(F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(v).alias("activity")) for s, v in (("start", "first_activity"), ("end", "current_state"))])))
    return process.ranked(sides.groupBy("side", "activity").agg(F.count("*").alias("n")), "activity", within="side")


@query("entity_references", "SELECT user_id AS case_id, arg_min(event_type, ROW(ts, event_id)) AS reference FROM events WHERE event_type <> 'view' GROUP BY 1")
def entity_references(load, spark):
    value = F.when(F.col("event_type") != "view", F.col("event_type"))
    return process.first_reference(load("events"), "user_id", "ts", "event_id", value).withColumnRenamed("user_id", "case_id")


@query("case_summary", f"SELECT case_id, 'Case ' || case_id || ' has ' || n_events || ' events; started with ' || acts[1] || '; now ' || acts[-1] AS summary FROM ({_CASES})")
def case_summary(load, spark):
    c = process.cases(load("events"), *_LOG)
    return c.select("case_id", F.concat(F.lit("Case "), "case_id", F.lit(" has "), "n_events", F.lit(" events; started with "), "first_activity", F.lit("; now "), "current_state").alias("summary"))


@query("affected_cases", "SELECT user_id AS case_id, count(*) AS n_changes FROM events WHERE event_type = 'error' OR event_id % 500 = 0 GROUP BY 1")
def affected_cases(load, spark):
    return load("events").where("event_type = 'error' or event_id % 500 = 0").groupBy(F.col("user_id").alias("case_id")).agg(F.count("*").alias("n_changes"))


@query("cascade_rebuild", f"SELECT case_id, n_events, acts[-1] AS current_state FROM ({_CASES}) WHERE case_id IN (SELECT user_id FROM events WHERE event_id % 500 = 0)")
def cascade_rebuild(load, spark):
    events = load("events")
    changed = events.where("event_id % 500 = 0").select("user_id").distinct()
    return process.cases(events.join(changed, "user_id", "left_semi"), *_LOG).select("case_id", "n_events", "current_state")


@query("normalize_events", "SELECT conv_id || '' AS case_id, role AS activity, 'dialogue' AS process_type, turn AS ordinal, length(text) AS size FROM conversations WHERE conv_id IS NOT NULL")
def normalize_events(load, spark):
    return load("conversations").where("conv_id is not null").select(F.col("conv_id").cast("string").alias("case_id"), F.col("role").alias("activity"), F.lit("dialogue").alias("process_type"), F.col("turn").alias("ordinal"), F.length("text").cast("bigint").alias("size"))


@query("fixed_chunks", "SELECT doc_id, CAST((s // 850) AS INTEGER) AS chunk_no, substr(text, s + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 850)) AS s FROM documents)")
def fixed_chunks(load, spark):
    return documents.fixed_chunks(load("documents"))


@query("chunk_documents")
def chunk_documents(load, spark):
    return documents.chunked(load("documents"))


@query("document_file_ids", "SELECT doc_id, 'file.' || sha256(text) AS file_id FROM documents")
def document_file_ids(load, spark):
    return load("documents").select("doc_id", F.concat(F.lit("file."), F.sha2("text", 256)).alias("file_id"))


_WORD = "(CASE WHEN regexp_matches(lower(b), '\\b{0}\\b') THEN 1 ELSE 0 END)"


def _class_sql(window="length(text) - 100 + 1"):
    ladder = []
    for kind, words, against, weight in documents.CLASSES:
        hits = " + ".join(_WORD.format(w) for w in words)
        veto = " + ".join(_WORD.format(w) for w in against) or "0"
        ladder.append(f"CASE WHEN ({veto}) > 0 THEN 0.0 ELSE ({hits}) * {weight} END")
    kinds = "[" + ",".join(f"'{c[0]}'" for c in documents.CLASSES) + "]"
    return f"""WITH d AS (SELECT item_id, substr(text || ' ' || ['invoice', 'policy invoice', 'contract terms', 'nothing'][1 + item_id % 4], {window}) AS b FROM benchmark), s AS (SELECT item_id, [{','.join(ladder)}]::DOUBLE[] AS v FROM d)
SELECT item_id, CASE WHEN list_max(v) > 0 THEN {kinds}[list_position(v, list_max(v))] ELSE 'unclassified_document' END AS kind, CASE WHEN list_sum(v) > 0 THEN round(list_max(v) / list_sum(v), 6) ELSE 0.0 END AS confidence FROM s"""


@query("classify_documents", _class_sql("1, 2000"))
def classify_documents(load, spark):
    return _classes(load, _marked_text())


def _marked_text():
    extra = F.get(F.array(F.lit("invoice"), F.lit("policy invoice"), F.lit("contract terms"), F.lit("nothing")), (F.col("item_id") % 4).cast("int"))
    return F.concat_ws(" ", "text", extra)


def _classes(load, body):
    found = documents.classified(F.lit(""), body)
    return load("benchmark").select("item_id", found["kind"].alias("kind"), found["confidence"].alias("confidence"))


@query("page_text_budget", "SELECT doc_id, source, CASE WHEN before >= 20000 THEN 0 ELSE least(n_chars, 20000 - before) END AS taken FROM (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents)")
def page_text_budget(load, spark):
    rows = prefix.sums_before(load("documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], {"before": F.col("n_chars")})
    return rows.select("doc_id", "source", F.greatest(F.lit(0), F.least(F.col("n_chars"), F.lit(20000) - F.col("before"))).alias("taken"))


@query("chunk_page_spans", "SELECT doc_id, CAST(s // 850 AS INTEGER) AS chunk_no, CAST(s // 2000 + 1 AS BIGINT) AS first_page, CAST((least(s + 1000, n) - 1) // 2000 + 1 AS BIGINT) AS last_page FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 850)) AS s FROM documents)")
def chunk_page_spans(load, spark):
    chunks = documents.fixed_chunks(load("documents"))
    start = F.col("chunk_no") * 850
    return chunks.select("doc_id", "chunk_no", (F.floor(start / 2000) + 1).alias("first_page"), (F.floor((start + F.length("chunk") - 1) / 2000) + 1).alias("last_page"))


@query("scan_snapshot_orders", "SELECT CAST(o_orderkey AS VARCHAR) AS record_key, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5000")
def scan_snapshot_orders(load, spark):
    return load("orders").orderBy("o_orderkey").limit(5000).select(F.concat_ws("|", F.col("o_orderkey").cast("string")).alias("record_key"), "o_custkey", "o_orderstatus")


@query("bounded_sample", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def bounded_sample(load, spark):
    return load("documents").orderBy("doc_id").limit(100).select("doc_id", "source")


@query("path_extract_outcome", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'FOUND' WHEN event_id % 3 = 1 THEN 'NULL' ELSE 'MISSING' END AS outcome, CASE WHEN event_id % 3 = 0 THEN event_type END AS value FROM events")
def path_extract_outcome(load, spark):
    k = F.col("event_id") % 3
    doc = F.when(k == 0, F.to_json(F.struct(F.struct(F.col("event_type").alias("b")).alias("a")))).when(k == 1, '{"a":{"b":null}}').otherwise('{"a":{}}')
    inner = F.get_json_object(doc, "$.a")
    value = F.get_json_object(inner, "$.b")
    present = F.coalesce(F.array_contains(F.json_object_keys(inner), "b"), F.lit(False))
    return load("events").select("event_id", F.when(~present, "MISSING").when(value.isNull(), "NULL").otherwise("FOUND").alias("outcome"), value.alias("value"))


@query("filter_attribute_map", "SELECT c_custkey, 'segment=' || c_mktsegment || CASE WHEN c_acctbal >= 0 THEN ';credit=true' ELSE ';credit=false' END AS attributes FROM customer")
def filter_attribute_map(load, spark):
    raw = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("credit"), (F.col("c_acctbal") >= 0).cast("string"), F.lit("note"), F.lit(None).cast("string"), F.lit("password"), F.lit("x"))
    kept = F.map_filter(raw, lambda k, v: v.isNotNull() & ~k.isin("password"))
    return load("customer").select("c_custkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attributes"))


@query("scrub_metadata", "SELECT c_custkey, 'name=' || c_name AS kept FROM customer")
def scrub_metadata(load, spark):
    raw = F.create_map(F.lit("name"), F.col("c_name"), F.lit("db_password"), F.lit("x"), F.lit("api_token"), F.lit("y"))
    kept = F.map_filter(raw, lambda k, v: ~k.rlike("(?i)password|secret|token|api_?key|credential"))
    return load("customer").select("c_custkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("kept"))
