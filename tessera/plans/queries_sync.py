"""Queries of synchronisation, lifecycle, verification, response adaptation, sources and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import ident
from tessera.operators import adapt, archive, fingerprint, sync
from tessera.plans.registry import query
from tessera.sources import files, payloads
from tessera.streaming import changes



def _after_event(load, tie):
    """Events after the one with id 500; none where there is no such event."""
    at = load("events").where("event_id = 500").select("ts").first()
    return sync.after(load("events"), "ts", "event_id", str(at["ts"]), tie) if at else load("events").where("false")


@query("incremental_timestamp", "SELECT event_id FROM events WHERE ts > (SELECT ts FROM events WHERE event_id = 500)")
def incremental_timestamp(load, spark):
    return _after_event(load, None).select("event_id")


@query("incremental_composite", "SELECT event_id FROM events WHERE ts > (SELECT ts FROM events WHERE event_id = 500) OR (ts = (SELECT ts FROM events WHERE event_id = 500) AND event_id > 500)")
def incremental_composite(load, spark):
    return _after_event(load, 500).select("event_id")


@query("incremental_monotonic", "SELECT event_id FROM events WHERE event_id > 500")
def incremental_monotonic(load, spark):
    return load("events").where("event_id > 500").select("event_id")


@query("incremental_batch", "SELECT event_id FROM events WHERE event_id > 100 ORDER BY ts, event_id LIMIT 200")
def incremental_batch(load, spark):
    return sync.batch(load("events").where("event_id > 100"), "ts", "event_id", 200).select("event_id")


@query("change_operations", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op FROM events")
def change_operations(load, spark):
    return load("events").select("event_id", sync.operation(F.col("event_type") == "error", first=False).alias("op"))


@query("change_idempotency", "SELECT event_id, 'chg.' || substr(sha256('shop|event|' || event_id || '|' || event_type), 1, 16) AS change_id FROM events")
def change_idempotency(load, spark):
    made = F.concat(F.lit("chg."), F.substring(F.sha2(F.concat_ws("|", F.lit("shop"), F.lit("event"), F.col("event_id").cast("string"), "event_type"), 256), 1, 16))
    return load("events").select("event_id", made.alias("change_id")).dropDuplicates(["change_id"])


# the second version lacks every fiftieth document, and every seventy-seventh has another text
@query("content_hash_changes", "SELECT source, doc_id, CASE WHEN doc_id % 50 = 0 THEN 'delete' ELSE 'update' END AS operation FROM documents WHERE doc_id % 50 = 0 OR (doc_id % 77 = 0 AND text IS NOT NULL)")
def content_hash_changes(load, spark):
    old = load("documents").select("source", "doc_id", "text")
    new = old.where("doc_id % 50 <> 0").withColumn("text", F.when(F.col("doc_id") % 77 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return fingerprint.changes(old, new, "source", "doc_id", F.sha2("text", 256))


@query("watermark_advance", "SELECT user_id, max(ts) AS ts, arg_max(event_id, ROW(ts, event_id)) AS tie FROM events GROUP BY 1")
def watermark_advance(load, spark):
    top = load("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("w"))
    return top.select("user_id", "w.ts", F.col("w.event_id").alias("tie"))


_CHANGE = "(SELECT user_id, event_id, event_id % 37 = 0 AS failed, min(CASE WHEN event_id % 37 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS f FROM events)"


@query("safe_checkpoint", f"SELECT user_id, count(*) FILTER (NOT failed) AS applied, max(event_id) FILTER (f IS NULL OR event_id < f) AS checkpoint FROM {_CHANGE} GROUP BY 1")
def safe_checkpoint(load, spark):
    return sync.checkpoints(load("events"), "user_id", "event_id", F.col("event_id") % 37 == 0, "QUARANTINE")


@query("sync_apply_changes", f"SELECT user_id, count(*) FILTER (f IS NULL OR event_id < f) AS applied, max(event_id) FILTER (f IS NULL OR event_id < f) AS checkpoint FROM {_CHANGE} GROUP BY 1")
def sync_apply_changes(load, spark):
    return sync.checkpoints(load("events"), "user_id", "event_id", F.col("event_id") % 37 == 0, "BLOCK")


@query("sync_run_summary", "SELECT count(*) AS n_read, count(*) FILTER (event_id % 37 <> 0) AS processed, count(*) FILTER (event_id % 37 = 0) AS failed, count(DISTINCT user_id) AS keys FROM events")
def sync_run_summary(load, spark):
    bad = F.col("event_id") % 37 == 0
    return load("events").agg(F.count("*").alias("n_read"), F.count_if(~bad).alias("processed"), F.count_if(bad).alias("failed"), F.countDistinct("user_id").alias("keys"))


@query("canonical_upsert_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS version FROM orders")
def canonical_upsert_merge(load, spark):
    current = load("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    incoming = load("orders").where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("status"), F.lit(2).alias("version"))
    return sync.merged(current, incoming, "o_orderkey", "version")


@query("representation_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def representation_lookup(load, spark):
    ids = load("lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return load("orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("hash_skip", "SELECT doc_id, doc_id % 4 = 0 AS reembed FROM documents")
def hash_skip(load, spark):
    docs = load("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    ledger = load("documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.sha2("text", 256)).otherwise("old").alias("was"))
    return docs.join(ledger, "doc_id", "left").select("doc_id", (~F.col("h").eqNullSafe(F.col("was"))).alias("reembed"))


# texts of an hour's run: emptied ones, ones that the ledger holds under the same hash, and the rest
_STATUS = "CASE WHEN trim(coalesce(content, '')) = '' THEN 'EMPTY_CONTENT' WHEN sha256(content) = was THEN 'SKIPPED_UNCHANGED' ELSE 'GENERATED' END"
_CONTENT = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE text END AS content, CASE WHEN doc_id % 4 = 0 THEN sha256(text) WHEN doc_id % 4 = 1 THEN sha256(text || '!') END AS was FROM documents)"


@query("embedding_status", f"SELECT doc_id, {_STATUS} AS status FROM {_CONTENT}")
def embedding_status(load, spark):
    k, text = F.col("doc_id"), F.col("text")
    was = F.when(k % 4 == 0, F.sha2(text, 256)).when(k % 4 == 1, F.sha2(F.concat(text, F.lit("!")), 256))
    return sync.embedding_status(load("documents").select("doc_id", F.when(k % 5 == 0, "  ").otherwise(text).alias("content"), was.alias("was")), "content", "was").select("doc_id", "status")


@query("embedding_run_summary", f"SELECT {_STATUS} AS status, count(*) AS n FROM {_CONTENT} GROUP BY 1")
def embedding_run_summary(load, spark):
    return embedding_status(load, spark).groupBy("status").agg(F.count("*").alias("n"))


@query("lifecycle_replace", "SELECT source, doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unchanged' WHEN doc_id % 4 = 2 THEN 'superseded' ELSE 'promoted' END AS outcome FROM documents d WHERE doc_id % 4 IN (0, 1) OR (doc_id % 4 = 2 AND EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND e.doc_id % 4 IN (0, 1)))")
def lifecycle_replace(load, spark):
    docs = load("documents").select("source", "doc_id")
    out = sync.replaced(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 4 in (0, 1)"), "source", "doc_id")
    return out


@query("lifecycle_retire", "SELECT doc_id, 'superseded' AS state, true AS cleanup_pending FROM documents WHERE source = 'src1'")
def lifecycle_retire(load, spark):
    return sync.retired(load("documents").where("source = 'src1'"), "doc_id")


@query("slot_keys", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'record:' || doc_id WHEN 1 THEN 'attachment:' || source || '|' || lang END AS slot FROM documents")
def slot_keys(load, spark):
    k = F.col("doc_id") % 3
    return load("documents").select("doc_id", F.when(k == 0, F.concat(F.lit("record:"), F.col("doc_id").cast("string"))).when(k == 1, F.concat(F.lit("attachment:"), "source", F.lit("|"), "lang")).alias("slot"))


_RANGES = "(SELECT source, substr(sha256(m), 1, 3) AS range, sha256(string_agg(m, '|' ORDER BY m)) AS digest, count(*) AS n FROM (SELECT DISTINCT source, lpad(doc_id || '', 12, '0') AS m FROM documents) GROUP BY 1, 2)"


@query("slot_generation", f"SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(range || ':' || digest, '|' ORDER BY range)) AS generation FROM {_RANGES} GROUP BY 1")
def slot_generation(load, spark):
    member = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    return fingerprint.of_sets(fingerprint.ranges(load("documents"), "source", member), "source").withColumnRenamed("fingerprint", "generation")


@query("idempotency_conflicts", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS fingerprints FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def idempotency_conflicts(load, spark):
    return load("orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("fingerprints")).where("fingerprints > 1")


@query("scheduler_decisions", "SELECT user_id, least(60 * pow(2, least(f, 5)), 32 * 60)::BIGINT AS wait_s FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY 1)")
def scheduler_decisions(load, spark):
    f = load("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("f"))
    return f.select("user_id", F.least(60 * F.pow(F.lit(2), F.least("f", F.lit(5))), F.lit(32 * 60)).cast("bigint").alias("wait_s"))


# -- verification ----------------------------------------------------------------------------------------------
@query("identity_issues", "SELECT o_orderkey, 'SURROGATE_KEY' AS code FROM orders UNION ALL SELECT o_orderkey, 'MALFORMED_ID' FROM orders WHERE o_orderkey % 10 = 0")
def identity_issues(load, spark):
    made = F.when(F.col("o_orderkey") % 10 == 0, "rec:shop::x").otherwise(ident.canonical_id(F.lit("shop"), F.lit("order"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))))
    codes = F.array(F.when(ident.is_surrogate(F.col("o_orderkey")), "SURROGATE_KEY"), F.when(ident.parsed_id(made).isNull(), "MALFORMED_ID"))
    return load("orders").select("o_orderkey", F.explode(F.array_compact(codes)).alias("code"))


# every ninth vector lies under the id of the one before it: its id is taken, and it has none of its own
@query("vector_identity", "SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 'WRONG_ID' WHEN vec_id % 9 = 8 AND EXISTS (SELECT 1 FROM embeddings n WHERE n.vec_id = e.vec_id + 1) THEN 'ID_TAKEN' END AS issue FROM embeddings e WHERE issue IS NOT NULL")
def vector_identity(load, spark):
    owner = F.col("vec_id") - F.when(F.col("vec_id") % 9 == 0, 1).otherwise(0)
    stored = load("embeddings").select("vec_id", ident.uuid5(F.concat(F.lit("engine/"), owner.cast("string"))).alias("stored"))
    return sync.identity_issues(stored, "vec_id", "stored", ident.uuid5(F.concat(F.lit("engine/"), F.col("vec_id").cast("string"))))


@query("orphan_vectors", "SELECT vec_id FROM embeddings WHERE vec_id % 3 = 1")
def orphan_vectors(load, spark):
    return load("embeddings").select("vec_id").join(load("embeddings").where("vec_id % 3 <> 1").select("vec_id"), "vec_id", "left_anti")


@query("metadata_agreement", "SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN 'model,dimension' WHEN vec_id % 2 = 0 THEN 'model' ELSE 'dimension' END AS differs FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def metadata_agreement(load, spark):
    e = load("embeddings").select("vec_id", F.lit("m1").alias("model"), F.lit(64).alias("dimension"))
    state = load("embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, "m0").otherwise("m1").alias("s_model"), F.when(F.col("vec_id") % 3 == 0, 32).otherwise(64).alias("s_dimension"))
    wrong = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"s_{c}")), c) for c in ("model", "dimension")]))
    return e.join(state, "vec_id").select("vec_id", F.array_join(wrong, ",").alias("differs")).where("differs <> ''")


@query("representation_integrity", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'STALE_HASH' ELSE 'MISSING_RECORD' END AS code FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def representation_integrity(load, spark):
    h = F.sha2("text", 256)
    kept = load("documents").select("doc_id", h.alias("now"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(h).alias("stored"))
    known = load("documents").where("doc_id % 11 <> 0").select("doc_id", F.lit(True).alias("known"))
    code = F.when(F.col("now") != F.col("stored"), "STALE_HASH").when(F.col("known").isNull(), "MISSING_RECORD")
    return kept.join(known, "doc_id", "left").select("doc_id", code.alias("code")).where("code is not null")


@query("embedding_integrity", "SELECT vec_id, CASE WHEN vec_id % 8 = 0 THEN 'WRONG_DIMENSION' ELSE 'WRONG_MODEL' END AS code FROM embeddings WHERE vec_id % 8 = 0 OR vec_id % 12 = 1")
def embedding_integrity(load, spark):
    dim = F.when(F.col("vec_id") % 8 == 0, 32).otherwise(F.size("embedding"))
    model = F.when(F.col("vec_id") % 12 == 1, "other").otherwise("m1")
    return load("embeddings").select("vec_id", F.when(dim != 64, "WRONG_DIMENSION").when(model != "m1", "WRONG_MODEL").alias("code")).where("code is not null")


@query("tier_state_integrity", "SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN vec_id % 5 = 0 THEN 'VECTOR_MISSING' END, CASE WHEN vec_id % 7 = 0 THEN 'RECORD_MISSING' END], lambda x: x IS NOT NULL)) AS code FROM embeddings) GROUP BY 1")
def tier_state_integrity(load, spark):
    state = load("embeddings").select("vec_id")
    vectors = load("embeddings").where("vec_id % 5 <> 0").select("vec_id", F.lit(True).alias("v"))
    records = load("embeddings").where("vec_id % 7 <> 0").select("vec_id", F.lit(True).alias("r"))
    codes = F.array_compact(F.array(F.when(F.col("v").isNull(), "VECTOR_MISSING"), F.when(F.col("r").isNull(), "RECORD_MISSING")))
    return state.join(vectors, "vec_id", "left").join(records, "vec_id", "left").select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("verification_rollup", "SELECT 'failure' AS severity, (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0) AS n UNION ALL SELECT 'warning', (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0)")
def verification_rollup(load, spark):
    counts = tier_state_integrity(load, spark)
    severity = spark.createDataFrame([("VECTOR_MISSING", "failure"), ("RECORD_MISSING", "warning")], "code string, severity string")
    return counts.join(F.broadcast(severity), "code").groupBy("severity").agg(F.sum("n").alias("n"))


@query("pair_records", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def pair_records(load, spark):
    return load("orders").join(load("lineitem").where("l_linenumber = 1"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@query("character_budget", "SELECT event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) <= 200 AS kept FROM events")
def character_budget(load, spark):
    fields = load("events").select("user_id", "event_id", "props", F.col("value").alias("score"), F.col("event_id").alias("field"))
    return adapt.within_budget(fields, "user_id", F.length("props"), 200).select("event_id", "kept")


@query("limit_decisions", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 10")
def limit_decisions(load, spark):
    at = W.partitionBy("user_id").orderBy(F.when(F.col("event_type") == "error", 0).otherwise(1), "event_id")
    return load("events").select("event_id", F.row_number().over(at).alias("place")).where("place <= 10")


# -- sources ---------------------------------------------------------------------------------------------------
_ODD_URL = "CASE page_id % 5 WHEN 0 THEN 'ftp://files.example.com/x' WHEN 1 THEN 'http://u:p@example.com/a?k=1#f' WHEN 2 THEN 'http://127.0.0.1/admin' WHEN 3 THEN 'https://example.com:8443/x' ELSE 'https://example.com/p/' || page_id || '?q=1' END"


def _odd_url():
    k, page = F.col("page_id") % 5, F.col("page_id").cast("string")
    return F.when(k == 0, "ftp://files.example.com/x").when(k == 1, "http://u:p@example.com/a?k=1#f").when(k == 2, "http://127.0.0.1/admin").when(k == 3, "https://example.com:8443/x").otherwise(F.concat(F.lit("https://example.com/p/"), page, F.lit("?q=1")))


@query("url_policy_verdict", "SELECT page_id, ['SCHEME', 'CREDENTIALS', 'PRIVATE_HOST', 'PORT', 'ALLOWED'][1 + page_id % 5] AS verdict FROM pages")
def url_policy_verdict(load, spark):
    return load("pages").select("page_id", files.url_verdict(_odd_url()).alias("verdict"))


@query("url_redaction", "SELECT page_id, ['ftp://files.example.com/x', 'http://example.com/a', 'http://127.0.0.1/admin', 'https://example.com/x', 'https://example.com/p/' || page_id][1 + page_id % 5] AS url FROM pages")
def url_redaction(load, spark):
    return load("pages").select("page_id", files.url_redacted(_odd_url()).alias("url"))


@query("entity_from_url", "SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]') AND x NOT IN ('api'))[-1] AS entity FROM pages")
def entity_from_url(load, spark):
    parts = F.filter(F.split(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "/"), lambda x: (x != "") & ~x.rlike("[0-9]") & ~x.isin("api"))
    return load("pages").select("page_id", F.try_element_at(parts, F.lit(-1)).alias("entity"))


@query("page_payload_kind", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'json' WHEN page_id % 4 = 1 THEN 'empty' WHEN page_id % 4 = 2 THEN 'text' WHEN regexp_matches(lower(trim(html)), '^<(!doctype html|html)') THEN 'html' WHEN trim(html) LIKE '<%' THEN 'xml' ELSE 'text' END AS kind FROM pages")
def page_payload_kind(load, spark):
    k = F.col("page_id") % 4
    body = F.when(k == 0, '{"a": [1, 2]}').when(k == 1, "  ").when(k == 2, "plain words").otherwise(F.col("html"))
    return load("pages").select("page_id", files.payload_kind(body).alias("kind"))


@query("identity_declaration_checks", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'TOO_LONG' WHEN c_custkey % 4 = 1 THEN 'LOOKS_LIKE_SECRET' WHEN c_custkey % 4 = 2 THEN 'HALF_KEY' END AS issue FROM customer")
def identity_declaration_checks(load, spark):
    k = F.col("c_custkey") % 4
    value = F.when(k == 0, F.repeat(F.lit("x"), 201)).when(k == 1, "password=abc").when(k == 3, F.col("c_name"))
    issue = F.when(F.length(value) > 200, "TOO_LONG").when(value.rlike("(?i)password|secret|token|api_?key"), "LOOKS_LIKE_SECRET").when(value.isNull(), "HALF_KEY")
    return load("customer").select("c_custkey", issue.alias("issue"))


# pages as bytes: in UTF-16 after its mark, in UTF-8 after its mark or without one, cut inside a character, under the
# signature of another format, larger than is read, or not there
_ASSET_CAP = 3000
_ASSET = f"(SELECT page_id, html, CASE WHEN html IS NULL OR html = '' OR page_id % 7 = 5 THEN 'empty' WHEN CASE page_id % 7 WHEN 0 THEN 2 + 2 * length(html) WHEN 1 THEN 3 + strlen(html) WHEN 2 THEN 9 + strlen(html) WHEN 3 THEN 1 + strlen(html) ELSE strlen(html) END > {_ASSET_CAP} THEN 'too_large' WHEN page_id % 7 = 2 THEN 'unsupported_binary' WHEN page_id % 7 = 3 THEN 'unreadable' ELSE 'extracted' END AS outcome FROM pages)"


def _assets(load):
    k, html = F.col("page_id") % 7, F.col("html")
    utf8 = F.encode(html, "UTF-8")
    content = (
        F.when(k == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE"))).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(k == 2, F.concat(F.encode(F.lit("%PDF-1.7\n"), "UTF-8"), utf8))
        .when(k == 3, F.concat(utf8, F.unhex(F.lit("C3")))).when(k != 5, utf8)
    )
    rows = load("pages").select("page_id", "url", F.when(html != "", content).alias("body"))
    return rows, payloads.scanned(rows, "page_id", ["body"], _ASSET_CAP)


@query("asset_outcomes", f"SELECT outcome, count(*) AS n, CAST(coalesce(sum(length(html)) FILTER (outcome = 'extracted'), 0) AS BIGINT) AS characters FROM {_ASSET} GROUP BY 1")
def asset_outcomes(load, spark):
    return _assets(load)[1].groupBy("outcome").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))


# the same bytes under two addresses of a host are one attachment there
@query("attachment_representations", """WITH a AS (SELECT page_id % 10 AS scope, sha256(h) AS document_id, page_id, h FROM (SELECT page_id, substr(html, 1, 60) AS h FROM pages) WHERE h <> '')
SELECT 'att.' || substr(sha256(scope || '|' || document_id), 1, 20) AS attachment_id, scope, document_id, count(DISTINCT page_id) AS owners, min(page_id) AS first_owner, min(h) AS text FROM a GROUP BY scope, document_id""")
def attachment_representations(load, spark):
    rows = load("pages").select("page_id", F.encode(F.substring("html", 1, 60), "UTF-8").alias("head"))
    return payloads.attachments(payloads.scanned(rows, "page_id", ["head"]).withColumn("scope", F.col("page_id") % 10), "scope", "page_id")

@query("form_duplicates", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) > 1")
def form_duplicates(load, spark):
    docs = load("documents").select("doc_id", "source", "lang")
    first = docs.groupBy(F.col("source").alias("s"), F.col("lang").alias("l")).agg(F.min("doc_id").alias("first"))
    later = docs.join(first, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")))
    return later.where("doc_id > first").select("doc_id", "source")


@query("library_inventory", "SELECT lang, count(*) AS documents, count(*) FILTER (n_chars > 1000) AS searchable FROM documents GROUP BY 1")
def library_inventory(load, spark):
    return load("documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") > 1000).alias("searchable"))


@query("representations_orders", "SELECT o_orderkey, 'ai:order:' || o_orderkey AS representation_id, sha256('Entity: Order' || chr(10) || 'Order Status: ' || o_orderstatus) AS content_hash FROM orders")
def representations_orders(load, spark):
    from tessera.operators.documents import rendered

    text = rendered("Order", None, {"order_status": F.col("o_orderstatus")})
    return load("orders").select("o_orderkey", F.concat(F.lit("ai:order:"), F.col("o_orderkey").cast("string")).alias("representation_id"), F.sha2(text, 256).alias("content_hash"))


@query("bench_corpus", "SELECT o_orderkey AS record, 'Order ' || lpad(o_orderkey || '', 8, '0') || ' of customer ' || o_custkey || ' is ' || CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'pending' END AS text FROM orders")
def bench_corpus(load, spark):
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "filled").otherwise("pending")
    said = F.concat(F.lit("Order "), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(" of customer "), F.col("o_custkey").cast("string"), F.lit(" is "), state)
    return load("orders").select(F.col("o_orderkey").alias("record"), said.alias("text"))


# -- event-time windows: beyond what the cursors offer ----------------------------------------------------------
@query("ext_tumbling_events", 'SELECT date_trunc(\'day\', ts) AS start, date_trunc(\'day\', ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3')
def ext_tumbling_events(load, spark):
    rows = changes.tumbling(load("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("ext_session_events", """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, sid""")
def ext_session_events(load, spark):
    rows = changes.sessions(load("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


# -- results beyond SQL: rows only -----------------------------------------------------------------------------
@query("sensitive_text_roundtrip", "SELECT c_custkey, true AS restored FROM customer")
def sensitive_text_roundtrip(load, spark):
    key = archive.passing_key(spark)
    sealed = F.aes_encrypt(F.col("c_name"), key, F.lit("GCM"))
    return load("customer").select("c_custkey", (F.aes_decrypt(sealed, key, F.lit("GCM")).cast("string") == F.col("c_name")).alias("restored"))


@query("scan_documents_snapshot", "SELECT CAST(doc_id AS VARCHAR) AS source_object_id, lang, source FROM documents ORDER BY doc_id LIMIT 5000")
def scan_documents_snapshot(load, spark):
    return load("documents").orderBy("doc_id").limit(5000).select(F.col("doc_id").cast("string").alias("source_object_id"), "lang", "source")


@query("cast_structural", "SELECT event_id, json_type(props) = 'OBJECT' AS is_object FROM events")
def cast_structural(load, spark):
    return load("events").select("event_id", F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT").alias("is_object"))


@query("unwrap_envelope", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS body FROM events""")
def unwrap_envelope(load, spark):
    wrapped = F.to_json(F.struct(F.lit("ok").alias("status"), F.struct(F.col("event_id"), F.col("event_type")).alias("data")))
    return load("events").select("event_id", F.when(F.array_contains(F.json_object_keys(wrapped), "data"), F.get_json_object(wrapped, "$.data")).otherwise(wrapped).alias("body"))
