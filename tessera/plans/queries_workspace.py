"""Queries of the workspace of reviewed documents: orders as commits of their customers' attachments, and sealed entries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import archive, workspace
from tessera.operators.staging import shared_dir
from tessera.plans.registry import query

_TYPES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]  # fixed: what the schemas declare; machinery is none of them

_COMMITS = """
WITH RECURSIVE ask AS (
  SELECT o_orderkey AS r, o_custkey AS up, o_orderstatus || '|' || o_orderpriority AS fp, o_orderstatus <> 'P' AS confirmed, o_orderpriority IN ('1-URGENT', '2-HIGH') AS ack,
    CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END AS expected, c_nationkey AS sch, CASE WHEN o_totalprice < 20000 THEN -1 ELSE n_regionkey END AS sch_rev, n_regionkey AS sch_now,
    c_mktsegment AS typ, o_orderstatus = 'F' AS ver, o_orderpriority <> '3-MEDIUM' AS form, c_acctbal < 0 AS pending
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
lines AS (SELECT l_orderkey AS r, count(*) AS n, count(DISTINCT l_partkey) AS u FROM lineitem GROUP BY 1),
firsts AS (SELECT up, arg_min(fp, r) AS fp FROM ask GROUP BY 1),
ups AS (SELECT doc_id AS up, coalesce(length(text), 0) AS size, source = 'src1' AS ready, f.fp AS ready_fp FROM documents LEFT JOIN firsts f ON f.up = doc_id),
gated AS MATERIALIZED (
  SELECT a.*, CASE WHEN NOT confirmed THEN 'REVIEW_REQUIRED' WHEN p.up IS NULL THEN 'NOT_FOUND' WHEN size = 0 THEN 'EXTRACTION_NOT_COMPLETE'
    WHEN ready AND ready_fp = a.fp THEN 'RECEIPT' WHEN ready THEN 'COMMIT_KEY_CONFLICT' WHEN expected <> 1 THEN 'LIBRARY_REVISION_CONFLICT' WHEN size > 5000 AND NOT ack THEN 'EXTRACTION_REVIEW_REQUIRED'
    WHEN sch_rev <> sch_now THEN 'SCHEMA_REVISION_CONFLICT' WHEN typ = 'MACHINERY' THEN 'DOCUMENT_TYPE_INVALID' WHEN ver AND (pending OR NOT form) THEN 'DOCUMENT_REVISION_CONFLICT'
    WHEN form AND coalesce(n, 0) NOT BETWEEN 1 AND 50 THEN 'FORM_INVALID' WHEN form AND u < n THEN 'DUPLICATE_MEMBER_KEY' END AS refused
  FROM ask a LEFT JOIN ups p USING (up) LEFT JOIN lines USING (r)),
wanted AS (SELECT r, 'member:' || sch || ':' || l_partkey AS k, CASE WHEN ver THEN up END AS own FROM gated JOIN lineitem ON l_orderkey = r WHERE refused IS NULL AND form),
kept AS (SELECT 'member:' || sch || ':' || l_partkey AS k, up AS holder FROM ask JOIN lineitem ON l_orderkey = r WHERE l_shipdate < DATE '1995-06-01'),
foreign_ AS (SELECT w.r, min(k) AS k FROM wanted w JOIN kept USING (k) WHERE own IS DISTINCT FROM holder GROUP BY 1),
left_ AS (SELECT * FROM gated WHERE refused IS NULL AND r NOT IN (SELECT r FROM foreign_)),
claims AS MATERIALIZED (
  SELECT r, 'attachment:' || up AS k FROM left_ UNION SELECT r, 'document:' || up FROM left_ WHERE ver UNION SELECT r, k FROM wanted WHERE r IN (SELECT r FROM left_)),
st AS (
  SELECT 0 AS i, r, '?' AS s FROM left_
  UNION ALL
  SELECT i + 1, r, CASE WHEN s <> '?' THEN s WHEN max(taken) = 1 THEN 'n' WHEN min(ahead) = 1 THEN 'y' ELSE '?' END
  FROM (SELECT st.i, st.r, st.s, max(CASE WHEN st.s = 'y' THEN 1 ELSE 0 END) OVER (PARTITION BY c.k) AS taken,
      CASE WHEN st.r = min(CASE WHEN st.s = '?' THEN st.r END) OVER (PARTITION BY c.k) THEN 1 ELSE 0 END AS ahead, sum(CASE WHEN st.s = '?' THEN 1 ELSE 0 END) OVER () AS waiting
    FROM st JOIN claims c USING (r))
  WHERE waiting > 0 GROUP BY i, r, s),
fate AS (SELECT r, s FROM st WHERE i = (SELECT max(i) FROM st)),
granted AS (SELECT k, r AS holder FROM claims JOIN fate USING (r) WHERE s = 'y'),
lost AS (SELECT c.r, min(k) AS k, arg_min(holder, k) AS holder FROM claims c JOIN granted USING (k) WHERE holder < c.r GROUP BY 1)
SELECT g.r AS request_id, CASE WHEN g.refused IS NOT NULL THEN g.refused WHEN f.k IS NOT NULL THEN 'MEMBER_ALREADY_EXISTS' WHEN l.k IS NULL THEN 'COMMITTED'
  WHEN l.k LIKE 'member:%' THEN 'MEMBER_ALREADY_EXISTS' WHEN l.k LIKE 'document:%' THEN 'DOCUMENT_REVISION_CONFLICT' WHEN t.fp = g.fp THEN 'RECEIPT' ELSE 'COMMIT_KEY_CONFLICT' END AS outcome, coalesce(f.k, l.k) AS lost
FROM gated g LEFT JOIN foreign_ f USING (r) LEFT JOIN lost l USING (r) LEFT JOIN gated t ON t.r = l.holder
"""


@query("workspace_commits", _COMMITS)
def workspace_commits(load, spark):
    """Every order confirms its customer's attachment; its lines are the members that it creates or renews."""
    asked = load("orders").join(load("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(load("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows at any scale
    form, version = F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderstatus") == "F"
    requests = asked.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("upload_id"), F.col("o_custkey").alias("actor"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("fingerprint"),
        (F.col("o_orderstatus") != "P").alias("review_confirmed"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("acknowledged"), F.when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(1).alias("expected_revision"),
        F.col("c_nationkey").alias("schema_id"), F.when(F.col("o_totalprice") < 20000, -1).otherwise(F.col("n_regionkey")).alias("schema_revision"), F.col("c_mktsegment").alias("document_type"),
        F.when(version, "version").otherwise("new").alias("mode"), F.when(version, F.col("o_custkey")).alias("document_id"), F.lit(1).alias("document_revision"),
        F.when(~form, F.col("c_name")).alias("target"), form.alias("brings_form"),
    )
    first = requests.groupBy("upload_id").agg(F.min_by("fingerprint", "request_id").alias("first"))
    size, ready = F.coalesce(F.length("text"), F.lit(0)), F.coalesce(F.col("source") == "src1", F.lit(False))
    uploads = load("documents").select(F.col("doc_id").alias("upload_id"), size.alias("size"), ready.alias("ready")).join(first, "upload_id", "left").select(
        "upload_id", F.col("upload_id").alias("owner"), F.when(F.col("size") == 0, "EXTRACTION_FAILED").when(F.col("ready"), "READY").otherwise("REVIEW").alias("status"), F.lit(1).alias("revision"),
        (F.col("size") > 5000).cast("int").alias("warnings"), F.when(F.col("ready"), F.col("first")).alias("fingerprint"),
    )
    schemas = load("nation").select(F.col("n_nationkey").alias("schema_id"), F.col("n_regionkey").alias("revision"), F.lit(_TYPES).alias("document_types"))
    documents = load("customer").select(
        F.col("c_custkey").alias("document_id"), F.col("c_custkey").alias("owner"), F.lit(1).alias("revision"), F.when(F.col("c_acctbal") < 0, F.col("c_custkey")).alias("pending"),
        F.col("c_nationkey").alias("schema_id"), F.col("c_mktsegment").alias("document_type"), F.lit(None).cast("string").alias("target"),
    )
    lines = load("lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").cast("string").alias("key"), "l_shipdate")
    records = lines.where("l_shipdate < DATE '1995-06-01'").join(requests, "request_id").select("schema_id", "key", F.col("upload_id").alias("document_id"))
    return workspace.committed(requests, lines.drop("l_shipdate"), uploads, schemas, documents, records)


@query("workspace_entries", """
SELECT lang AS workspace, doc_id::VARCHAR AS entry_id, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS revision, sha256(CASE WHEN quality = 1 THEN 'reviewed ' || source ELSE text END) AS payload_sha256, false AS refused
FROM documents LEFT JOIN labels USING (doc_id)""")  # fmt: skip
def workspace_entries(load, spark):
    """Texts kept sealed; reviews of good ones name the revision that is stored, those of the others an older one."""
    docs = load("documents").select(F.col("lang").alias("workspace"), F.col("doc_id").cast("string").alias("entry_id"), F.lit("upload").alias("kind"), F.col("source").alias("owner"), F.col("text").alias("payload"), "doc_id", "source")
    store = workspace.SealedEntries(spark, f"{shared_dir(spark)}/entries-{uuid.uuid4().hex}", secret=archive.passing_key(spark))  # a table of this query alone
    store.create(docs.drop("doc_id", "source"))
    reviews = docs.join(load("labels").select("doc_id", "quality"), "doc_id").withColumns({"payload": F.concat(F.lit("reviewed "), F.col("source")), "expected": F.col("quality").cast("int")})
    store.put(reviews.select("workspace", "entry_id", "kind", "owner", "payload", "expected"))
    return store.read().select("workspace", "entry_id", "revision", F.sha2("payload", 256).alias("payload_sha256"), "refused")
