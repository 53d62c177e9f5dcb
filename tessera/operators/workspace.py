"""A workspace of documents under review: gates of a commit, claims on keys in order, and entries kept sealed.

A batch of commits is judged as if its requests came one after the other, in the
order of their ids. What a request alone and the stored state decide is one
ladder of gates; what depends on earlier requests of the same batch is claims:
a request takes all the keys it names (its upload, its document, its members) or
none, and takes them only where no stored member and no earlier request that got
through holds one.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tessera.operators import archive
from tessera.operators.staging import shared_dir, staged
from tessera.sources.versioned import Snapshot, VersionedTable

MOST_ROWS = 50  # of a reviewed form


def settled(claims: DataFrame, held: DataFrame) -> DataFrame:
    """(claimant, granted, lost, holder) of claims (claimant, key) in the order of claimants; ``held`` has the keys taken before.

    ``lost`` is the smallest key of a refused claimant that was taken when its turn came, by ``holder`` (null: it was held
    before). A round grants every claimant
    that is first on all its keys and refuses whoever wants one of these, so a key that all want takes one round; rounds
    are as many as the longest chain of claimants that wait for each other, and only the undecided are read again.
    Rows without a claimant or key claim nothing; repeated claims are one.
    """
    spark = claims.sparkSession
    asked = staged(claims.select("claimant", "key").dropna().distinct(), "claims")
    before = held.select("key").dropna().distinct()
    blocked = asked.join(before, "key", "left_semi").select("claimant").distinct()
    waiting, folder, n = staged(asked.join(blocked, "claimant", "left_anti"), "claims"), f"{shared_dir(spark)}/granted-{uuid.uuid4().hex}", 0
    waiting.limit(0).write.parquet(f"{folder}/round={n}")
    while not waiting.isEmpty():
        n += 1
        first = waiting.groupBy("key").agg(F.min("claimant").alias("first"))
        ahead = waiting.join(first, "key").groupBy("claimant").agg(F.bool_and(F.col("claimant") == F.col("first")).alias("ahead"))
        waiting.join(ahead.where("ahead"), "claimant", "left_semi").write.parquet(f"{folder}/round={n}")
        taken = spark.read.schema(waiting.schema).parquet(f"{folder}/round={n}").select("key")
        decided = waiting.join(taken, "key", "left_semi").select("claimant").distinct()
        waiting = staged(waiting.join(decided, "claimant", "left_anti"), "claims")
    holders = spark.read.schema(asked.schema).parquet(*(f"{folder}/round={i}" for i in range(n + 1))).withColumnRenamed("claimant", "holder")
    met = asked.join(holders.select("key", "holder"), "key", "left").join(before.withColumn("stored", F.lit(True)), "key", "left")
    gone = F.coalesce("stored", F.lit(False)) | F.coalesce(F.col("holder") < F.col("claimant"), F.lit(False))
    fates = met.groupBy("claimant").agg(F.bool_and(F.col("holder").eqNullSafe(F.col("claimant"))).alias("granted"), F.min(F.when(gone, F.struct("key", "holder"))).alias("lost"))
    return fates.select("claimant", "granted", F.col("lost.key").alias("lost"), F.col("lost.holder").alias("holder"))


def gate() -> Column:
    """The first gate that a request does not pass, RECEIPT for one that was confirmed before with the same content, or null.

    Of the request: ``review_confirmed, acknowledged, actor, expected_revision, fingerprint, schema_revision, document_type,
    mode, document_revision, target, n_rows, n_keys`` (``n_rows`` null: it refers to a record and brings no form);
    of what is stored, with null where nothing is: ``upload_*``, ``schema_*`` and ``document_*`` as ``judged`` joins them.
    """
    c = F.col
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    version = c("mode") == "version"
    same = c("document_schema_id").eqNullSafe(c("schema_id")) & c("document_kind").eqNullSafe(c("document_type")) & c("document_target").eqNullSafe(c("target"))
    return (
        F.when(~yes(c("review_confirmed")), "REVIEW_REQUIRED")
        .when(~yes(c("upload_owner") == c("actor")), "NOT_FOUND")
        .when(c("upload_status").isin("EXTRACTING", "EXTRACTION_FAILED"), "EXTRACTION_NOT_COMPLETE")
        .when((c("upload_status") == "READY") & c("upload_fingerprint").eqNullSafe(c("fingerprint")), "RECEIPT")
        .when(c("upload_status") == "READY", "COMMIT_KEY_CONFLICT")
        .when(~yes(c("upload_revision") == c("expected_revision")) | (c("upload_status") == "INDEXING"), "LIBRARY_REVISION_CONFLICT")
        .when((F.coalesce(c("upload_warnings"), F.lit(0)) > 0) & ~yes(c("acknowledged")), "EXTRACTION_REVIEW_REQUIRED")
        .when(~yes(c("schema_stored_revision") == c("schema_revision")), "SCHEMA_REVISION_CONFLICT")
        .when(~yes(F.array_contains(c("schema_document_types"), c("document_type"))), "DOCUMENT_TYPE_INVALID")
        .when(~yes(c("mode").isin("new", "version")), "DOCUMENT_MODE_INVALID")
        .when(version & ~yes((c("document_owner") == c("actor")) & (c("document_stored_revision") == c("document_revision")) & c("document_pending").isNull() & same), "DOCUMENT_REVISION_CONFLICT")
        .when(~yes(c("n_rows").isNull() | c("n_rows").between(1, MOST_ROWS)), "FORM_INVALID")
        .when(c("n_keys") < c("n_rows"), "DUPLICATE_MEMBER_KEY")
        .when(c("n_rows").isNull() & ~yes(F.length("target").between(1, 200)), "TARGET_REQUIRED")
    )


def judged(requests: DataFrame, uploads: DataFrame, schemas: DataFrame, documents: DataFrame) -> DataFrame:
    """The requests with ``refused``, the first gate they do not pass by themselves."""
    up = uploads.select("upload_id", *(F.col(c).alias(f"upload_{c}") for c in ("owner", "status", "revision", "warnings", "fingerprint")))
    known = schemas.select("schema_id", F.col("revision").alias("schema_stored_revision"), F.col("document_types").alias("schema_document_types"))
    old = documents.select("document_id", F.col("owner").alias("document_owner"), F.col("revision").alias("document_stored_revision"), F.col("pending").alias("document_pending"),
                           F.col("schema_id").alias("document_schema_id"), F.col("document_type").alias("document_kind"), F.col("target").alias("document_target"))
    met = requests.join(up, "upload_id", "left").join(known, "schema_id", "left").join(old, "document_id", "left")
    return met.select(*(requests[c] for c in requests.columns if c not in ("upload_id", "schema_id", "document_id")), "upload_id", "schema_id", "document_id", gate().alias("refused"))


def committed(requests: DataFrame, members: DataFrame, uploads: DataFrame, schemas: DataFrame, documents: DataFrame, records: DataFrame) -> DataFrame:
    """(request_id, outcome, lost) of a batch: COMMITTED, RECEIPT, or the code of what refused it; of several, the request's
    own gates come first, then its attachment, its document and the smallest of its members that were taken.

    ``members`` (request_id, key) are the forms' business keys, ``records`` (schema_id, key, document_id) the members stored;
    those of the very document that a request makes a new version of stand in nobody's way but others'.
    ``requests`` need neither ``n_rows`` nor ``n_keys``: both are counted here, null where ``brings_form`` is false.
    """
    counted = members.groupBy("request_id").agg(F.count("*").alias("rows"), F.count_distinct("key").alias("keys"))
    forms = requests.join(counted, "request_id", "left")
    forms = forms.withColumns({name: F.when(F.col("brings_form"), F.coalesce(count, F.lit(0))) for name, count in (("n_rows", "rows"), ("n_keys", "keys"))}).drop("rows", "keys")
    gated = staged(judged(forms, uploads, schemas, documents), "gated")
    through = gated.where("refused IS NULL")
    member = lambda schema, key: F.concat(F.lit("member:"), schema.cast("string"), F.lit(":"), key)
    wanted = members.join(through.where("brings_form").select("request_id", "schema_id", "mode", "document_id"), "request_id").select(F.col("request_id").alias("claimant"), member(F.col("schema_id"), F.col("key")).alias("key"), F.when(F.col("mode") == "version", F.col("document_id")).alias("of"))
    stored = records.select(member(F.col("schema_id"), F.col("key")).alias("key"), F.col("document_id").alias("holder"))
    # a stored member is in the way of all but new versions of its own document
    foreign = wanted.join(stored, "key").where(~F.coalesce(F.col("of") == F.col("holder"), F.lit(False)))
    foreign = staged(foreign.groupBy("claimant").agg(F.min("key").alias("key")), "foreign")
    left = through.join(foreign.select(F.col("claimant").alias("request_id")), "request_id", "left_anti")
    one = left.select(F.col("request_id").alias("claimant"), F.concat(F.lit("attachment:"), F.col("upload_id").cast("string")).alias("key"))
    versions = left.where("mode = 'version'").select(F.col("request_id").alias("claimant"), F.concat(F.lit("document:"), F.col("document_id").cast("string")).alias("key"))
    keys = wanted.join(left.select(F.col("request_id").alias("claimant")), "claimant", "left_semi").select("claimant", "key")
    claims = one.unionByName(versions).unionByName(keys)
    fates = settled(claims, claims.select("key").limit(0))
    kin = fates.where("lost LIKE 'attachment:%'").select("claimant", "holder").join(gated.select(F.col("request_id").alias("holder"), F.col("fingerprint").alias("theirs")), "holder").select("claimant", "theirs")
    fates = fates.join(kin, "claimant", "left").select("claimant", "granted", "lost", "theirs")
    fates = fates.unionByName(foreign.select("claimant", F.lit(False).alias("granted"), F.col("key").alias("lost")), allowMissingColumns=True).withColumnRenamed("claimant", "request_id")
    code = (
        F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("granted"), "COMMITTED").when(F.col("lost").startswith("member:"), "MEMBER_ALREADY_EXISTS")
        .when(F.col("lost").startswith("document:"), "DOCUMENT_REVISION_CONFLICT").when(F.col("theirs").eqNullSafe(F.col("fingerprint")), "RECEIPT").otherwise("COMMIT_KEY_CONFLICT")
    )
    return gated.join(fates, "request_id", "left").select("request_id", code.alias("outcome"), "lost")


_CODEC, _PACKED = "zstd", b"\xff"  # no text begins with this byte


@F.arrow_udf(BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """Texts as bytes, compressed where that is shorter: sealed bytes no longer are."""
    codec, out = pa.Codec(_CODEC, compression_level=1), []
    for data in texts.cast(pa.binary()).to_pylist():
        if data is not None and len(small := _PACKED + len(data).to_bytes(8, "little") + codec.compress(data, asbytes=True)) < len(data):
            data = small
        out.append(data)
    return pa.array(out, pa.binary())


@F.arrow_udf(StringType())
def unpacked(datas: pa.Array) -> pa.Array:
    """The texts of what ``packed`` made, or of plain bytes."""
    codec = pa.Codec(_CODEC)
    texts = (x if x is None or x[:1] != _PACKED else codec.decompress(x[9:], int.from_bytes(x[1:9], "little"), asbytes=True) for x in datas.to_pylist())
    return pa.array([x if x is None else x.decode() for x in texts], pa.string())


class SealedEntries:
    """Entries of workspaces, their content sealed under their own name, with a revision that an update must name.

    What is stored is (name, workspace, entry_id, kind, owner, payload, version). The name is part of the seal, so a
    payload moved to another entry does not open. Payloads are compressed before they are sealed. Without ``secret`` the session's stored key seals and opens.
    """

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 64, secret: Column | None = None) -> None:
        self.table, self.secret = VersionedTable(spark, path, "name", n_buckets), archive.key(spark) if secret is None else secret

    def _sealed(self, entries: DataFrame) -> DataFrame:
        name = F.to_json(F.array("workspace", "entry_id"))
        payload = F.aes_encrypt(packed("payload"), self.secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), name)
        return entries.select(name.alias("name"), "workspace", "entry_id", "kind", "owner", payload.alias("payload"), *(c for c in ("expected", "version") if c in entries.columns))

    def create(self, entries: DataFrame) -> Snapshot:
        """The first version, of (workspace, entry_id, kind, owner, payload)."""
        return self.table.create(self._sealed(entries.withColumn("version", F.lit(1))))

    def put(self, entries: DataFrame, base: Snapshot | None = None) -> tuple[Snapshot, int]:
        """Writes entries with ``expected``, the revision they replace (0: a new one); how many were refused is returned."""
        return self.table.merge(self._sealed(entries), base)

    def read(self, workspace: str | None = None, kind: str | None = None, owner: str | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """(workspace, entry_id, kind, owner, revision, payload, refused): what does not open is refused and has no payload."""
        rows = self.table.read(snapshot)
        for column, value in (("workspace", workspace), ("kind", kind), ("owner", owner)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        plain = F.try_aes_decrypt("payload", self.secret, F.lit("GCM"), F.lit("DEFAULT"), F.col("name"))
        return rows.select("workspace", "entry_id", "kind", "owner", F.col("version").alias("revision"), unpacked(plain).alias("plain"), (F.col("payload").isNotNull() & plain.isNull()).alias("refused")).withColumnRenamed("plain", "payload")
