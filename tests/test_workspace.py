"""Commits of a workspace one after the other in plain Python, and sealed entries that met other hands."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import workspace


def in_order(claims, held):
    """What happens when claimants come one by one."""
    taken, out = {k: None for k in held}, {}
    for who in sorted({c for c, _ in claims}):
        keys = {k for c, k in claims if c == who}
        gone = sorted(keys & taken.keys())
        out[who] = (not gone, gone[0] if gone else None, taken[gone[0]] if gone else None)
        if not gone:
            taken |= dict.fromkeys(keys, who)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_claims_are_settled_as_if_in_order(spark, seed):
    dice = random.Random(seed)
    claims = [(who, f"k{dice.randrange(60)}") for who in range(60) for _ in range(dice.randint(1, 3))] + [(who, "hot") for who in range(0, 60, 3)]
    claims += [(100 + i, f"chain{i + d}") for i in range(4) for d in (0, 1)] + [(7, "k1"), (7, "k1")]  # each waits for the one before
    held = ["k5", "k6", "nobody's"]
    got = workspace.settled(spark.createDataFrame(claims, "claimant long, key string"), spark.createDataFrame([(k,) for k in held], "key string"))
    assert {r["claimant"]: (r["granted"], r["lost"], r["holder"]) for r in got.collect()} == in_order(claims, held)


def test_claims_without_rows_or_keys(spark):
    none = spark.createDataFrame([(None, "k"), (3, None)], "claimant long, key string")
    assert workspace.settled(none, none.select("key")).count() == 0
    assert workspace.settled(none.limit(0), none.select("key").limit(0)).count() == 0


REQUEST = dict(
    request_id=1, upload_id=1, actor="ann", fingerprint="f", review_confirmed=True, acknowledged=False, expected_revision=3, schema_id="s", schema_revision=2, document_type="invoice", mode="new",
    document_id=None, document_revision=None, target=None, brings_form=True,
)
COLUMNS = (
    "request_id long, upload_id long, actor string, fingerprint string, review_confirmed boolean, acknowledged boolean, expected_revision int, schema_id string, schema_revision int, document_type string, mode string, "
    "document_id string, document_revision int, target string, brings_form boolean"
)
VERSION = dict(mode="version", document_id="d1", document_revision=4, upload_id=8)
CASES = [
    ({}, ["a", "b"], "COMMITTED"), (dict(review_confirmed=None), ["c1"], "REVIEW_REQUIRED"), (dict(actor="bob"), ["c2"], "NOT_FOUND"), (dict(upload_id=99), ["c3"], "NOT_FOUND"),
    (dict(upload_id=2), ["c4"], "EXTRACTION_NOT_COMPLETE"), (dict(upload_id=3, fingerprint="done"), ["c5"], "RECEIPT"), (dict(upload_id=3), ["c6"], "COMMIT_KEY_CONFLICT"),
    (dict(upload_id=4, expected_revision=2), ["c7"], "LIBRARY_REVISION_CONFLICT"), (dict(upload_id=5), ["c8"], "EXTRACTION_REVIEW_REQUIRED"), (dict(upload_id=5, acknowledged=True), ["c9"], "COMMITTED"),
    (dict(upload_id=4, schema_revision=1), ["c10"], "SCHEMA_REVISION_CONFLICT"), (dict(upload_id=4, document_type="poem"), ["c11"], "DOCUMENT_TYPE_INVALID"), (dict(upload_id=4, document_type=None), ["c12"], "DOCUMENT_TYPE_INVALID"),
    (dict(upload_id=4, mode="other"), ["c13"], "DOCUMENT_MODE_INVALID"), (VERSION | dict(document_revision=3), ["c14"], "DOCUMENT_REVISION_CONFLICT"), (VERSION | dict(document_type="note"), ["c15"], "DOCUMENT_REVISION_CONFLICT"),
    (dict(upload_id=4), [], "FORM_INVALID"), (dict(upload_id=4), [f"m{i}" for i in range(51)], "FORM_INVALID"), (dict(upload_id=4), ["x", "x"], "DUPLICATE_MEMBER_KEY"), (dict(upload_id=4, brings_form=False), [], "TARGET_REQUIRED"),
    (dict(upload_id=6, brings_form=False, target="order 7"), [], "COMMITTED"), (dict(upload_id=4), ["kept"], "MEMBER_ALREADY_EXISTS"), (dict(upload_id=4), ["n", "b"], "MEMBER_ALREADY_EXISTS"),
    (dict(upload_id=4), ["n"], "COMMITTED"), (dict(upload_id=4), ["o"], "RECEIPT"), (dict(upload_id=4, fingerprint="g"), ["p"], "COMMIT_KEY_CONFLICT"),
    (VERSION, ["kept"], "COMMITTED"), (VERSION | dict(upload_id=9), ["q"], "DOCUMENT_REVISION_CONFLICT"),
]


def test_gates_of_a_commit(spark):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    requests = spark.createDataFrame([tuple((REQUEST | change | dict(request_id=i))[n] for n in names) for i, (change, _, _) in enumerate(CASES)], COLUMNS)
    members = spark.createDataFrame([(i, k) for i, (_, keys, _) in enumerate(CASES) for k in keys], "request_id long, key string")
    uploads = spark.createDataFrame(
        [(1, "ann", "REVIEW", 3, 0, None), (2, "ann", "EXTRACTING", 3, 0, None), (3, "ann", "READY", 9, 0, "done"), (4, "ann", "REVIEW", 3, 0, None), (5, "ann", "INDEX_FAILED", 3, 2, None), (6, "ann", "REVIEW", 3, 0, None),
         (8, "ann", "REVIEW", 3, 0, None), (9, "ann", "REVIEW", 3, 0, None)], "upload_id long, owner string, status string, revision int, warnings int, fingerprint string")
    schemas = spark.createDataFrame([("s", 2, ["invoice", "note"])], "schema_id string, revision int, document_types array<string>")
    documents = spark.createDataFrame([("d1", "ann", 4, None, "s", "invoice", None)], "document_id string, owner string, revision int, pending string, schema_id string, document_type string, target string")
    records = spark.createDataFrame([("s", "kept", "d1")], "schema_id string, key string, document_id string")
    got = workspace.committed(requests, members, uploads, schemas, documents, records).collect()
    assert {r["request_id"]: r["outcome"] for r in got} == {i: outcome for i, (_, _, outcome) in enumerate(CASES)} and len(got) == len(CASES)
    assert {r["lost"] for r in got} == {None, "member:s:kept", "member:s:b", "attachment:4", "document:d1"}


def test_sealed_entries(spark, tmp_path):
    store = workspace.SealedEntries(spark, f"file://{tmp_path}/w", 4)
    columns = "workspace string, entry_id string, kind string, owner string, payload string"
    store.create(spark.createDataFrame([("w", "1", "upload", "ann", "secret text"), ("w", "2", "schema", "bob", "two"), ("v", "1", "upload", "ann", None)], columns))
    assert not any(b"secret text" in f.read_bytes() for f in tmp_path.rglob("*.parquet"))
    change = spark.createDataFrame([("w", "1", "upload", "ann", "new", 1), ("w", "2", "schema", "bob", "late", 5), ("w", "3", "upload", "ann", "third", 0)], columns + ", expected int")
    made, refused = store.put(change)
    assert refused == 1
    said = lambda rows: sorted((r["entry_id"], r["revision"], r["payload"], r["refused"]) for r in rows.collect())
    assert said(store.read("w")) == [("1", 2, "new", False), ("2", 1, "two", False), ("3", 1, "third", False)]
    assert said(store.read("w", "upload", "ann")) == [("1", 2, "new", False), ("3", 1, "third", False)] and said(store.read("v")) == [("1", 1, None, False)]
    rows = store.table.read().where("workspace = 'w'")  # a payload under another entry's name
    moved = rows.where("entry_id = '1'").select("payload").crossJoin(rows.where("entry_id = '2'").drop("payload")).select(*rows.columns)
    store.table.replace(made, rows.where("entry_id <> '2'").unionByName(moved), sorted(made.buckets))
    assert ("2", 1, None, True) in said(store.read("w"))


def test_long_texts_are_kept_small_and_come_back_whole(spark, tmp_path):
    store = workspace.SealedEntries(spark, f"file://{tmp_path}/w", 2)
    texts = ["word of a long text " * 5_000, "", "\u00ff\U0001f600 short", None, "\x00\x01", "ü" * 300_000]
    store.create(spark.createDataFrame([("w", str(i), "upload", "ann", t) for i, t in enumerate(texts)], "workspace string, entry_id string, kind string, owner string, payload string").coalesce(1))
    assert [(r["payload"], r["refused"]) for r in store.read().orderBy("entry_id").collect()] == [(t, False) for t in texts]
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 50_000
    name = F.to_json(F.array(F.lit("w"), F.lit("0")))  # as entries were sealed before they were compressed
    old = spark.range(1).select(F.aes_encrypt(F.lit("old text"), store.secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), name).alias("payload"), *(F.lit(x).alias(c) for c, x in (("workspace", "w"), ("entry_id", "0"), ("kind", "upload"), ("owner", "ann"), ("version", 1)))).withColumn("name", name)
    base = store.table.snapshot()
    store.table.replace(base, old.select(*store.table.read().columns), sorted(base.buckets))
    assert [(r["payload"], r["refused"]) for r in store.read().collect()] == [("old text", False)]
