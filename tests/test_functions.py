"""Functions against Python's own, sources against fixtures, streams against batches."""

import hashlib
import hmac
import json
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import casts, ident, rules, text
from tessera.operators import adapt, documents, sync, transform
from tessera.sources import files, specs
from tessera.streaming import changes

SF = "/root/testdata/sf0.001"
WORDS = ["", "a b", "Ünï cödé", "x" * 100, "customerID"]


def one(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(w,) for w in rows], "w string").select(*columns).collect()]


def test_identifiers_equal_python(spark):
    got = one(spark, WORDS, ident.uuid5(F.col("w")), ident.hmac_sha256(b"k" * 70, F.col("w")), ident.hash_embedding(F.col("w")))
    for w, (u, h, v) in zip(WORDS, got):
        assert u == str(uuid.uuid5(uuid.NAMESPACE_URL, w)) and h == hmac.new(b"k" * 70, w.encode(), hashlib.sha256).hexdigest()
        assert v == [b / 255 for b in hashlib.sha256(w.encode()).digest()[::1][:16]]


def test_guarded_casts(spark):
    rows = ["12", "12.0", "1e3", "1,000", "2026", "2026-01-15", "2026-13-01", "yes", "TRUE", None, "1.5", "2026-01-15T10:00:00Z", "1e40", "0x10"]
    got = one(spark, rows, casts.to_integer(F.col("w"))["value"], casts.to_boolean(F.col("w"))["value"], casts.to_date(F.col("w"))["value"].cast("string"), casts.to_datetime(F.col("w"))["value"].cast("string"))
    assert [g[0] for g in got] == [12, 12, 1000, None, 2026, None, None, None, None, None, None, None, None, None]
    assert [g[1] for g in got] == [None] * 8 + [True] + [None] * 5
    assert [g[2] for g in got if g[2]] == ["2026-01-15"] and [g[3] for g in got if g[3]] == ["2026-01-15 00:00:00", "2026-01-15 10:00:00"]


def test_rules_refuse_unknown_operations_and_stop_at_the_first_issue(spark):
    with pytest.raises(ValueError):
        rules.compiled([("exec", {})], F.col("w"))
    chain = [("split", {"separator": "-", "index": 5}), ("constant", {"to": "never"})]
    assert one(spark, ["a-b"], rules.compiled(chain, F.col("w"))["value"], rules.compiled(chain, F.col("w"))["issue"]) == [(None, "SPLIT_INDEX_OUT_OF_RANGE")]


def test_text_functions(spark):
    assert one(spark, ["XMLHttpRequest", "e002", "inv204"], F.array_join(text.split_tokens(F.col("w")), " ")) == [("xml http request",), ("e002",), ("inv 204",)]
    assert one(spark, [" A--b  C! ", "é"], text.identifier(F.col("w"))) == [("a--b_c",), ("",)]


def test_chunks_cover_a_text():
    body = "One sentence here. " * 200
    bounds = documents.chunk_bounds(body)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(body) and all(b[0] < a[1] for a, b in zip(bounds, bounds[1:])) and all(e - s <= 900 for s, e in bounds)
    assert documents.chunk_bounds("") == []


def test_duplicates_with_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "n int, k string")
    got = {r["n"]: r["outcome"] for r in transform.duplicates(rows, [F.col("k")], ["n"], "REJECT").collect()}
    assert got == {1: "accepted", 2: "rejected", 3: "accepted", 4: "accepted"}


def test_delimited_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿amount;Amount;;total\n1;2;3\n\n4;5;6;7;8\n\"x;y\";2;3;4\n".encode())
    got = files.read_delimited(spark, str(path))
    assert got.columns == ["amount", "amount.2", "column_3", "total", "missing_fields", "extra_values", "extra"]
    assert sorted(map(tuple, got.collect())) == [("1", "2", "3", None, 1, 0, []), ("4", "5", "6", "7", 0, 1, ["8"]), ("x;y", "2", "3", "4", 0, 0, [])]
    path.write_text("a,b\n1,2," + ",".join(f"x{i}" for i in range(11)) + ',"y,""z"""\n')
    assert [(r["a"], r["b"], r["extra_values"], r["extra"]) for r in files.read_delimited(spark, str(path)).collect()] == [("1", "2", 12, [*(f"x{i}" for i in range(11)), 'y,"z"'])]
    path.write_bytes("a,b\n1,2\n".encode("utf-16"))
    with pytest.raises(ValueError, match="UTF-16"):
        files.read_delimited(spark, str(path))
    path.write_bytes(b"a,b\n1,\xff\xfe\n")
    with pytest.raises(Exception, match="UTF-8"):
        files.read_delimited(spark, str(path)).collect()
    assert files.delimiter_of(["a\tb", "1\t2"]) == "\t" and files.delimiter_of(["abc"]) == ","
    with pytest.raises(ValueError):
        files.encoding_of(b"\xff\xfea\0")


def test_file_kinds(spark):
    rows = spark.createDataFrame([(bytearray(b"%PDF-1.7"), "a.pdf"), (bytearray(b"%PDF-1.7"), "a.csv"), (bytearray(b"a,b"), "a.csv"), (bytearray(b"zz"), "a")], "c binary, n string")
    assert [r[0] for r in rows.select(files.file_kind(F.col("c"), F.col("n"))).collect()] == ["pdf", "mismatch", "csv", "unknown"]


def test_api_descriptions(spark):
    spec = {"openapi": "3.0.0", "paths": {"/v1/orders/{id}": {"parameters": [{"name": "id", "in": "path"}], "get": {"responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Order"}}}}}}}},
            "components": {"schemas": {"Order": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "on": {"type": "string", "format": "date"}, "next": {"$ref": "#/components/schemas/Order"}, "lines": {"type": "array", "items": {"type": "object", "properties": {"sku": {"type": "string"}}}}}}}}}
    ops, fields = specs.parse(spark, json.dumps(spec))
    assert [tuple(r) for r in ops.collect()] == [("GET", "/v1/orders/{id}", "id", "Order")]
    assert {(r["field"], r["type"], r["required"]) for r in fields.collect()} == {("id", "integer", True), ("on", "date", False), ("next", "object", False), ("lines", "array", False), ("lines[].sku", "string", False)}
    with pytest.raises(ValueError):
        specs.parse(spark, "{}")


def _split(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    for i in range(3):
        events.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    return events


def test_merge_stream_equals_batch_and_restarts(spark, tmp_path):
    events = _split(spark, tmp_path)
    target = {}

    def apply(batch, number):
        current = spark.createDataFrame(list(target.values()), batch.schema)
        target.update({r["user_id"]: r for r in sync.merged(current, batch, "user_id", "event_id").collect()})

    stream = changes.file_stream(spark, str(tmp_path / "in"), events.schema)
    for _ in range(2):  # the second run finds nothing left
        changes.merge_stream(stream, str(tmp_path / "at"), apply).awaitTermination(120)
    want = {r["user_id"]: r["m"] for r in events.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert {k: r["event_id"] for k, r in target.items()} == want


def test_stream_windows_equal_batch(spark, tmp_path):
    events = _split(spark, tmp_path)
    counted = changes.tumbling(changes.file_stream(spark, str(tmp_path / "in"), events.schema, 10), "ts", "event_type", late="3650 days")
    q = counted.writeStream.outputMode("update").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.sql("select start, event_type, max(n) n from win group by 1, 2").collect()}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in changes.tumbling(events, "ts", "event_type").collect()}


def plain_relevance(field, names, of_entity, is_identity, entity, query):
    """The scores from their definition."""
    def words(text):
        return text.lower().replace("_", " ").split()

    raw = words(query)
    tokens = [w for w in raw if w not in adapt.STOPWORDS]
    for phrase, implied in adapt.INTENTS.items():
        k = len(phrase.split())
        if any(raw[i : i + k] == phrase.split() for i in range(len(raw))):
            tokens += implied
    tokens = [] if {*tokens} & {*adapt.BROAD} else tokens

    def cover(name):
        t = [w for w in words(name) if w not in adapt.STRUCTURAL] or words(name)
        a, b = {*t} - {entity}, {*tokens} - {entity}
        return round(len(a & b) / min(len(a), len(b)), 6) if a and b else 0.0

    alias = max(map(cover, names), default=0.0) if names is not None else 0.0
    belongs = 0.0 if names is None else 0.5 if entity is None else 1.0 if of_entity == entity else 0.25
    return 0.45 * alias + 0.3 * cover(field) + 0.15 * belongs + 0.1 * is_identity


def test_relevance_equals_its_definition(spark):
    draw = random.Random(6)
    vocabulary = "show me how much how many is the invoice total when was it paid who late status all overview where customer email of and shipped".split()
    fields = [("status", ["status", "payment_status"]), ("due_date", ["date", "due_date"]), ("customer_name", ["customer"]), ("email", ["email", "contact_email"]), ("id", ["id"]), ("unknown", None)]
    rows = []
    for _ in range(120):
        field, names = draw.choice(fields)
        rows.append((field, names, draw.choice(["invoice", "customer"]), draw.random() < 0.3, draw.choice(["invoice", "customer", None]), " ".join(draw.choices(vocabulary, k=draw.randint(0, 7)))))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, field string, names array<string>, of_entity string, is_identity boolean, entity string, query string")
    got = {r["i"]: r["s"] for r in table.select("i", adapt.relevance(*(F.col(c) for c in ("field", "names", "of_entity", "is_identity", "entity", "query"))).alias("s")).collect()}
    assert all(abs(got[i] - plain_relevance(*r)) < 2e-6 for i, r in enumerate(rows))


def test_inferred_identity(spark):
    rows = spark.createDataFrame([(["status", "case_no", "order_id"],), (["currency_code", "id"],), ([],)], "n array<string>")
    assert [r[0] for r in rows.select(adapt.inferred_identity(F.col("n"))).collect()] == ["case_no", None, None]


def test_nested_assignment_and_computed_order(spark):
    row = spark.range(1).select(transform.nested({"id": F.lit(1), "customer.name": F.lit("a"), "customer.address.city": F.lit("b")}).alias("r")).first()["r"]
    assert row.asDict(recursive=True) == {"id": 1, "customer": {"name": "a", "address": {"city": "b"}}}
    for values in ({"a": 1, "a.b": 2}, {"a.b": 1, "a": 2}, {"a.b": 1, "a.b.c": 2}):
        with pytest.raises(ValueError):
            transform.nested({k: F.lit(v) for k, v in values.items()})
    assert transform.computed_order({"c": ["b", "x"], "a": ["x"], "b": ["a", "b"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="need each other"):
        transform.computed_order({"a": ["b"], "b": ["c"], "c": ["a"]})
    made = transform.with_computed(spark.range(3), {"c": (["b"], lambda b: b + 1), "b": (["id"], lambda i: i * 2)})
    assert sorted((r["b"], r["c"]) for r in made.collect()) == [(0, 1), (2, 3), (4, 5)]


def test_types_of_values(spark):
    values = ["1", "1.5", '"x"', "true", "null", "[1]", "{}", "x y", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    fine = {"integer": {"1"}, "decimal": {"1", "1.5"}, "string": {'"x"'}, "boolean": {"true"}, "array": {"[1]"}, "object": {"{}"}}
    for expected, right in fine.items():
        got = {r["v"] for r in rows.where(transform.typed(F.col("v"), "f", expected).isNull()).collect()}
        assert got == right | {"null", None}
