"""Binary columns: every outcome, encodings, shared files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import payloads

VALUES = [
    (1, None, "empty", None), (2, b"", "empty", None), (3, "Grüße 🙂".encode(), "extracted", "Grüße 🙂"), (4, b"\xef\xbb\xbfabc", "extracted", "abc"), (5, "é🙂".encode("utf-16"), "extracted", "é🙂"), (6, b"\xfe\xff" + "x".encode("utf-16-be"), "extracted", "x"),
    (7, b"\xff\xfex", "unreadable", None), (8, b"\xff\xfe\x00\xd8x\x00", "unreadable", None), (9, b"abc\xc3", "unreadable", None), (10, b"%PDF-1.4 x", "unsupported_binary", None), (11, b"\x89PNG\r\n\x1a\n", "unsupported_binary", None),
    (12, b"a\x00b", "unsupported_binary", None), (13, b"y" * 101, "too_large", None), (14, b"z" * 100, "extracted", "z" * 40), (15, b"abc", "extracted", "abc"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None, f"{k}") for k, v, *_ in VALUES], "k long, body binary, note string")


def test_outcomes_by_bytes(rows):
    found = {r["k"]: r for r in payloads.scanned(rows, "k", ["body"], 100, 40).collect()}
    for k, value, outcome, text in VALUES:
        r = found[k]
        assert (r["outcome"], r["text"], r["size"]) == (outcome, text, len(value or b"")), k
        assert r["document_id"] == (hashlib.sha256(value).hexdigest() if value and len(value) <= 100 else None)
    assert found[10]["media_type"] == "application/pdf" and found[5]["encoding"] == "utf-16le" and found[3]["media_type"] == "text/plain"
    assert payloads.scanned(rows.where("false"), "k", ["body"]).count() == 0 and payloads.scanned(rows, "k", ["body", "note"]).count() == 2 * len(VALUES)


def test_files_that_records_share(rows):
    found = payloads.scanned(rows, "k", ["body"], 100, 40).withColumn("scope", F.col("k") % 2)
    made = {(r["scope"], r["text"]): (r["owners"], r["first_owner"], r["attachment_id"]) for r in payloads.attachments(found.unionByName(found.where("k = 3").withColumn("k", F.lit(33).cast("long"))), "scope", "k").collect()}
    assert made[1, "Grüße 🙂"][:2] == (2, 3) and made[1, "abc"][:2] == (1, 15) and made[0, "abc"][:2] == (1, 4) and len({m[2] for m in made.values()}) == len(made) == 6
