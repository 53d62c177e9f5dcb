"""Binary columns as documents: what each declared field holds, read by its bytes alone, and files that records share.

A row and a declared field give one outcome, and nothing raises: ``empty``, ``too_large``, ``unsupported_binary``
(by signature, or bytes that are no text), ``unreadable`` (text whose bytes are broken) or ``extracted``. The name of
a document is the hash of its bytes, so the same bytes are the same document wherever they come from. Bytes never
leave this module; what goes on is text, cut at ``MOST_CHARS``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one value; characters of its text.
MOST_BYTES, MOST_CHARS = 32 * 1024 * 1024, 40_000
# Signatures, and the marks of text encodings.
SIGNATURES = (
    ("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"),
    ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"),
)
MARKS = (("EFBBBF", "utf-8"), ("FFFE", "utf-16le"), ("FEFF", "utf-16be"))


def _wide_text(content: Column) -> Column:
    """UTF-16 after its mark; null where the bytes are broken."""
    def read(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else bytes(raw).decode("utf-16")
        except UnicodeDecodeError:
            return None

    def texts(values: pd.Series) -> pd.Series:
        return values.map(read)

    return F.pandas_udf(texts, "string")(content)


def scanned(rows: DataFrame, key: str, fields: list[str], most_bytes: int = MOST_BYTES, most_chars: int = MOST_CHARS) -> DataFrame:
    """(key, field, outcome, document_id, media_type, encoding, size, text): a row for each row and declared field."""
    entries = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("binary").alias("content")) for f in fields)))
    found = rows.select(key, entries.alias("e")).select(key, "e.*").withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)))
    content = F.when(F.col("size").between(1, most_bytes), F.col("content"))  # larger values are not looked at
    head = F.hex(F.substring(content, 1, 16))

    def first(table) -> Column:
        ladder = F.when(F.lit(False), "")
        for mark, name in table:
            ladder = ladder.when(head.startswith(mark), name)
        return ladder

    found = found.withColumns({"content": content, "_signature_": first(SIGNATURES), "encoding": F.coalesce(first(MARKS), F.lit("utf-8"))})
    plain = F.col("content").cast("string")
    is_wide = F.col("encoding") != "utf-8"
    found = found.withColumn("_narrow_", F.when(~is_wide & F.is_valid_utf8(plain), F.ltrim(plain, F.lit("﻿"))))
    found = found.withColumn("_wide_", _wide_text(F.when(is_wide, F.col("content"))))
    text = F.coalesce("_narrow_", "_wide_")
    outcome = (
        F.when(F.col("size") == 0, "empty").when(F.col("size") > most_bytes, "too_large").when(F.col("_signature_").isNotNull(), "unsupported_binary")
        .when(text.isNull(), "unreadable").when(F.contains(text, F.lit("\x00")), "unsupported_binary").otherwise("extracted")
    )
    found = found.withColumn("outcome", outcome)
    read = F.col("outcome") == "extracted"
    kind = F.coalesce("_signature_", F.when(read, F.when(text.rlike(r"(?i)^\s*<(!doctype html|html)"), "text/html").when(F.ltrim(text).startswith("<"), "text/xml").when(F.try_parse_json(text).isNotNull(), "application/json").otherwise("text/plain")))
    return found.select(key, "field", "outcome", F.sha2("content", 256).alias("document_id"), kind.alias("media_type"), F.when(read, F.col("encoding")).alias("encoding"), "size", F.when(read, F.substring(text, 1, most_chars)).alias("text"))


def attachments(documents: DataFrame, scope: str, owner: str) -> DataFrame:
    """(attachment_id, scope, document_id, owners, first_owner, text) of the extracted ``documents``: one representation
    of each document and scope, however many records hold it; another scope's is another one."""
    rows = documents.where("outcome = 'extracted'").groupBy(scope, "document_id")
    made = rows.agg(F.countDistinct(owner).alias("owners"), F.min(owner).alias("first_owner"), F.min("text").alias("text"))
    name = F.concat(F.lit("att."), F.substring(F.sha2(F.concat_ws("|", F.col(scope).cast("string"), "document_id"), 256), 1, 20))
    return made.select(name.alias("attachment_id"), scope, "document_id", "owners", "first_owner", "text")
