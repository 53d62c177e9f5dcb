"""Identifiers, hashes and tokens as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import identifier

PREFIX = "rec"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: RFC 4122's namespace of URLs


def canonical_id(system: Column, entity: Column, key: Column) -> Column:
    """Four parts joined by colons, each normalised; null where a part is null or empty."""
    parts = [identifier(c) for c in (system, entity, key)]
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return F.when(whole, F.concat_ws(":", F.lit(PREFIX), *parts))


def parsed_id(record_id: Column) -> Column:
    """struct<system, entity, key>, or null where the text has not four non-empty parts."""
    parts = F.split(record_id, ":", 4)
    ok = (F.size(parts) == 4) & ~F.exists(parts, lambda p: p == "") & (F.get(parts, F.lit(0)) == PREFIX)
    return F.when(ok, F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in ((1, "system"), (2, "entity"), (3, "key"))]))


def is_surrogate(key: Column) -> Column:
    """Whether a key is a bare number."""
    return F.coalesce(F.btrim(key.cast("string")).rlike(r"^\d+$"), F.lit(False))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON of text values by sorted key, nulls left out."""
    return F.to_json(F.struct(*[fields[k].cast("string").alias(k) for k in sorted(fields)]))


def content_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC of a text under a key known when the plan is made."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def hash_embedding(text: Column, dim: int = 16) -> Column:
    """A deterministic vector: bytes of the text's SHA-256 over 255."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(digest.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
