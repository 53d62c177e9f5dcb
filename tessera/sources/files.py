"""Reading delimited files: encoding, delimiter, header, ragged rows; file kinds and addresses."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")
SIGNATURES = (("pdf", b"%PDF-"), ("png", b"\x89PNG"), ("jpeg", b"\xff\xd8\xff"), ("gif", b"GIF8"), ("zip", b"PK\x03\x04"))  # fixed values


def encoding_of(head: bytes) -> str:
    """utf-8, or utf-8-sig after its mark; UTF-16 is refused."""
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        raise ValueError("UTF-16 files are not supported")
    return "utf-8-sig" if head.startswith(b"\xef\xbb\xbf") else "utf-8"


def delimiter_of(lines: list[str]) -> str:
    """That of the widest header with the most body rows as wide; a comma where there is one column."""
    best = (1, -1, ",")
    for d in DELIMITERS:
        rows = list(csv.reader(lines[:20], delimiter=d))
        width = len(rows[0]) if rows else 0
        best = max(best, (width, sum(len(r) == width for r in rows[1:]), d), key=lambda b: b[:2]) if width > 1 else best
    return best[2]


def header_names(raw: list[str]) -> list[str]:
    """Blank names become column_N, repeated ones get .2, .3 and so on."""
    names: list[str] = []
    counts: dict[str, int] = {}
    for i, name in enumerate(raw, 1):
        name = re.sub(r"^_+|_+$", "", re.sub(r"_+", "_", re.sub(r"[^a-z0-9_.\-]", "_", re.sub(r"\s+", "_", name.strip().lower())))) or f"column_{i}"
        counts[name] = counts.get(name, 0) + 1
        while counts[name] > 1 and f"{name}.{counts[name]}" in names:
            counts[name] += 1
        names.append(name if counts[name] == 1 else f"{name}.{counts[name]}")
    return names


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All values as text, with ``missing_fields``, ``extra_values`` and the ``extra`` values of each row. Only the head is
    read to plan. UTF-16 is refused, and so is a value with bytes that are no UTF-8 (or with U+FFFD, which stands for such)."""
    first = spark.read.format("binaryFile").load(path).select("path").first()["path"]  # type: ignore[index]
    head = [r["value"] for r in spark.read.text(first).limit(20).collect()]
    if not head:
        return spark.createDataFrame([], "missing_fields int, extra_values int, extra array<string>")
    if any("\x00" in line for line in head):
        raise ValueError("UTF-16 files are not supported")
    head[0] = head[0].removeprefix("\ufeff")
    d = delimiter_of(head)
    names = header_names(next(csv.reader(io.StringIO(head[0]), delimiter=d)))
    n = len(names)
    schema = ", ".join(f"`c{i}` string" for i in range(n)) + ", `record` string"
    raw = spark.read.csv(path, sep=d, header=True, multiLine=True, escape='"', schema=schema, mode="PERMISSIVE", enforceSchema=True, nullValue="\x00", emptyValue="", columnNameOfCorruptRecord="record")
    width = F.greatest(F.lit(0), *[F.col(f"c{i}").isNotNull().cast("int") * (i + 1) for i in range(n)])
    # a record that is not as wide as the header comes whole besides; what lies beyond the header is cut out of it
    one = re.escape(d)
    cells = F.regexp_extract_all("record", F.lit(f'(?:^|{one})("(?:[^"]|"")*"|[^{one}]*)'), F.lit(1))
    whole = F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))
    extra = F.when(F.size(whole) > n, F.slice(whole, n + 1, F.greatest(F.lit(1), F.size(whole) - n))).otherwise(F.array().cast("array<string>"))
    extra = F.coalesce(extra, F.array().cast("array<string>"))

    def sound(c: Column) -> Column:
        return F.when(F.contains(c, F.lit("\ufffd")), F.raise_error(F.lit("a value is not valid UTF-8"))).otherwise(c)

    values = [sound(F.col(f"c{i}")).alias(x) for i, x in enumerate(names)]
    return raw.where(width > 0).select(*values, (F.lit(n) - width).alias("missing_fields"), F.size(extra).alias("extra_values"), extra.alias("extra"))


def file_kind(content: Column, name: Column) -> Column:
    """By signature; text is told apart by its name. A signature that the name contradicts is a mismatch."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    ladder = None
    for kind, magic in SIGNATURES:
        hit = F.hex(F.substring(content, 1, len(magic))) == magic.hex().upper()
        ladder = F.when(hit, kind) if ladder is None else ladder.when(hit, kind)
    found = ladder.otherwise(F.when(ext.isin("csv", "tsv", "txt", "json"), ext))
    same = (found == ext) | ((found == "jpeg") & (ext == "jpg")) | ((found == "zip") & ext.isin("docx", "xlsx"))
    return F.when(found.isNull(), "unknown").when(~same, "mismatch").otherwise(found)


def payload_kind(body: Column) -> Column:
    """json, xml, html, text or empty, by structure."""
    text = F.btrim(body)
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(F.try_parse_json(text).isNotNull() & text.rlike(r"^[\[{]"), "json").when(text.rlike(r"(?i)^<(!doctype html|html)"), "html").when(text.startswith("<"), "xml").otherwise("text")


def url_verdict(url: Column, allowed_hosts: tuple[str, ...] = ()) -> Column:
    """The first rule that an address breaks, or ALLOWED."""
    host, scheme = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    out = (
        F.when(scheme.isNull() | host.isNull(), "MALFORMED").when(~scheme.isin("http", "https"), "SCHEME").when(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), "CREDENTIALS")
        .when(host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.)"), "PRIVATE_HOST").when((port != "") & ~port.isin("80", "443"), "PORT")
    )
    return (out.when(~host.isin(*allowed_hosts), "NOT_LISTED") if allowed_hosts else out).otherwise("ALLOWED")


def url_redacted(url: Column) -> Column:
    """Scheme, host and path; no credentials, query or fragment."""
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
