"""Secret scanning: fixed patterns, and novelty measured with a dictionary-primed zstandard compressor.

The patterns give the base spans. The method adds strings that stand in a
sensitive context (a word such as ``key`` or ``bearer`` within ``CONTEXT``
characters before them, or a string in such a context within ``CARRY``, so that
all lines of a private key and all parts of a dotted token are in it) and are
incompressible there: the compressor is primed with a dictionary of identifiers
and code and with the text around the candidate, and the candidate's marginal
size is what the frame grows by when it is appended. Words of the dictionary,
paths and repeated identifiers cost a few bytes; random strings cost nearly as
many as they have. Which characters a string has doesn't count: a long word or
number that its surroundings don't hold is novel too.

Nothing is shuffled. Nulls: a null text counts as an empty one, without spans;
null ids and repeated rows are kept; an empty table gives no rows; other
columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "novel")
NOVELTY = 0.75  # marginal bytes for each byte of the candidate
LEAST_CHARS = 16
CONTEXT = 256  # characters before a candidate in which a sensitive word must stand
CARRY = 32  # characters from a candidate in sensitive context to the next one, which is then in it as well
SURROUNDINGS = 1024  # characters on either side that prime the compressor

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
#: The last line of an armoured block where it is too short for a candidate; it is measured with the line before it.
_REST = re.compile(r"""(?:[\s"'+,>|#*]|\\[nr]){1,%d}[A-Za-z0-9+/=]{1,%d}(?=(?:[\s"'+,>|#*]|\\[nr])+-----END)""" % (CARRY, LEAST_CHARS - 1))
_SENSITIVE = re.compile(r"(?ai:key|secret|token|passw|pwd|credential|bearer|authori[sz]ation|private|signature|session|cookie|salt|nonce|pin\b)")

#: What commonly surrounds credentials without being one.
DICTIONARY = (
    "api_key apikey access_key secret_key private_key public_key client_id client_secret access_token refresh_token id_token session_id authorization bearer basic "
    "password passwd username user_name account_id database_url connection_string endpoint hostname localhost certificate signature checksum encoding utf-8 base64 "
    "aws_access_key_id aws_secret_access_key aws_session_token github_token slack_token google_application_credentials azure_storage_account ssh-rsa ssh-ed25519 "
    "-----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- -----BEGIN CERTIFICATE----- Content-Type: application/json Authorization: Bearer https://www.example.com/ "
    "import os import sys from config import settings os.environ.get(getenv export const let var static public private protected final string return function class "
    "def __init__(self, config): if name == None: raise ValueError self.client = Client( request.headers response.json() true false null undefined placeholder "
    "changeme your_api_key_here your-secret-key xxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
).encode()


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes of the candidate for each of its bytes."""
    near = (before + "\n" + after).encode()
    primer = zstandard.ZstdCompressionDict(DICTIONARY + near, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_dict_id=False)
    base = DICTIONARY[:64]
    data = candidate.encode()
    return (len(compressor.compress(base + data)) - len(compressor.compress(base))) / len(data)


class Taken:
    """Whether spans meet any of a fixed set: one bisection a question."""

    def __init__(self, spans: list[tuple]) -> None:
        ordered = sorted((start, end) for _, start, end, *_ in spans)
        self.starts = [start for start, _ in ordered]
        self.furthest = list(accumulate((end for _, end in ordered), max))  # of the spans that start up to here

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.furthest[before - 1] > start


def spans_of(text: str, least: float = NOVELTY) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, novelty) by start, then kind; ends are exclusive, in code points."""
    found: list[tuple[str, int, int, float | None]] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span(), None) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span(), None) for m in _HEX.finditer(text)]
    taken = Taken(found)
    carried = -CARRY - 1  # the end of the last candidate in sensitive context
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        before = text[max(0, start - SURROUNDINGS) : start]
        if start - carried > CARRY and not _SENSITIVE.search(before, max(0, len(before) - CONTEXT)):
            continue
        carried = end
        if rest := _REST.match(text, end):
            end = rest.end()
        if taken.meets(start, end):
            continue
        measured = novelty(text[start:end], before, text[end : end + SURROUNDINGS])
        if measured >= least:
            found.append(("novel", start, end, measured))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
_SPANS_SQL = "array<struct<kind: string, start: bigint, end: bigint, novelty: double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NOVELTY) -> DataFrame:
    """One row for each row: its id and its spans."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            spans = [[dict(zip(("kind", "start", "end", "novelty"), s, strict=True)) for s in spans_of(t or "", least)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans {_SPANS_SQL}")


def redacted(text: str, spans: list[tuple[str, int, int, float | None]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", least: float = NOVELTY) -> DataFrame:
    """All rows and columns of ``docs``, secrets in their texts replaced; ``count_col`` counts anew where it is there."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = [None if t is None else redacted(t, s) if (s := spans_of(t, least)) else t for t in batch.column(at).to_pylist()]
            columns = [*batch.columns]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col in names else out
