"""Word sequences of whole texts as arrays of 64-bit hashes, and their exchange by hash.

Words are runs of other bytes than the ASCII white space (space and 0x09-0x0D).
A word's hash is a polynomial over its bytes, a window's one over its words'
hashes; both come from running sums, modulo 2**64, so every window of a text
costs a few array operations, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, np.int8)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = 0
#: Bytes hashed at a time; a text is only cut between words.
SEGMENT = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    bits = max(20, (n - 1).bit_length())
    return _powers(bits) if bits <= 21 else _powers.__wrapped__(bits)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` values, by start."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    return mixed((total[length:] - total[:-length]) * down[:n])


def _segment(raw: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(_IS_WORD[raw], prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[raw] * up[: len(raw)], dtype=np.uint64)])
    return mixed((total[ends] - total[starts]) * down[starts])


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word of a text, in order."""
    if len(raw) <= 2 * SEGMENT:
        return _segment(np.frombuffer(raw, np.uint8))
    data, parts, at = np.frombuffer(raw, np.uint8), [], 0
    while at < len(data):
        to = min(len(data), at + SEGMENT)
        while to < len(data) and _IS_WORD[data[to]]:
            to += 1
        parts.append(_segment(data[at:to]))
        at = to
    return np.concatenate(parts)


def word_hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    """As ``word_hashes`` of each, texts of moderate length hashed together."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            joined = np.frombuffer(b"\n".join(group), np.uint8)
            hashes = _segment(joined)
            lengths = np.array([len(t) + 1 for t in group])
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            starts = np.flatnonzero(np.diff(_IS_WORD[joined], prepend=np.int8(0)) == 1)
            out.extend(np.split(hashes, np.searchsorted(starts, begins[1:])))
            group.clear()
            size = 0

    for text in texts:
        if len(text) > SEGMENT:
            flush()
            out.append(word_hashes(text))
            continue
        if size + len(text) > SEGMENT:
            flush()
        group.append(text)
        size += len(text) + 1
    flush()
    return out


def even_keys(spark: SparkSession) -> list[int]:
    """For each shuffle partition an integer that Spark's hash partitioning sends to it."""
    n = shuffle_partitions(spark)
    key = F.col("id").cast("int").alias("key")
    rows = spark.range(24 * n + 64).select(key, F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("key").alias("key")).collect()
    return sorted(r["key"] for r in rows)


#: One row holds what one batch of documents sends to one bucket of hashes.
PACKET = "bucket int, ids binary, docs binary, hashes binary"
#: One row holds what a bucket answers to one group of documents.
_ANSWER = "grp int, ids binary, counts binary, hashes binary"


def bounds(n: int) -> np.ndarray:
    """Where each of n equal ranges of 64-bit hashes begins, but for the first."""
    return (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)


def short(hashes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Bucket and low 32 bits of each hash: what a packet of narrow width keeps of it."""
    to = buckets[np.searchsorted(bounds(len(buckets)), hashes, side="right")].astype(np.uint64)
    return to << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def packets(ids: np.ndarray, hashes: list[np.ndarray], buckets: np.ndarray, width: str = "<u8") -> pa.RecordBatch:
    """Packets of a batch: ``hashes[i]`` are distinct and belong to document ``ids[i]``. A bucket is a range of hashes;
    ``width`` "<u4" sends the low 32 bits, which the bucket completes as far as a filter needs."""
    doc = np.repeat(np.arange(len(hashes), dtype=np.uint32), [len(h) for h in hashes])
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    by = np.argsort(every, kind="stable")
    every, doc = every[by], doc[by]
    to = np.searchsorted(every, bounds(len(buckets)))
    rows: list[tuple] = []
    for b, (part, whose) in enumerate(zip(np.split(every, to), np.split(doc, to), strict=True)):
        if len(part):
            order = np.argsort(whose, kind="stable")  # by document, so that the numbers repeat and compress
            present, number = np.unique(whose[order], return_inverse=True)
            rows.append((int(buckets[b]), ids[present].tobytes(), number.astype(np.uint16 if len(present) < 1 << 16 else np.uint32).tobytes(), part[order].astype(width).tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "ids", "docs", "hashes"])


def unpacked(rows: pa.Table, width: str) -> tuple[np.ndarray, np.ndarray]:
    """(document id, hash) of all entries of a bucket."""
    ids, hashes = [np.zeros(0, np.int64)], [np.zeros(0, width)]
    for i, d, h in zip(*(rows[c].to_pylist() for c in ("ids", "docs", "hashes")), strict=True):
        values = np.frombuffer(h, width)
        ids.append(np.frombuffer(i, np.int64)[np.frombuffer(d, np.uint16 if len(d) == 2 * len(values) else np.uint32)])
        hashes.append(values)
    return np.concatenate(ids), np.concatenate(hashes).astype(np.uint64)


def _by_document(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct ids in order, and the distinct hashes of each."""
    by = np.lexsort((hashes, ids))
    ids, hashes = ids[by], hashes[by]
    new = np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(hashes) != 0)]) if len(ids) else np.zeros(0, bool)
    ids, hashes = ids[new], hashes[new]
    own, starts = np.unique(ids, return_index=True)
    return own, np.split(hashes, starts[1:]) if len(own) else []


def exchanged(sent: DataFrame, answer: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], buckets: np.ndarray, width: str = "<u8") -> DataFrame:
    """Brings the packets of each bucket together and returns (doc_id, hashes): for each document those of its hashes
    that ``answer(bucket, ids, hashes)`` picks. Answers travel packed, a row a bucket and group of documents."""
    def answered(rows: pa.Table) -> pa.Table:
        ids, hashes = answer(rows["bucket"][0].as_py(), *unpacked(rows, width))
        own, parts = _by_document(ids, hashes)
        group = (mixed(own.astype(np.uint64)) % np.uint64(len(buckets))).astype(np.int64)
        out = []
        for g in np.unique(group).tolist():
            here = np.flatnonzero(group == g).tolist()
            out.append((int(buckets[g]), own[here].tobytes(), np.array([len(parts[i]) for i in here], np.int32).tobytes(), np.concatenate([parts[i] for i in here]).astype("<u8").tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({"grp": pa.array(cols[0], pa.int32()), "ids": pa.array(cols[1], pa.binary()), "counts": pa.array(cols[2], pa.binary()), "hashes": pa.array(cols[3], pa.binary())})

    def opened(rows: pa.Table) -> pa.Table:
        ids = [np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.int32)) for i, c in zip(rows["ids"].to_pylist(), rows["counts"].to_pylist(), strict=True)]
        own, parts = _by_document(np.concatenate(ids), np.frombuffer(b"".join(rows["hashes"].to_pylist()), "<u8"))
        return pa.table({"doc_id": pa.array(own, pa.int64()), "found": pa.array([p.tobytes() for p in parts], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(answered, _ANSWER).groupBy("grp").applyInArrow(opened, "doc_id long, found binary")


def gathered(found: bytes) -> np.ndarray:
    return np.frombuffer(found, "<u8")
