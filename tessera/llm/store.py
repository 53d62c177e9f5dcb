"""A content-addressed store of token ids.

A rolling hash over the last ``WINDOW`` ids cuts each document's ids into
chunks, so an insertion moves only the cuts near it. A chunk is named by the
BLAKE2b digest of its ids and stored once, however many documents hold it. A
document is a recipe: the names of its chunks in order. Recipes lie in files in
ascending order of their ids, ``PART_DOCS`` or so in each at most. A recipe's
leaf is the name of all it holds: id, start, count and chunk names; each file
has the Merkle root of its leaves in the manifest, whose own root stands for the
whole store. Reading makes the leaves anew from the recipes and refuses a store
whose roots differ.

Layout under the store's path: ``objects/kind=chunk`` (chunk_id, payload),
``recipes`` (doc_id, start, n_tokens, chunk_ids, part) and ``manifest``
(part, n_docs, n_tokens, root, store_root).

Scale: one shuffle moves each task's distinct chunks by their names; all else
moves names and counts only. Reading back checks every chunk against its name
and combines the checksums of chunks to those of documents, so payloads do not
move again.

Nulls and ties: a null text counts as an empty one and holds the end id alone;
null ids come first; rows that repeat an id are kept, ordered by content; an
empty table gives an empty store; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import new_path, shuffle_partitions, slices, written
from tessera.llm.tokens import encoder

WINDOW, LEAST, MOST, MASK = 16, 128, 2048, 511
#: Names a task remembers to send a chunk once; more only cost repeated rows, which the store drops.
SEEN = 200_000
#: Documents in a file of recipes, about; a file's leaves of 16 bytes meet in one row.
PART_DOCS = 100_000
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 1 << 16, dtype=np.uint64).astype(np.uint32)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of ``ids``: where the rolling hash has its low bits clear, LEAST to MOST ids apart."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    rolling = _GEAR[ids & 0xFFFF]
    k = 1
    while k < WINDOW:  # twice as many ids in each step
        rolling[k:] = rolling[k:] + (rolling[:-k] << np.uint32(2 * k))
        k *= 2
    ends, last = [], 0
    for at in np.flatnonzero((rolling >> np.uint32(16)) & np.uint32(MASK) == 0) + 1:
        at = int(at)
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def squeezed(ids: np.ndarray) -> tuple[bytes, bytes, int]:
    """A mark, ids in 16 bits each where they all fit, and the bytes that one takes."""
    return (b"\x02", ids.astype("<u2").tobytes(), 2) if not len(ids) or ids.max() < 1 << 16 else (b"\x04", ids.tobytes(), 4)


def opened(payload: bytes) -> bytes:
    return np.frombuffer(payload, "<u2", offset=1).astype("<u4").tobytes() if payload[:1] == b"\x02" else payload[1:]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd one is carried up."""
    level = leaves or [name_of(b"")]
    while len(level) > 1:
        level = [name_of(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _times(matrix: list[int], vector: int) -> int:
    total = 0
    while vector:
        low = vector & -vector
        total ^= matrix[low.bit_length() - 1]
        vector ^= low
    return total


@cache
def _doubling(k: int) -> tuple[tuple[int, ...], tuple[list[int], ...]]:
    """What 2**k more ids of four bytes do to a CRC-32: the matrix over its bits, and tables by byte."""
    if k:
        half = _doubling(k - 1)[0]
        matrix = tuple(_times(half, x) for x in half)
    else:
        matrix = (0xEDB88320, *(1 << i for i in range(31)))
        for _ in range(5):  # from one bit to 32
            matrix = tuple(_times(matrix, x) for x in matrix)
    return matrix, tuple([_times(matrix, b << 8 * byte) for b in range(256)] for byte in range(4))


def combined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation, from each part's CRC-32 and its number of ids."""
    crc = 0
    for part, n in parts:
        k = 0
        while n:
            if n & 1:
                a, b, c, d = _doubling(k)[1]
                crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]
            n >>= 1
            k += 1
        crc ^= part
    return crc


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every row's whole text, appends ``end_id`` and writes the store to ``path``."""
    spark = docs.sparkSession
    end = np.array([end_id], "<u4")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"kind string, name binary, payload binary, doc_id {id_type}, n_tokens long, chunk_ids array<binary>"

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, seen = encoder(tokenizer).encode_all, set()
        for batch in slices(batches, "text"):
            names, payloads, totals, recipes = [], [], [], []
            for ids in encode_all(batch.column(1).to_pylist()):
                ids = np.concatenate([ids, end])
                data = ids.tobytes()
                mark, short, width = squeezed(ids)
                last, recipe = 0, []
                for to in cuts(ids):
                    part = data[4 * last : 4 * to]
                    recipe.append(name := name_of(part))
                    if name not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        names.append(name)
                        payloads.append(mark + short[width * last : width * to])
                    last = to
                totals.append(last)
                recipes.append(recipe)
            n, m = len(names), len(recipes)
            leaves = [name_of(b"".join(r)) for r in recipes]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["chunk"] * n + ["recipe"] * m, pa.string()), pa.array(names + leaves, pa.binary()), pa.array(payloads + [None] * m, pa.binary()),
                    pa.concat_arrays([pa.nulls(n, batch.schema.field(0).type), batch.column(0)]), pa.array([None] * n + totals, pa.int64()), pa.array([None] * n + recipes, pa.list_(pa.binary())),
                ],
                ["kind", "name", "payload", "doc_id", "n_tokens", "chunk_ids"],
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a name are in this partition; the first chunk of each name stays, and every recipe."""
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for kind, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(kind == "recipe" or name not in seen)
                if kind == "chunk":
                    seen.add(name)
            yield batch.filter(pa.array(keep, pa.bool_()))

    # recipes of equal documents share a name, so they are dealt out by a salt of their row besides
    salted = source.mapInArrow(chunked, schema).withColumn("salt", F.when(F.col("kind") == "recipe", F.monotonically_increasing_id()))
    dealt = salted.repartition(shuffle_partitions(spark), "name", "salt").drop("salt")
    dealt.mapInArrow(once, schema).write.option("compression", "snappy").option("parquet.enable.dictionary", "false").partitionBy("kind").parquet(f"{path}/objects")

    objects = spark.read.schema(f"name binary, payload binary, doc_id {id_type}, n_tokens long, chunk_ids array<binary>, kind string").parquet(f"{path}/objects")
    recipes = objects.where("kind = 'recipe'").select("doc_id", F.col("name").alias("leaf"), "n_tokens", "chunk_ids", F.monotonically_increasing_id().alias("row"))
    by = ["doc_id", "leaf", "row"]
    n_parts = max(1, shuffle_partitions(spark) // 4, -(-recipes.count() // PART_DOCS))
    ordered = written(recipes.repartitionByRange(n_parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()), "recipes")
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))  # one row a part: as many as there are files
    before = {r["part"]: r["part_tokens"] for r in sums.collect()}
    offsets, total = [], 0
    for part in sorted(before):
        offsets.append((part, total))
        total += before[part]
    base = spark.createDataFrame(offsets, "part int, base long")
    running = F.sum("n_tokens").over(W.partitionBy("part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1))
    placed = ordered.withColumn("inner", F.coalesce(running, F.lit(0))).join(F.broadcast(base), "part")
    placed.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "chunk_ids", "part").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _write_manifest(spark, path)


def _part_roots(recipes: DataFrame) -> DataFrame:
    """One row a part: counts, and the root of the leaves that its recipes give."""
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(*(batch.column(i).to_pylist() for i in (3, 1, 2, 4)), strict=True)
            leaves = [name_of(b"".join([f"{doc_id}\0{start}\0{n}\0".encode(), *(ids or [])])) for doc_id, start, n, ids in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leaves, pa.binary())], ["part", "start", "n_tokens", "leaf"])

    leaves = recipes.select("part", "start", "n_tokens", "doc_id", "chunk_ids").mapInArrow(named, "part int, start long, n_tokens long, leaf binary")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("start", "leaf"))), lambda x: x["leaf"])
    parts = leaves.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), in_order.alias("leaves"))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([merkle_root(x) for x in batch.column(3).to_pylist()], pa.binary())], ["part", "n_docs", "n_tokens", "root"])

    return parts.mapInArrow(roots, "part int, n_docs long, n_tokens long, root binary")


def _write_manifest(spark: SparkSession, path: str) -> None:
    rows = sorted(_part_roots(spark.read.parquet(f"{path}/recipes")).collect(), key=lambda r: r["part"])  # one row a file
    root = merkle_root([bytes(r["root"]) for r in rows])
    spark.createDataFrame([(*r, bytearray(root)) for r in rows], "part int, n_docs long, n_tokens long, root binary, store_root binary").coalesce(1).write.parquet(f"{path}/manifest")


def verify_manifest(spark: SparkSession, path: str) -> bool:
    """Whether the recipes as they lie there give the counts and roots that the manifest holds."""
    held = {r["part"]: (r["n_docs"], r["n_tokens"], bytes(r["root"]), bytes(r["store_root"])) for r in spark.read.parquet(f"{path}/manifest").collect()}
    found = {r["part"]: (r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in _part_roots(spark.read.parquet(f"{path}/recipes")).collect()}
    root = merkle_root([found[k][2] for k in sorted(found)])
    return held.keys() == found.keys() and all(held[k] == (*found[k], root) for k in found)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name binary, payload binary, kind string").parquet(f"{path}/objects").where("kind = 'chunk'").select(F.col("name").alias("chunk_id"), "payload")


def chunk_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, n_ids, crc) of every stored chunk, read and checked against its name."""
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = [], []
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = opened(payload)
                if name_of(data) != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
                sizes.append(len(data) // 4)
                sums.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(sums, pa.int64())], ["chunk_id", "n_ids", "crc"])

    return _chunks(spark, path).mapInArrow(checked, "chunk_id binary, n_ids int, crc long")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    # a stream position belongs to one document, for each holds its end id
    return spark.read.parquet(f"{path}/recipes").select("start", F.posexplode("chunk_ids").alias("at", "chunk_id"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Reads the store back, its recipes checked against the manifest first: each document's id, start, number of ids and their CRC-32."""
    if not verify_manifest(spark, path):
        raise ValueError("the recipes do not give the roots that the manifest holds")
    recipes = spark.read.parquet(f"{path}/recipes")
    found = _entries(spark, path).join(chunk_checksums(spark, path), "chunk_id", "left")
    lists = found.groupBy("start").agg(F.sum("n_ids").alias("n_read"), F.array_sort(F.collect_list(F.struct("at", "crc", "n_ids"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [combined_crc([(p["crc"], p["n_ids"]) for p in parts]) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], ["start", "n_read", "ids_crc32"])

    sums = lists.mapInArrow(joined, "start long, n_read long, ids_crc32 long")
    whole = recipes.select("doc_id", "start", "n_tokens").join(sums, "start", "left")
    agrees = F.coalesce(F.col("n_read") == F.col("n_tokens"), F.lit(False))
    return whole.select("doc_id", "start", F.when(agrees, F.col("n_read")).otherwise(F.raise_error(F.lit("a document's chunks are not all there"))).alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Reads whole documents back: id, start and ``ids`` (array of int)."""
    found = _entries(spark, path).join(_chunks(spark, path), "chunk_id")
    lists = found.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(opened(p["payload"]) for p in parts), "<u4").astype(np.int32) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["start", "ids"])

    return spark.read.parquet(f"{path}/recipes").select("doc_id", "start").join(lists.mapInArrow(joined, "start long, ids array<int>"), "start").select("doc_id", "start", "ids")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    path = new_path(docs.sparkSession, "store")
    write_store(docs, path, tokenizer, end_id)
    return read_checksums(docs.sparkSession, path)
