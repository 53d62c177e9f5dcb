"""Packing by power-of-two decomposition.

A document of L ids is cut from its start into pieces whose lengths are the
binary digits of L: as many whole sequences of ``max_length`` as fit, then one
piece for each set bit of the rest, longest first. Every piece is a sequence of
its own, so no sequence crosses documents and none needs padding; sequences of
equal length form one bucket, from which a trainer draws its batches.

Nothing is shuffled: each row is cut where it is read.

Nulls and ties: a null text counts as an empty one and yields the end id
alone; a null id is kept; repeated rows are packed once each; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices
from tessera.llm.tokens import CACHE_WORDS, encoder

MAX_LENGTH = 2048


def binary_lengths(total: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of a document of ``total`` ids: powers of two, in falling order."""
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    whole, rest = divmod(total, max_length)
    return [max_length] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, remembered: int = CACHE_WORDS) -> DataFrame:
    """One row a piece: id, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32 bits),
    ``doc_tokens``, ``bucket`` (the power), ``sequence_id`` (unique) and ``offset`` (0). A worker keeps up to twice
    ``remembered`` words and their ids, for as long as it lives."""
    binary_lengths(0, max_length)
    end = end_id.to_bytes(4, "little")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, remembered).encode
        for batch in slices(batches, "text", 1_000_000):
            row, start, length, ids, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text or "") + end
                n, at = len(data) // 4, 0
                for piece in binary_lengths(n, max_length):
                    row.append(i)
                    start.append(at)
                    length.append(piece)
                    ids.append(data[4 * at : 4 * (at + piece)])
                    total.append(n)
                    at += piece
            power = [x.bit_length() - 1 for x in length]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(power, pa.int32())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"],
            )

    pieces = source.mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, bucket int")
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the sequences as one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
