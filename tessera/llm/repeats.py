"""Substring dedup by fixed-block anchors.

Each document is a reference through its non-overlapping blocks of ``BLOCK``
words, and a probe through all its rolling windows of that many words. Any
window of ``WINDOW`` >= 2 * BLOCK words holds a whole block wherever it starts,
so a shared window always shows as a hit of a probe on a block. Around each hit
the window of full length is moved word by word over all positions that hold
the hit; those whose sequence a document of smaller id holds too are repeats,
and adjoining ones are merged to the maximal exact repeat.

Two exchanges by hash do this: blocks with probes (four bytes a probe, and a
bucket; a false hit only costs work), then the full windows around hits. Each keeps one number a hash, the smallest id, so a
passage that n documents share costs n entries and no pairs. Documents that
share nothing send their probes only. Equality is that of 64-bit hashes.

Rows with a null id are left as they are and remove nothing; a null text has
no words; texts of fewer words than a window are left as they are; rows that
repeat an id don't affect each other; an empty table gives no rows. Other
columns are kept where the documents are returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rolling
from tessera.llm.common import slices

WINDOW = 50
_BATCH = 2_000_000  # bytes of text whose probes are sent together


def _anchors(bucket: int, ids: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that a block of one document and a probe of a document of larger id have in common."""
    block, hashes = (entries & np.uint64(1)).astype(bool), entries >> np.uint64(1) << np.uint64(1)
    blocks, first = _extreme(hashes[block], ids[block], smallest=True)
    at = np.searchsorted(blocks, hashes)
    at[at == len(blocks)] = 0
    known = blocks[at] == hashes if len(blocks) else np.zeros(len(hashes), bool)
    hit = known & ~block
    hit[hit] = first[at[hit]] < ids[hit]
    used, last = _extreme(hashes[hit], ids[hit], smallest=False)
    of = np.searchsorted(used, hashes)
    of[of == len(used)] = 0
    held = block & (used[of] == hashes if len(used) else False)
    held[held] = last[of[held]] > ids[held]
    both = hit | held
    return ids[both], hashes[both] | np.uint64(bucket) << np.uint64(32)


def _extreme(hashes: np.ndarray, ids: np.ndarray, smallest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the smallest or largest id of each."""
    by = np.lexsort((ids, hashes))
    hashes, ids = hashes[by], ids[by]
    edge = hashes[1:] != hashes[:-1]
    keep = np.concatenate([[True], edge]) if smallest else np.concatenate([edge, [True]])
    return (hashes[keep], ids[keep]) if len(hashes) else (hashes, ids)


def _later(bucket: int, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that a document of smaller id holds too."""
    known, first = _extreme(hashes, ids, smallest=True)
    later = ids > first[np.searchsorted(known, hashes)] if len(ids) else np.zeros(0, bool)
    return ids[later], hashes[later]


def _anchor_hashes(words: np.ndarray, block: int) -> np.ndarray:
    """Hashes of the runs of a block's length; the lowest bit is free to tell blocks from probes."""
    return rolling.windows(words, block) >> np.uint64(1) << np.uint64(1)


def around(hits: np.ndarray, n_words: int, block: int, window: int) -> np.ndarray:
    """Starts of the windows that hold a hit, given the hits' starts."""
    edge = np.zeros(n_words + 2, np.int64)
    np.add.at(edge, np.maximum(hits - (window - block), 0), 1)
    np.add.at(edge, hits + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, n_words - window + 1)] > 0)


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words the windows at ``starts`` cover."""
    edge = np.zeros(n_words + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n_words] > 0


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(own_id, own_text, rest), ``rest`` having every other column: as both joins with the documents take all three, and
    under names that are no column's own, they share one exchange of the texts."""
    return docs.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).cast("string").alias("own_text"), F.struct(*[c for c in docs.columns if c != text_col]).alias("rest"))


def _with_repeats(keyed: DataFrame, window: int) -> DataFrame:
    """``keyed`` and ``found``: hashes of the windows that a document of smaller id holds too."""
    if window < 2:
        raise ValueError("a window has two words at least")
    block = window // 2
    buckets = np.array(rolling.even_keys(keyed.sparkSession))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "own_text", _BATCH):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows, sent = [], []
            for i, words in enumerate(rolling.word_hashes_of(texts)):
                if len(words) >= window:
                    hashes = _anchor_hashes(words, block)
                    rows.append(i)
                    sent.append(np.unique(np.concatenate([hashes, hashes[::block] | np.uint64(1)])))
            yield rolling.packets(ids[rows], sent, buckets, "<u4")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "own_text", _BATCH):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sent = []
            for words, found in zip(rolling.word_hashes_of(texts), batch.column(3).to_pylist(), strict=True):
                hits = np.flatnonzero(np.isin(rolling.short(_anchor_hashes(words, block), buckets), rolling.gathered(found)))
                sent.append(np.unique(rolling.windows(words, window)[around(hits, len(words), block, window)]))
            yield rolling.packets(batch.column(0).to_numpy(zero_copy_only=False), sent, buckets)

    known = keyed.where("own_id is not null")
    anchors = rolling.exchanged(known.select("own_id", "own_text").mapInArrow(probes, rolling.PACKET), _anchors, buckets, "<u4").withColumnRenamed("doc_id", "own_id")
    near = known.join(anchors, "own_id").select("own_id", "own_text", "rest", "found")
    later = rolling.exchanged(near.mapInArrow(full, rolling.PACKET), _later, buckets).withColumnRenamed("doc_id", "own_id")
    rest = keyed.where("own_id is null").withColumn("found", F.lit(None).cast("binary"))
    return known.join(later, "own_id", "left").select("own_id", "own_text", "rest", "found").unionByName(rest)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: doc_id, n_words, n_removed, ``kept`` (the words kept, joined by spaces)
    and ``spans`` (the maximal repeats: first word, word after the last)."""
    whole = _with_repeats(_keyed(docs.select(id_col, text_col), id_col, text_col), window)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "own_text", _BATCH):
            sizes, gone, kept, spans = [], [], [], []
            for text, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                sizes.append(len(words))
                if not found or not words:
                    gone.append(0)
                    kept.append(b" ".join(words))
                    spans.append([])
                    continue
                starts = np.flatnonzero(np.isin(rolling.windows(rolling.word_hashes(text), window), rolling.gathered(found)))
                cover = covered(starts, len(words), window)
                gone.append(int(cover.sum()))
                kept.append(b" ".join(itertools.compress(words, (~cover).tolist())))
                edges = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return whole.mapInArrow(removed, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: bigint, end: bigint>>")


def rewritten(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The documents with their repeats taken out of their texts, all columns kept; those of which no word is left go."""
    whole = _with_repeats(_keyed(docs, id_col, text_col), window).select("own_text", "found", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "own_text", _BATCH):
            texts, keep = [], []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found and text:
                    raw = text.encode()
                    starts = np.flatnonzero(np.isin(rolling.windows(rolling.word_hashes(raw), window), rolling.gathered(found)))
                    words = raw.split()
                    if len(starts):
                        text = b" ".join(itertools.compress(words, (~covered(starts, len(words), window)).tolist())).decode()
                    keep.append(bool(text))
                else:
                    keep.append(True)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], ["text", "rest"]).filter(pa.array(keep, pa.bool_()))

    rest_type = whole.schema["rest"].dataType.simpleString()
    out = whole.mapInArrow(run, f"text string, rest {rest_type}")
    out = out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col in docs.columns else out
