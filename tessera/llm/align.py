"""Alignment of two tokenizers over the same bytes.

A byte-level vocabulary (A) and a piece model (B) cut the same bytes, a space
and then the text, each in its own way. Two pointers merge the cumulative ends
of their tokens: where both end at the same byte a group closes, and each end
of either side closes one link, the pair of tokens that covers the bytes before
it. The pointers of a whole slice of texts move at once, as a merge of two
sorted arrays, inside ``mapInPandas``.

Spark counts the pairs and finds each side's highest count. Both come back to
the documents by slice: a slice has a row for each different pair it holds, so
that a pair of frequent tokens has as many rows as there are slices, not as
many as there are links, and a document keeps its links as positions in its
slice's pairs. The documents and pairs of a slice then meet in one cogroup,
whose size the slice bounds.

Nulls and ties: a text that is null or empty, or whose tokens of A or B do not
join to the space and the text (a literal U+2581 becomes a space in B), has no
tokens: zeros and the empty string. Strings of special tokens are plain text.
Pairs that share the highest count of an id are all best. Null ids and repeated
rows are kept, a row for a row; an empty table gives no rows; other columns of
the input are ignored. A text longer than a slice is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import new_path, written
from tessera.llm.tokens import CACHE_LENGTH, Encoder, _Words, byte_alphabet

#: Bytes of text in a slice, about.
SLICE = 2_000_000
#: Words that a worker remembers of each side, in each of two generations.
CACHED = 200_000
_NONE = np.zeros(0, np.int64)


class ByteSide:
    """Ids by a byte-level vocabulary, every special token's string as plain text; bytes of each id."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.cached = Encoder(path)
        self.cached.words.most = CACHED
        back = {c: b for b, c in byte_alphabet().items()}
        vocabulary = self.plain.get_vocab()
        self.bytes_of = np.full(max(vocabulary.values()) + 1, b"", object)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        odd = [any(s in t for s in self.cached.special) for t in texts]
        out = self.cached.encode_all([None if o else t for t, o in zip(texts, odd, strict=True)])
        return [np.array(self.plain.encode(t, add_special_tokens=False).ids, "<u4") if o else ids for t, o, ids in zip(texts, odd, out, strict=True)]


class PieceSide:
    """Ids by a SentencePiece BPE model, which puts a space before a text; bytes of each id.

    No piece holds a space but at its start, so words between isolated spaces have
    the same ids wherever they stand, and each different one is encoded once.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes_of = np.full(len(pieces), b"", object)
        for i, p in enumerate(pieces):
            self.bytes_of[i] = bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
        self.words = _Words(self._word, CACHED)

    def _word(self, word: str) -> bytes:
        return np.array(self.model.encode(word), "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as if a space stood before it."""
        apart = [self.by_word and t[:1] != " " and t[-1:] not in ("", " ") and "  " not in t for t in texts]
        found = iter(self._by_word([t for t, a in zip(texts, apart, strict=True) if a]))
        return [next(found) if a else np.array(self.model.encode(t), "<u4") for t, a in zip(texts, apart, strict=True)]

    def _by_word(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids_of = list(map(self.words.get, words))
        new = []
        for i in [i for i, ids in enumerate(ids_of) if ids is None]:
            if (ids := self.words.older.get(words[i])) is None:
                new.append(i)
            else:
                ids_of[i] = ids
                self.words.keep(words[i], ids)
        for i, ids in zip(new, self.model.encode([words[i] for i in new], num_threads=1) if new else [], strict=True):
            ids_of[i] = np.array(ids, "<u4").tobytes()
            if len(words[i]) <= CACHE_LENGTH:
                self.words.keep(words[i], ids_of[i])
        sizes = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
        codes, bounds = coded.indices.to_numpy(), split.offsets.to_numpy()
        begin, count = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.cumsum(count)
        at = np.repeat(begin[codes] - (ends - count), count)
        at += np.arange(len(at))
        return np.split(np.frombuffer(b"".join(ids_of), "<u4")[at], ends[bounds[1:-1] - 1])


def _spelled(side: ByteSide | PieceSide, last: str) -> np.ndarray:
    """Decimals of each id before a comma, then before ``last``: entry 2 * id, and 2 * id + 1."""
    out = np.empty(2 * len(side.bytes_of), object)
    for i in range(len(side.bytes_of)):
        out[2 * i], out[2 * i + 1] = b"%d," % i, f"{i}{last}".encode()
    return out


class Aligner:
    """Both sides' encoders and tables; one a worker."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a, self.b = ByteSide(byte_path), PieceSide(piece_path)
        self.width_a, self.width_b = (np.fromiter(map(len, s.bytes_of), np.int64, len(s.bytes_of)) for s in (self.a, self.b))
        self.text_a, self.text_b = _spelled(self.a, "|"), _spelled(self.b, ";")

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's ids of A and B; none where either side's bytes are not the space and the text."""
        out = [(_NONE, _NONE)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in asked]
        for i, raw, a, b in zip(asked, spaced, self.a.encode_all(spaced), self.b.encode_all([texts[i] for i in asked]), strict=True):
            raw = raw.encode()
            if b"".join(self.a.bytes_of[a].tolist()) == raw and b"".join(self.b.bytes_of[b].tolist()) == raw:
                out[i] = (a.astype(np.int64), b.astype(np.int64))
        return out

    def align(self, texts: list[str | None]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """A row a text: counts, digest of the groups and ``links`` as positions in the slice's pairs; the pairs
        (A's id in the upper half) in ascending order, and the links of each."""
        found = self.tokens(texts)
        n_a, n_b = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.concatenate([x[k] for x in found] or [_NONE]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.width_a[ids_a]), np.cumsum(self.width_b[ids_b])
        at_b = np.searchsorted(ends_b, ends_a)  # where B's pointer stands when A's passes each of its ends
        both = ends_b[at_b] == ends_a
        closes_b = np.zeros(len(ids_b), bool)
        closes_b[at_b[both]] = True
        inner = np.flatnonzero(~closes_b)  # ends of B alone; the ends of A, alone or not, close a link each
        at_a = np.searchsorted(ends_a, ends_b[inner])
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)  # where each text's tokens end
        pairs, codes, counts = _numbered(np.concatenate([ids_a << 32 | ids_b[at_b], ids_a[at_a] << 32 | ids_b[inner]]))
        inner_to = np.searchsorted(inner, to_b)
        links = [codes[x - n : x].tobytes() + codes[len(ids_a) + p : len(ids_a) + q].tobytes() for x, n, p, q in zip(to_a, n_a, np.r_[0, inner_to[:-1]] if len(texts) else [], inner_to, strict=True)]
        groups_to = np.r_[0, np.cumsum(both)][to_a] if len(texts) else to_a
        rows = pd.DataFrame({"n_a": n_a, "n_b": n_b, "n_groups": np.diff(np.r_[0, groups_to]), "n_links": n_a + n_b - np.diff(np.r_[0, groups_to])})
        rows["groups_sha256"] = self._digests(ids_a, ids_b, both, closes_b, to_a + to_b)
        rows["links"] = links
        return rows, pairs, counts

    def _digests(self, ids_a: np.ndarray, ids_b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray, ends: np.ndarray) -> list[str]:
        """Of each text's groups: A's ids of a group, then B's, in order."""
        last_a, last_b = np.flatnonzero(closes_a), np.flatnonzero(closes_b)
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        items = np.empty(len(ids_a) + len(ids_b), object)
        items[np.arange(len(ids_a)) + np.r_[0, last_b + 1][group_a]] = self.text_a[2 * ids_a + closes_a]
        items[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = self.text_b[2 * ids_b + closes_b]
        out, start = [], 0
        for end in ends.tolist():
            out.append(hashlib.sha256(b"".join(items[start:end].tolist())[:-1]).hexdigest() if end > start else "")
            start = end
        return out


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in ascending order, each value's position among them (in 16 bits where they suffice), and how often each is there."""
    codes, different = pd.factorize(values)
    order = np.argsort(different)
    place = np.empty(len(different), np.int64)
    place[order] = np.arange(len(different))
    codes = place[codes]
    return different[order], codes.astype("<u2" if len(different) <= 1 << 16 else "<u4"), np.bincount(codes, minlength=len(different))


@cache
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _cut(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about SLICE characters, or one row."""
    sizes = texts.str.len().fillna(0).to_numpy(np.int64)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > SLICE:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` and ``n_best_a`` (links whose count is
    the highest of their B or A id), ``count_sum`` and ``groups_sha256``."""
    return _scored(*_slices(docs, byte_path, piece_path, id_col, text_col))


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text") -> DataFrame:
    """(a, b, count): how many links hold each pair of ids linked, and whether that is the highest count of either id."""
    counts = _counted(_slices(docs.withColumn("_row_", F.lit(None).cast("long")), byte_path, piece_path, "_row_", text_col)[1])
    return counts.select(_a("pair").cast("int").alias("a"), _b("pair").cast("int").alias("b"), "count", "best_a", "best_b")


def _a(pair: str):
    return F.shiftright(pair, 32)


def _b(pair: str):
    return F.col(pair).bitwiseAND(0xFFFFFFFF)


def _slices(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The written rows of documents, and of pairs, by slice."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    fields = f"kind string, slice long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair long, n long"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align, number = _aligner(byte_path, piece_path).align, TaskContext.get().partitionId() << 40
        for frame in frames:
            for start, end in _cut(frame["text"]):
                part = frame.iloc[start:end]
                rows, pairs, counts = align([t if isinstance(t, str) else None for t in part["text"].tolist()])
                rows.insert(0, "doc_id", part["doc_id"].array)
                yield rows.assign(kind="document", slice=number, pair=None, n=None)
                if len(pairs):
                    empty = dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"))
                    yield pd.DataFrame({"pair": pairs, "n": counts}).assign(kind="pair", slice=number, **empty)
                number += 1

    path = new_path(docs.sparkSession, "alignment")
    source.mapInPandas(cut, fields).write.option("compression", "zstd").partitionBy("kind").parquet(path)

    def read(kind: str, *columns: str) -> DataFrame:
        return docs.sparkSession.read.schema(fields).parquet(path).where(F.col("kind") == kind).select(*columns)

    return read("document", "slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"), read("pair", "slice", "pair", "n")


def _counted(pairs: DataFrame) -> DataFrame:
    """Each pair's count in all slices, and whether it is the highest of its A id or B id."""
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    for side, of in (("a", _a), ("b", _b)):
        # as many rows as the side's vocabulary has ids
        most = counts.groupBy(of("pair").alias(side)).agg(F.max("count").alias(f"most_{side}"))
        counts = counts.withColumn(side, of("pair")).join(F.broadcast(most), side)
    return counts.select("pair", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b"))


def _scored(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    back = pairs.select("slice", "pair").join(_counted(pairs), "pair")
    out = "slice, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a".split(", ")[1:]
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def sums(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("pair")
        count, best_a, best_b = known["count"].to_numpy(np.int64), known["best_a"].to_numpy(bool), known["best_b"].to_numpy(bool)
        links = [np.frombuffer(x, "<u2" if len(known) <= 1 << 16 else "<u4") for x in rows["links"]]
        return rows.assign(n_best=[int(best_b[x].sum()) for x in links], n_best_a=[int(best_a[x].sum()) for x in links], count_sum=[int(count[x].sum()) for x in links])[out]

    return documents.groupBy("slice").cogroup(back.groupBy("slice")).applyInPandas(sums, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_a long")
