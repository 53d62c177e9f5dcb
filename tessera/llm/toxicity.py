"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are all words of the examples and their beginnings of four to six letters.
A term's impact in a text is (1 + log count) * idf * a weight between 0 and 1
that grows with how much its document frequencies among toxic and other
examples differ; impacts are normalised to length 1. The index holds the
examples in blocks of ``BLOCK``: for each block a posting list of every term
that occurs there, and the term's largest impact in the block. A query adds the
largest impacts of its terms to an upper bound for every block and evaluates
blocks in falling order of their bounds until the next bound is below the k-th
best cosine, so its neighbours are exact. Neighbours vote with the square of
their cosine; a logistic curve fitted to the examples' own leave-one-out votes
turns the vote into a probability. The neighbours' ids are the evidence.

The examples are at most ``PER_CLASS`` labelled rows of each label, those with
the smallest hash of their id, and few if any more where rows repeat an id;
scores cover every whole text. Only term counts of these examples go to the
driver, and the index to the workers.

Nulls: a null text counts as an empty one; null labels teach nothing; ids
labelled twice take the larger label; texts without any term of the examples
have the share of toxic examples among such texts as their score, 0 where no
example is toxic; null ids and repeated rows are scored; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import is_training_row, slices
from tessera.llm.quality import training_sample
from tessera.llm.tokens import _Words

PER_CLASS, BLOCK, NEIGHBOURS = 512, 256, 15
#: Standard errors between the classes' document frequencies at which a term has half the full weight.
HALF_WEIGHT = 6.0
_WORDS = re.compile(r"\w+").findall


def terms_of(text: str) -> Counter:
    """Counts of the words of a whole text and of their beginnings."""
    out: Counter = Counter()
    for word, n in Counter(_WORDS(text.lower())).items():
        out[word] += n
        for term in beginnings(word):
            out[term] += n
    return out


def beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in (4, 5, 6) if len(word) > k]


def family(text: str) -> int:
    """The least hash of a text's runs of three words: mostly equal for copies and near copies."""
    words = text.split()
    runs = {*zip(words, words[1:], words[2:])} or {tuple(words)}
    return min(zlib.crc32(" ".join(r).encode()) for r in runs)


@dataclass
class Postings:
    """The posting lists of one block."""

    row: np.ndarray  # of each term, -1 where the block lacks it
    start: np.ndarray  # of each row's postings, and their end
    example: np.ndarray  # in the block
    impact: np.ndarray

    def cosines(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        row = self.row[at]
        here = row >= 0
        row, weight = row[here], weight[here]
        count = self.start[row + 1] - self.start[row]
        first = np.cumsum(count) - count
        every = np.arange(count.sum()) + np.repeat(self.start[row] - first, count)
        return np.bincount(self.example[every], np.repeat(weight, count) * self.impact[every], minlength=BLOCK)


@dataclass
class Index:
    terms: dict[str, int]
    weights: np.ndarray  # of the terms: idf times how well they tell the classes apart
    ids: np.ndarray
    labels: np.ndarray
    blocks: list[Postings]
    maxima: np.ndarray  # (term, block), rounded up
    curve: tuple[float, float] = (1.0, 0.0)
    none: float = 0.0

    def __post_init__(self) -> None:
        self.parts = _Words(self._parts)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def _parts(self, word: str) -> list[int]:
        return [t for term in (word, *beginnings(word)) if (t := self.terms.get(term)) is not None]

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text that the examples have, and their normalised impacts."""
        counts: dict[int, int] = {}
        parts = self.parts
        for word, n in Counter(_WORDS(text.lower())).items():
            for t in parts[word]:
                counts[t] = counts.get(t, 0) + n
        return self.impacts(counts)

    def impacts(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at, count = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts))
        by = np.argsort(at)
        at, weight = at[by], (1 + np.log(count[by])) * self.weights[at[by]]
        return at, weight / np.linalg.norm(weight) if len(at) else weight

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> list[tuple[float, int]]:
        """The k largest positive cosines and their examples' places, ties to the smaller place; ``but`` is left out."""
        if not len(at):
            return []
        bounds = weight @ self.maxima[at]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(best) == k and bounds[b] < best[-1][0] - 1e-12:
                break
            cosines = self.blocks[b].cosines(at, weight)
            least = best[-1][0] if len(best) == k else 1e-300
            first = np.argsort(-cosines, kind="stable")[: k + 1]  # one of them may be left out
            best += [(float(cosines[j]), b * BLOCK + j) for j in first.tolist() if cosines[j] >= least and b * BLOCK + j != but]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(c * c for c, _ in near)
        return sum(c * c * self.labels[i] for c, i in near) / total if total else 0.0

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.none
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * (self.vote(near) - 0.5) + b))))


def build(examples: list[tuple[int, int, int, dict[str, int]]], share: float) -> Index:
    """Index over (id, label, family, counts of terms); copies, of one family, count once for the weights of terms;
    ``share``: of ones among all labelled rows, for calibration."""
    examples = sorted(examples, key=lambda e: (e[1], e[0], e[2], sorted(e[3].items())))
    n = len(examples)
    ids, labels = np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], np.int64)
    terms = {t: i for i, t in enumerate(sorted({t for e in examples for t in e[3]}))}
    seen = np.zeros((2, len(terms)))
    for label, of_family in _families(examples):
        seen[int(label > 0), [terms[t] for t in of_family]] += 1
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels > 0).sum()))
    pooled = seen.sum(0) / (n0 + n1)
    z4 = ((seen[1] / n1 - seen[0] / n0) ** 2 / (pooled * (1 - pooled) * (1 / n0 + 1 / n1) + 1e-12)) ** 2
    idf = np.log((1 + n) / (1 + seen.sum(0))) + 1
    index = Index(terms, idf * (z4 + 1e-6) / (z4 + HALF_WEIGHT**4), ids, labels, [], np.zeros((len(terms), -(-n // BLOCK)), np.float32))
    found = [index.impacts({terms[t]: n for t, n in e[3].items()}) for e in examples]
    for b in range(-(-n // BLOCK)):
        own = found[b * BLOCK : (b + 1) * BLOCK]
        at = np.concatenate([a for a, _ in own])
        by = np.argsort(at, kind="stable")
        example, impact = np.repeat(np.arange(len(own)), [len(a) for a, _ in own])[by], np.concatenate([w for _, w in own])[by]
        here, start = np.unique(at[by], return_index=True)
        row = np.full(len(terms), -1, np.int32)
        row[here] = np.arange(len(here))
        index.blocks.append(Postings(row, np.append(start, len(at)), example.astype(np.int32), impact))
        if len(here):
            index.maxima[here, b] = np.nextafter(np.maximum.reduceat(impact, start).astype(np.float32), np.float32(2))
    weights = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9)) if n else np.zeros(0)
    near = [index.nearest(at, w, but=i) for i, (at, w) in enumerate(found)]
    empty = np.array([not x for x in near], bool)
    if empty.any():
        index.none = float((weights * labels)[empty].sum() / max(weights[empty].sum(), 1e-9))
    v, y, w = np.array([index.vote(x) for x in near])[~empty] - 0.5, labels[~empty], weights[~empty]
    index.curve = _logistic(v, y, w) if len(y) else (8.0, 0.0)
    return index


def _families(examples: list[tuple[int, int, int, dict[str, int]]]) -> list[tuple[int, set[str]]]:
    """One entry for each label and family, with all its terms."""
    out: dict[tuple[int, int], set[str]] = {}
    for _, label, of_family, counts in examples:
        out.setdefault((label, of_family), set()).update(counts)
    return [(label, terms) for (label, _), terms in out.items()]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton's method, a small ridge keeping them finite."""
    a, b = 1.0, 0.0
    w = w / w.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + ridge * a, (w * (p - y)).sum() + ridge * b])
        s = w * p * (1 - p)
        h = np.array([[(s * x * x).sum() + ridge, (s * x).sum()], [(s * x).sum(), s.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - float(step[0]), b - float(step[1])
        if abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Index:
    sample = training_sample(docs, labels, label, per_class, (0, 1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [terms_of(t) for t in texts]
            columns = [batch.column(0), batch.column(2), pa.array([family(t) for t in texts], pa.int64()), pa.array([[*c] for c in counts], pa.list_(pa.string())), pa.array([[*c.values()] for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "family", "terms", "counts"])

    rows = sample.select("doc_id", "text", "label").mapInArrow(counted, "doc_id long, label int, family long, terms array<string>, counts array<long>").collect()  # per_class of each label
    known = labels.where(F.col(label).isNotNull() & is_training_row(F.col("doc_id"))).agg(F.avg(F.col(label).cast("double")).alias("share")).first()["share"]
    return build([(r["doc_id"], r["label"], r["family"], dict(zip(r["terms"], r["counts"], strict=True))) for r in rows], known or 0.0)


def scored(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: id, ``score`` and ``evidence`` (ids and cosines of the neighbours that voted)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # an index of per_class examples of each label
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches, "text"):
            near = [index.nearest(*index.vector(t or "")) for t in batch.column(1).to_pylist()]
            votes = [[{"doc_id": int(index.ids[i]), "cosine": c} for c, i in n] for n in near]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index.score(n) for n in near], pa.float64()), pa.array(votes, evidence)], ["doc_id", "score", "evidence"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, evidence array<struct<doc_id: bigint, cosine: double>>")
