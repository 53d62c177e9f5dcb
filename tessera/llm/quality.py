"""A quality classifier: a sparse ensemble of rules over text statistics.

Small trees, each grown on a bootstrap sample and a part of the statistics,
give conjunctive rules (the paths to their nodes). A lasso logistic regression
keeps few of the rules. What is kept is compiled to one Spark column
expression over the statistics, so scoring adds no Python beside the pass that
counts words and characters.

Fitting uses at most ``max_rows`` labelled rows, those with the smallest hash
of their id; statistics and scores cover every whole text.

Nulls: a null text counts as an empty one and gets a score; null labels teach
nothing; ids labelled twice take the larger label; null ids and repeated rows
are scored; without labels of both kinds every score is the share of ones, 0.5
where there are none; an empty table gives no rows; other columns are ignored
by ``statistics`` beside those asked for.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import is_training_row, slices

MAX_ROWS = 16_000
#: Statistics of one text, in the order in which ``measure`` returns them.
STATISTICS = (
    "n_words", "mean_word", "distinct_share", "top_share", "repeat_share", "upper_share", "digit_share", "symbol_share", "pipe_rate", "bang_rate", "end_symbol_share",
    "n_lines", "same_line_share", "worst_line_upper", "worst_line_symbols", "long_word_share", "stop_rate", "wide_share", "pair_share", "first_half_distinct",
)
_CLASSES = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()?-", b"|", b"!", b"#$%&*+/<=>@[\\]^_`{}~"), 1):
    _CLASSES[list(_chars)] = _i
_CLASSES[128:] = 8
_SYMBOLS = re.compile(r"[#$%&*+/<=>@\[\\\]^_`{}~|!]")


def changed(line: str, low: str) -> int:
    """The characters of a line that its lower case ``low`` writes differently; a character may become two there."""
    if len(low) != len(line):
        return sum(c != c.lower() for c in line)
    if line.isascii():
        return int((np.frombuffer(line.encode(), np.uint8) != np.frombuffer(low.encode(), np.uint8)).sum())
    return int((np.frombuffer(line.encode("utf-32-le"), "<u4") != np.frombuffer(low.encode("utf-32-le"), "<u4")).sum())


def measure(text: str) -> list[float]:
    """The statistics of a whole text; zeros where there are no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    kinds = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=9)
    upper, lower, digits, stops, pipes, bangs, symbols, wide = (int(x) for x in kinds[1:9])
    size = len(raw)
    counts = Counter(words)
    half = words[: (n + 1) // 2]
    lines = [x for x in text.split("\n") if x]
    worst_upper = worst_symbols = 0.0
    for line in lines:
        if len(line) >= 20:
            worst_symbols = max(worst_symbols, len(_SYMBOLS.findall(line)) / len(line)) if _SYMBOLS.search(line) else worst_symbols
            if (low := line.lower()) != line:
                worst_upper = max(worst_upper, changed(line, low) / len(line))
    return [
        float(n), sum(map(len, words)) / n, len(counts) / n, max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, upper / max(1, upper + lower), digits / size, (symbols + pipes + bangs) / size, pipes / n, bangs / n,
        sum(w[-1] in "#$%&*!" for w in counts) / len(counts), float(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), worst_upper, worst_symbols, sum(len(w) > 20 for w in counts) / len(counts), stops / n, wide / size,
        len({*zip(words, words[1:])}) / n, len(set(half)) / len(half),
    ]


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the statistics, prefixed by ``stat_``; a row for each row."""
    source = docs.select(*keep, F.col(text_col).cast("string").alias("_text_"))
    names = [*keep, *(f"stat_{s}" for s in STATISTICS)]
    kept = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text_"):
            rows = np.array([measure(t or "") for t in batch.column(len(keep)).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(rows[:, i]) for i in range(rows.shape[1]))], names)

    return source.mapInArrow(run, ", ".join(filter(None, [kept, *(f"stat_{s} double" for s in STATISTICS)])))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), all of which hold


def grow(x: np.ndarray, y: np.ndarray, features: np.ndarray, depth: int, path: Rule, out: list[Rule], least: int) -> None:
    """Appends the rules of a tree over the rows: the path to each of its nodes."""
    if path:
        out.append(path)
    p = y.mean()
    if not depth or len(y) < 2 * least or p in (0.0, 1.0):
        return
    best = (1e-9, -1, 0.0)
    for f in features:
        edges = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1]))
        bins = np.searchsorted(edges, x[:, f], side="left")  # bin b: at most edges[b]
        left_n = np.cumsum(np.bincount(bins, minlength=len(edges) + 1))[:-1]
        left_y = np.cumsum(np.bincount(bins, y, minlength=len(edges) + 1))[:-1]
        right_n, right_y = len(y) - left_n, y.sum() - left_y
        ok = (left_n >= least) & (right_n >= least)
        if not ok.any():
            continue
        gain = np.where(ok, left_y**2 / np.maximum(left_n, 1) + right_y**2 / np.maximum(right_n, 1), -1) - y.sum() ** 2 / len(y)
        if gain[k := int(gain.argmax())] > best[0]:
            best = (gain[k], int(f), float(edges[k]))
    _, f, threshold = best
    if f < 0:
        return
    above = x[:, f] > threshold
    grow(x[~above], y[~above], features, depth - 1, (*path, (f, False, threshold)), out, least)
    grow(x[above], y[above], features, depth - 1, (*path, (f, True, threshold)), out, least)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, threshold in rule:
        out &= (x[:, f] > threshold) == above
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of standardised columns by accelerated proximal gradient; the intercept isn't penalised."""
    n, m = r.shape
    mean, spread = r.mean(0), r.std(0) + 1e-6
    z = (r - mean) / spread
    w, v, b, c, t = np.zeros(m), np.zeros(m), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 0.0, 1.0
    c = b
    u = np.ones(m)
    for _ in range(15):  # the largest eigenvalue bounds the step
        u = z.T @ (z @ u)
        u /= np.linalg.norm(u) + 1e-12
    rate = 4 * n / (float(np.linalg.norm(z @ u)) ** 2 + n)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        new = v - rate * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * error.mean()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w / spread, b - float((w / spread) @ mean)


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = "stat_") -> Column:
        """The score as an expression over the statistics."""
        z = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            met = F.lit(True)
            for f, above, threshold in rule:
                stat = F.col(prefix + STATISTICS[f])
                met = met & ((stat > threshold) if above else (stat <= threshold))
            z = z + F.when(met, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 0) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        return RuleEnsemble([], [], math.log(p / (1 - p)))
    draw = np.random.default_rng(seed)
    rules: list[Rule] = []
    for _ in range(trees):
        rows = draw.integers(0, len(y), min(len(y), 4000))
        grow(x[rows], y[rows], draw.permutation(x.shape[1])[: x.shape[1] // 2], depth, (), rules, max(3, len(rows) // 400))
    met: dict[bytes, Rule] = {}
    for rule in rules:  # rules that hold for the same rows are one
        h = holds(rule, x)
        if 0 < h.sum() < len(y):
            met.setdefault(h.tobytes(), rule)
    if not met:
        return fit(x, np.full(1, y.mean()))
    kept = [*met.values()]
    weights, intercept = lasso_logistic(np.stack([holds(r, x) for r in kept], 1).astype(float), y.astype(float), penalty)
    strong = [(r, float(w)) for r, w in zip(kept, weights, strict=True) if abs(w) > 1e-4]
    return RuleEnsemble([r for r, _ in strong], [w for _, w in strong], intercept)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, classes: tuple[int, ...] = ()) -> DataFrame:
    """Labelled documents to learn from, at most ``max_rows`` (of each of ``classes``, if given): doc_id, text, label."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & is_training_row(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    parts = [one.where(F.col("label") == c).orderBy(order, "doc_id").limit(max_rows) for c in classes] or [one.orderBy(order, "doc_id").limit(max_rows)]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    # at most max_rows ids of each class
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> RuleEnsemble:
    sample = training_sample(docs, labels, label, max_rows)
    rows = statistics(sample, keep=("label",)).toPandas()  # numbers of at most max_rows documents, or of as many as repeat their ids
    rows = rows.iloc[np.lexsort(rows.to_numpy(float).T)]  # the order of arrival doesn't count
    return fit(rows.iloc[:, 1:].to_numpy(float), rows.iloc[:, 0].to_numpy(int))


def scored(docs: DataFrame, model: RuleEnsemble, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score``."""
    return statistics(docs, text_col, keep).select(*keep, model.column().alias("score"))


def accepted(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns."""
    names = [f"own_{i}" for i in range(len(docs.columns))]  # whatever the columns are called, they clash with no statistic
    own = docs.toDF(*names)
    read = own.withColumn("read", F.col(names[docs.columns.index("text")]))
    return statistics(read, "read", tuple(names)).where(model.column() >= threshold).select(*names).toDF(*docs.columns)
