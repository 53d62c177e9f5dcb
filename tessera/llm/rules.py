"""Quality rules whose cutoffs adapt to each language and source.

One pass measures every whole text. Quantile sketches then say what is usual:
a sketch of a statistic is the number of documents in each of its logarithmic
bins (``STEP`` apart, so a quantile is off by at most half of that), which
merges by adding, in any order, to the same counts. Sketches of a language and
source are merged with those of the language and of all documents, which count
as ``PRIOR`` documents each, so that a source of three documents does not judge
itself. A document fails a rule when its statistic lies beyond the fence of its
language and source: the quartile on that side and ``REACH`` times the distance
of the quartiles, or the rule's own slack where that is more. Quartiles stay
where they are until a quarter of a source is junk.

Verdicts are joined back by language and source. The thresholds have one row a
group; as a written table their size is known, so Spark sends them to the
documents where they are small and splits hot groups where they are not.

Nulls and ties: a null text has no words and fails the base rule, as an empty
one does; null languages and sources are groups of their own; null ids and
repeated rows are kept, a row for a row, and count in the sketches; a value on a
fence passes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, written

#: A bin's upper edge is this many times its lower edge; values below FLOOR share the lowest bin.
STEP, FLOOR = 1.02, 1e-4
#: Documents for which the sketches of the language, and of all, count in a group's own.
PRIOR = 50.0
REACH = 3.0
#: Rules: statistic, side that fails, least distance from the quartile that may fail.
RULES = (
    ("mean_word", "high", 1.5),
    ("mean_word", "low", 1.5),
    ("symbol_rate", "high", 0.1),
    ("dup_line_share", "high", 0.4),
    ("repeat_share", "high", 0.4),
)
METRICS = tuple(dict.fromkeys(m for m, _, _ in RULES))
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\v\f\r")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(texts: list[str | None]) -> np.ndarray:
    """A row of counts a text, in the order of ``_COUNTS``; ``n_lines`` are those that hold a word."""
    raws = [(t or "").encode() for t in texts]
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    data, row = np.frombuffer(b"".join(raws), np.uint8), np.repeat(np.arange(len(raws)), sizes)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=len(raws))

    words = [r.split() for r in raws]  # bytes split at the six ASCII white spaces alone
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    lines, again = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64)
    for i, raw in enumerate(raws):
        if raw and not raw.isspace():
            own = [x for x in raw.split(b"\n") if x and not x.isspace()]
            lines[i], again[i] = len(own), len(own) - len(set(own))
    chars = (data & 0xC0) != 0x80  # each character's first byte
    return np.stack([n_words, per_text(chars & ~_SPACES[data]), per_text(_SYMBOLS[data]), lines, again, _in_repeats(words, n_words)], 1)


def _in_repeats(words: list[list[bytes]], n_words: np.ndarray, width: int = 3) -> np.ndarray:
    """How many words of each text lie in a window of ``width`` words that the text holds twice or more."""
    flat = [w for ws in words for w in ws]
    owner = np.repeat(np.arange(len(words)), n_words)
    if len(flat) < width:
        return np.zeros(len(words), np.int64)
    codes = pd.factorize(np.array(flat, object))[0].astype(np.int64)
    window = codes[: len(codes) - width + 1]
    for k in range(1, width):
        window = pd.factorize(window << 32 | codes[k : len(codes) - width + 1 + k])[0].astype(np.int64)
    first = owner[: len(window)]
    whole = first == owner[width - 1 :]
    same = pd.factorize(window << 32 | first)[0]
    often = whole & (np.bincount(same[whole], minlength=same.max() + 1)[same] > 1)
    inside = np.zeros(len(codes), bool)
    for k in range(width):
        inside[k : len(window) + k] |= often
    return np.bincount(owner[inside], minlength=len(words))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source) and the counts of each row's whole text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    fields = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang string, source string, {', '.join(f'{c} long' for c in _COUNTS)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = measured(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(counts[:, i]) for i in range(len(_COUNTS)))], ["doc_id", "lang", "source", *_COUNTS])

    return source.mapInArrow(run, fields)


def _shares() -> dict[str, Column]:
    """The rules' statistics from the counts; only texts with words have them."""
    words = F.nullif("n_words", F.lit(0))
    lines = F.nullif("n_lines", F.lit(0))
    return {"mean_word": F.col("word_chars") / words, "symbol_rate": F.col("n_symbols") / words, "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words}


def bin_of(value: Column) -> Column:
    return F.ceil(F.log(F.greatest(value, F.lit(FLOOR)) / FLOOR) / math.log(STEP)).cast("int")


def bin_number(value: float) -> int:
    return math.ceil(math.log(max(value, FLOOR) / FLOOR) / math.log(STEP))


def value_of(bins: np.ndarray) -> np.ndarray:
    """The middle of each bin; the lowest stands for nothing."""
    return np.where(bins > 0, FLOOR * STEP ** (bins - 0.5), 0.0)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, bins, counts): one row a group and statistic. A sketch has at most as many bins as
    lie between FLOOR and the largest value: about 1,500 for lengths up to a thousand million."""
    shares = _shares()
    entries = F.array(*(F.struct(F.lit(m).alias("metric"), bin_of(shares[m]).alias("bin")) for m in METRICS))
    bins = counted.where("n_words > 0").select("lang", "source", F.explode(entries).alias("e")).select("lang", "source", "e.*").groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))
    return bins.groupBy("lang", "source", "metric").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("sketch"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Sketches added up by ``by`` and statistic."""
    rows = parts.select(*by, "metric", F.explode("sketch").alias("e")).groupBy(*by, "metric", F.col("e.bin").alias("bin")).agg(F.sum("e.n").alias("n"))
    return rows.groupBy(*by, "metric").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("sketch"))


def quantiles(parts: list[tuple[np.ndarray, np.ndarray, float]], at: tuple[float, ...]) -> list[float]:
    """Quantiles of sketches put together, each (bins, counts, weight)."""
    bins = np.concatenate([b for b, _, _ in parts])
    weights = np.concatenate([n * w for _, n, w in parts])
    order = np.argsort(bins, kind="stable")
    running = np.cumsum(weights[order])
    return [float(value_of(bins[order][min(len(order) - 1, np.searchsorted(running, q * running[-1] * (1 - 1e-12)))])) for q in at]


def thresholds(own: DataFrame) -> DataFrame:
    """(lang, source) and each rule's ``fence_<statistic>_<side>``."""
    per_lang = merged(own, "lang").withColumnsRenamed({"sketch": "of_lang", "lang": "lang_", "metric": "metric_"})
    overall = merged(own).withColumnsRenamed({"sketch": "of_all", "metric": "metric__"})
    whole = own.join(per_lang, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("metric") == F.col("metric_"))).join(overall, F.col("metric") == F.col("metric__"))

    def fences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for lang, source, metric, *found in frame.itertuples(index=False):
                held = [(np.array([e["bin"] for e in s], np.int64), np.array([e["n"] for e in s], float)) for s in found]
                parts = [(b, n, 1.0 if i == 0 else PRIOR / n.sum()) for i, (b, n) in enumerate(held)]
                low, high = quantiles(parts, (0.25, 0.75))
                for rule, side, slack in RULES:
                    if rule == metric:
                        reach = max(slack, REACH * (high - low))
                        out.append((lang, source, f"{rule}_{side}", high + reach if side == "high" else low - reach))
            yield pd.DataFrame(out, columns=["lang", "source", "rule", "fence"])

    long = whole.select("lang", "source", "metric", "sketch", "of_lang", "of_all").mapInPandas(fences, "lang string, source string, rule string, fence double")
    return long.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == f"{m}_{s}", F.col("fence"))).alias(f"fence_{m}_{s}") for m, s, _ in RULES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row a document: its counts, ``base_failed``, ``failed`` (names of the adaptive rules it fails) and ``kept``."""
    counted = written(statistics(docs, id_col, text_col, lang_col, source_col), "rule-statistics")
    fences = written(thresholds(sketches(counted)).withColumnsRenamed({"lang": "lang_", "source": "source_"}), "rule-fences")
    shares = _shares()
    beyond = F.array(*(F.when(shares[m] > F.col(f"fence_{m}_{s}") if s == "high" else shares[m] < F.col(f"fence_{m}_{s}"), F.lit(f"{m}_{s}")) for m, s, _ in RULES))
    both = counted.join(fences, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    out = both.select("doc_id", "lang", "source", *_COUNTS, base_failed().alias("base_failed"), F.array_compact(beyond).alias("failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
