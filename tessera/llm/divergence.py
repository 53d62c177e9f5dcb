"""How far the sources of each language differ in the words they use.

Words are counted in each task before anything moves; only terms that enough
documents of their language hold stay. Terms are dealt to blocks by hash, and a
block of a language is a dense matrix of its groups by its terms, whole numbers
throughout. Within a block every pair of groups is compared at once by
broadcasting, a band of rows at a time, which gives the block's part of the
matrix of pairs and the block's highest terms of each group; Spark adds the
parts up and merges the highest.

The sources of a language are split into teams of ``TEAM``, and a block's cells
hold two teams each, so a task holds a bounded matrix however many sources
there are. The rows that say which groups there are and how many terms they
counted go to each block, beside which they are few.

All numbers are exact: shares are whole billionths by long division in steps of
a thousand, so counts below 9e15 do not overflow 64 bits.

Nulls and ties: null texts, languages and sources count as empty strings, which
are a language or source like others; a group without terms is compared with
counts of zero; equal values rank by the item's UTF-8 bytes; null ids do not
matter, for none is read; repeated rows count each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import slices, written

LEAST_DOCS, TOP = 30, 50
#: Terms in a block, about; groups in a team; numbers compared at once within a block.
BLOCK_TERMS, TEAM, AT_ONCE = 2048, 128, 4_000_000
#: Different terms that a task counts before it sends them on.
HELD = 400_000
UNIT = 1_000_000_000
#: Letters lower-cased, every other ASCII byte a space; bytes of other letters stay.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The runs of letters and non-ASCII characters, A to Z lower-cased, in UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def share(count, total, terms):
    """1 + floor(UNIT * (count + 5) / (total + 5 * terms)), for numbers or arrays."""
    rest, whole, out = count + 5, total + 5 * terms, 0
    rest, whole = np.broadcast_arrays(np.asarray(rest, np.int64), np.asarray(whole, np.int64))
    out, rest = np.zeros(rest.shape, np.int64) + rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; a row a task and more where it
    counted much. Every group has a row without a term."""
    source = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def flushed(occurrences: dict, holders: dict) -> pa.RecordBatch:
        keys = [(lang, src, term, n, holders[lang, src][term]) for (lang, src), found in occurrences.items() for term, n in found.items()]
        keys += [(lang, src, None, 0, 0) for lang, src in occurrences]
        columns = list(zip(*keys, strict=True)) or [()] * 5
        types = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences, holders = defaultdict(Counter), defaultdict(Counter)
        for batch in slices(batches, "text"):
            for lang, src, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = terms_of(text)
                occurrences[lang, src].update(found)
                holders[lang, src].update(set(found))
            if sum(map(len, occurrences.values())) > HELD:
                yield flushed(occurrences, holders)
                occurrences, holders = defaultdict(Counter), defaultdict(Counter)
        if occurrences:
            yield flushed(occurrences, holders)

    return source.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language by falling
    distance, part ``term`` the ``top`` terms that the source uses more than its language does."""
    counts = term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts, "term-counts")
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    terms = written(terms, "terms")
    kept = written(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept-counts")

    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    groups = counts.where("term IS NULL").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumn("team", F.floor((F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1) / TEAM).cast("int"))
    groups = groups.withColumn("teams", F.max("team").over(W.partitionBy("lang")) + 1).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int"))
    groups = written(groups, "groups")

    def to_cells(rows: DataFrame) -> DataFrame:
        """A copy of each row to every pair of teams with its own, the lower first."""
        others = F.sequence(F.lit(0), F.col("teams") - 1)
        return rows.withColumn("other", F.explode(others)).withColumn("first", F.least("team", "other")).withColumn("second", F.greatest("team", "other"))

    columns = ["lang", "block", "first", "second", "source", "team", "total", "v", "total_lang", "term", "n", "n_lang"]
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    cells = to_cells(kept.join(groups, ["lang", "source"]).withColumn("block", block)).select(columns)
    heads = to_cells(groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "n_lang": F.lit(0).cast("long")}).select(columns)

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        return compared(tile, top)

    parts = cells.unionByName(heads).groupBy("lang", "block", "first", "second").applyInPandas(compare, "lang string, source string, part string, item string, value long")
    parts = written(parts, "divergence-parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")


def compared(tile: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """A block's part of the distances between two teams (or within one), and its highest terms of each group."""
    lang, first, second = tile["lang"].iloc[0], tile["first"].iloc[0], tile["second"].iloc[0]
    heads = tile[tile["term"].isna()].sort_values(["team", "source"])
    rows = tile[tile["term"].notna()]
    names, totals, team, v = heads["source"].to_numpy(object), heads["total"].to_numpy(np.int64), heads["team"].to_numpy(), int(heads["v"].iloc[0])
    codes, words = pd.factorize(rows["term"].to_numpy(object))
    counts, in_lang = np.zeros((len(names), len(words)), np.int64), np.zeros(len(words), np.int64)
    place = {name: i for i, name in enumerate(names)}
    counts[np.fromiter(map(place.__getitem__, rows["source"]), np.int64, len(rows)), codes] = rows["n"].to_numpy(np.int64)
    in_lang[codes] = rows["n_lang"].to_numpy(np.int64)
    out: list[tuple[str, str, str, int]] = []
    p = share(counts, totals[:, None], v) if len(words) else counts
    left, right = np.flatnonzero(team == first), np.flatnonzero(team == second)
    band = max(1, AT_ONCE // max(1, len(right) * len(words)))
    for at in range(0, len(left), band):
        own = left[at : at + band]
        apart = np.abs(p[own][:, None, :] - p[right][None, :, :]).sum(2)
        for i, line in zip(own.tolist(), apart.tolist(), strict=True):
            for j, value in zip(right.tolist(), line, strict=True):
                if i != j:
                    out.append((names[i], "pair", names[j], value))
                    if first != second:
                        out.append((names[j], "pair", names[i], value))
    if first == second and len(words):
        q = share(in_lang, int(heads["total_lang"].iloc[0]), v)
        more = np.where(counts > 0, p - q, 0)
        rank_of = np.empty(len(words), np.int64)
        rank_of[np.argsort(np.array([w.encode() for w in words], object), kind="stable")] = np.arange(len(words))
        for i, line in enumerate(more):
            best = np.lexsort((rank_of, -line))[:top]
            out += [(names[i], "term", words[k], int(line[k])) for k in best.tolist() if line[k] > 0]
    found = pd.DataFrame(out, columns=["source", "part", "item", "value"])
    found.insert(0, "lang", lang)
    return found
