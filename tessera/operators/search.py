"""Exact vector search: blocks of queries against shards of vectors, and one merge over storage tiers.

A cell holds one block of queries and one shard of vectors of the same scope and
dimension, and compares them by one matrix product an Arrow batch at a time;
each query leaves a cell with its best ``k``, so what is merged does not grow
with the vectors. Vectors are dealt to shards by hash of their id, queries to
blocks likewise, so no value makes a cell large. The vectors are copied once a
block of queries (``BLOCK_ROWS``), the queries once a shard.

Vectors that are null, empty or zero, or hold null or non-finite components,
take no part; those of unequal length never meet; a vector is not its own hit;
ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.staging import staged

SHARD_ROWS, BLOCK_ROWS, AT_ONCE = 32_768, 16_384, 8_000_000
TIERS = ("hot", "warm", "cold")
#: Candidates asked of each tier for one wanted, and at most.
OVERSAMPLE, MOST = 4, 400


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can be compared, as doubles."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.coalesce(~odd & F.exists(v, lambda x: x != 0), F.lit(False))).withColumn(vector, v)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    rows = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that no square leaves the range of doubles
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _cells(queries: DataFrame, corpus: DataFrame, scope: list[str], reduce: Callable, fields: str) -> DataFrame:
    """``reduce(cosines, queries, vectors)`` over bands of each cell, as one table of ``fields``. The queries hold
    ``query_id`` and ``vector``, the corpus ``vec_id`` and ``vector``."""
    # written: both are counted, then copied to their cells
    queries, corpus = staged(usable(queries, "vector"), "queries"), staged(usable(corpus, "vector"), "vectors")
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-corpus.count() // SHARD_ROWS))

    def dealt(rows: DataFrame, key: str, own: str, n: int, other: str, copies: int) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn("dim", F.size("vector"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    q, e = dealt(queries, "query_id", "block", blocks, "shard", shards), dealt(corpus, "vec_id", "shard", shards, "block", blocks)
    names = [x.split()[0] for x in fields.split(", ")]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            mine, theirs = _units(left["vector"]), _units(right["vector"])
            own, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
            for i in range(0, len(mine), step := max(1, AT_ONCE // len(theirs))):
                scores = np.round(mine[i : i + step] @ theirs.T, 6) + 0.0
                scores[own[i : i + step, None] == ids[None, :]] = np.nan  # not a hit of itself
                parts.append(reduce(scores, left.slice(i, step), right))
        return pa.concat_tables(parts).select(names) if parts else empty

    key = [*scope, "dim", "block", "shard"]
    empty = _empty(spark, fields)
    return q.groupBy(*key).cogroup(e.groupBy(*key)).applyInArrow(compare, fields)


def _empty(spark, fields: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], fields).schema).empty_table()


def best(queries: DataFrame, corpus: DataFrame, k: int, scope: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, *scope, rank, vec_id, score, *carry): each query's ``k`` nearest by cosine to six places, within its scope.
    ``carry`` names further columns of the corpus."""
    kinds = dict(corpus.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    fields = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", *scope, "vec_id", *carry)) + ", score double"

    def nearest(scores: np.ndarray, left: pa.Table, right: pa.Table) -> pa.Table:
        scores = np.where(np.isnan(scores), -np.inf, scores)
        least = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else np.full((len(scores), 1), -np.inf)
        rows, columns = np.nonzero((scores >= least) & (scores > -np.inf))
        found = scores[rows, columns]
        order = np.lexsort((right["vec_id"].to_numpy()[columns], -found, rows))
        rows, columns, found = rows[order], columns[order], found[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, columns, found = rows[place < k], columns[place < k], found[place < k]
        rows, columns = pa.array(rows), pa.array(columns)
        held = {"query_id": left["query_id"].take(rows)} | {c: right[c].take(columns) for c in (*scope, "vec_id", *carry)}
        return pa.table(held | {"score": pa.array(found, pa.float64())})

    met = _cells(queries.select("query_id", *scope, "vector"), corpus.select("vec_id", *scope, *carry, "vector"), list(scope), nearest, fields)
    return ranked(met, k, ("query_id", *scope)).select("query_id", *scope, "rank", "vec_id", "score", *carry)


def ranked(hits: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    at = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


def separation(queries: DataFrame, corpus: DataFrame, label: str) -> DataFrame:
    """(related, mean, low, high) over all pairs of a query and a vector, by whether their labels agree."""
    def summed(scores: np.ndarray, left: pa.Table, right: pa.Table) -> pa.Table:
        same = left[label].to_numpy(zero_copy_only=False)[:, None] == right[label].to_numpy(zero_copy_only=False)[None, :]
        there, out = ~np.isnan(scores), []
        for related in (True, False):
            own = scores[there & (same == related)]
            if len(own):
                out.append((related, len(own), float(own.sum()), float(own.min()), float(own.max())))
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["related", "n", "total", "low", "high"])

    met = _cells(queries.select("query_id", label, "vector"), corpus.select("vec_id", label, "vector"), [], summed, "related boolean, n long, total double, low double, high double")
    return met.groupBy("related").agg(F.round(F.sum("total") / F.sum("n"), 4).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def quantised(rows: DataFrame, vector: str, scale: DataFrame) -> DataFrame:
    """Adds ``codes`` (whole numbers from -127 to 127) and the ``scale`` they were made with; ``scale`` is one row."""
    codes = F.transform(F.col(vector).cast("array<double>"), lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / F.col("scale"))) * 127).cast("tinyint"))
    return rows.crossJoin(F.broadcast(scale.limit(1))).withColumn("codes", codes)


def restored(codes: str = "codes", scale: str = "scale") -> Column:
    return F.transform(codes, lambda c: c.cast("double") * F.col(scale) / 127)


def across_tiers(queries: DataFrame, tiers: dict[str, DataFrame], state: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, tier): the ``k`` best over all tiers.

    Each tier, (vec_id, vector) in its own form, is asked for more than ``k``, so that
    copies dropped later do not crowd others out. ``state`` (vec_id, current_tier,
    is_current) decides: a vector without a row, or no longer current, is never
    returned; of a vector found in several tiers, the copy of its official tier
    stays, else that of the first tier in order; where no tier is official, the
    higher score.
    """
    most = min(max(k, OVERSAMPLE * k), MOST)
    hits = None
    for tier in TIERS:
        if tier in tiers:
            own = best(queries, tiers[tier], most).select("query_id", "vec_id", "score", F.lit(tier).alias("tier"))
            hits = own if hits is None else hits.unionByName(own)
    known = hits.join(state.where("is_current").select("vec_id", "current_tier"), "vec_id")
    turn = -F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    official = F.when(F.col("current_tier").isNotNull(), (F.col("tier") == F.col("current_tier")).cast("double")).otherwise(F.col("score"))
    chosen = known.groupBy("query_id", "vec_id").agg(F.max(F.struct(official.alias("first"), turn.alias("turn"), "score", "tier")).alias("b"))
    return ranked(chosen.select("query_id", "vec_id", "b.score", "b.tier"), k).select("query_id", "rank", "vec_id", "score", "tier")
