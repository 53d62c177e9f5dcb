"""Blocks of queries against shards of an index: what the exact and the approximate vector search share.

Every row is dealt to one shard of about ``SHARD_ROWS`` rows, every query to one
block of about ``BLOCK_QUERIES``. A cell holds one shard's pages and one block's
queries, so its size is bounded whatever the tables hold; each cell gives its
queries' k best, and the k best of those are the answer. With blocks about as
large as shards, pages and queries together are copied as little as cells of
that size allow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import written

SHARD_ROWS, BLOCK_QUERIES = 8192, 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(row, vec_id, v, dim, shard) of the rows whose vectors are whole and finite; written, so that ``row`` stays."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~odd & F.col(id_col).isNotNull())
    if nonzero:
        good = good.where(F.exists(v, lambda x: x != 0))
    table = written(good.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim")), "vectors")
    shards = max(1, -(-table.count() // SHARD_ROWS))
    return table.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))


def dense(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def searched(table: DataFrame, pages: DataFrame, is_query: Column, search: Callable[[pa.Table, pa.Table], pa.Table], k: int, score_type: str) -> DataFrame:
    """Runs ``search(pages, queries)`` in each cell and merges: query_id, rank, vec_id, score.

    ``search`` gives rows (query_row, query_id, vec_id, score), at most k a query.
    """
    queries = table.where(is_query).select("row", "vec_id", "v", "dim")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.col("row") + 1), F.lit(blocks)).cast("int"))
    shards = pages.select(F.col("dim").alias("of_dim"), F.col("shard").alias("of_shard")).distinct()  # one row a shard
    left = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.join(shards, F.col("dim") == F.col("of_dim")).select("row", "vec_id", "v", "dim", F.col("of_shard").alias("shard"), "block")
    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, f"query_row long, query_id long, vec_id long, score {score_type}")
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def result(rows: list[tuple], score: pa.DataType) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_row", "query_id", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.int64(), score), strict=True)})
