"""Approximate nearest neighbours by cosine: a permutation index.

``PIVOTS`` distinct vectors, the first among ``DRAW`` times as many rows by a
hash of the row, stand for the space. A vector is the list of its ``PREFIX`` nearest pivots in order; a shard's
inverted files hold, for each pivot, the vectors that list it and where. A query
reads the files of its own ``PROBES`` nearest pivots, adds up each vector's
footrule distance over these (a pivot that a list lacks counts as at its end),
takes the ``SHARE`` of the shard that is nearest so, ``LEAST`` rows at least, and
ranks those by their exact cosine.

Every row is indexed; only the pivots are a sample, of bounded size. Vectors
null, empty, zero or with null or non-finite components take no part, nor do
rows without an id; vectors of other dimensions are other spaces; rows that
repeat an id are rows of their own; a query leaves out only its own row; equal
cosines go to the smaller id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import written
from tessera.llm.vectors import dense, result, searched, usable

PIVOTS, DRAW, PREFIX, PROBES, SHARE, LEAST = 256, 4, 128, 64, 0.05, 512
_PAGE = "dim int, shard int, pivot int, members array<int>, places binary, rows array<long>, ids array<long>, points array<double>"


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    y = x / np.where(top > 0, top, 1)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots in order."""
    return np.argsort(-(unit(x) @ pivots.T), axis=1, kind="stable")[:, :prefix]


def footrules(order: np.ndarray, files: dict[int, tuple[np.ndarray, np.ndarray]], n: int, prefix: int) -> np.ndarray:
    """Footrule distances of the n vectors of a shard to the beginning of a query's list, by reading the files of its pivots."""
    # a vector that shares no pivot is as far as can be; each shared one takes off what its places allow
    own = len(order)
    total = np.full(n, own * prefix - own * (own - 1) // 2 + prefix * (prefix + 1) // 2, np.int32)
    for place, pivot in enumerate(order.tolist()):
        if pivot in files:
            members, places = files[pivot]
            total[members] -= 2 * (prefix - np.maximum(places, place).astype(np.int32))
    return total


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: the same digits, and no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row and in the same order for each, so that equal vectors have equal cosines; of ``scaled`` rows."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def chosen_pivots(table: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """``pivots`` vectors of each dimension; the first by the hash of their row."""
    first = W.partitionBy("dim").orderBy(F.xxhash64(F.col("row") + 7), "row")
    dims = [r["dim"] for r in table.select("dim").distinct().collect()]  # the dimensions that there are
    if len(dims) == 1:
        rows = table.orderBy(F.xxhash64(F.col("row") + 7), "row").limit(DRAW * pivots).collect()
    else:
        rows = table.withColumn("n", F.row_number().over(first)).where(F.col("n") <= DRAW * pivots).orderBy("n").collect()
    distinct = {d: [*dict.fromkeys(tuple(r["v"]) for r in rows if r["dim"] == d)][:pivots] for d in dims}
    return {d: unit(np.array(v)) for d, v in distinct.items()}


def index(table: DataFrame, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """Inverted files as rows by shard and pivot; pivot -1 holds the shard's vectors."""
    def built(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        dim, shard, x = rows["dim"][0].as_py(), rows["shard"][0].as_py(), dense(rows["v"])
        order = orders(x, pivots[dim], prefix)
        member = np.repeat(np.arange(len(x), dtype=np.int32), order.shape[1])
        place = np.tile(np.arange(order.shape[1], dtype="<u2"), len(x))
        by = np.argsort(order.ravel(), kind="stable")
        ends = np.searchsorted(order.ravel()[by], np.arange(len(pivots[dim]) + 1))
        out = [(dim, shard, -1, None, None, rows["row"].to_numpy(), rows["vec_id"].to_numpy(), x.ravel())]
        for p in range(len(pivots[dim])):
            here = by[ends[p] : ends[p + 1]]
            if len(here):
                out.append((dim, shard, p, member[here], place[here].tobytes(), None, None, None))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("dim", "shard", "pivot", "members", "places", "rows", "ids", "points"), zip(*out, strict=True), kinds, strict=True)})

    return written(table.groupBy("dim", "shard").applyInArrow(built, _PAGE), "permutations")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, prefix: int = PREFIX, probes: int = PROBES, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest found: query_id, rank, vec_id, score (cosine)."""
    table = usable(vectors, id_col, vector_col, nonzero=True)
    places = chosen_pivots(table, pivots)

    def search(pages: pa.Table, queries: pa.Table) -> pa.Table:
        if not pages.num_rows or not queries.num_rows:
            return result([], pa.float64())
        files, rows, ids, x = {}, None, None, None
        dim = pages["dim"][0].as_py()
        for i, pivot in enumerate(pages["pivot"].to_pylist()):
            if pivot < 0:
                rows, ids = (np.asarray(pages[n][i].values) for n in ("rows", "ids"))
                x = scaled(np.asarray(pages["points"][i].values).reshape(len(rows), -1))
            else:
                files[pivot] = np.asarray(pages["members"][i].values), np.frombuffer(pages["places"][i].as_py(), "<u2")
        own = scaled(dense(queries["v"]))
        want = min(len(rows), max(LEAST, int(np.ceil(share * len(rows)))) + 1)
        rank_id = np.argsort(np.argsort(ids, kind="stable")).astype(np.int64)
        out = []
        used = orders(own, places[dim], probes)
        for row, name, query, order in zip(queries["row"].to_pylist(), queries["vec_id"].to_pylist(), own, used, strict=True):
            far = footrules(order, files, len(rows), prefix).astype(np.int64) * len(rows) + rank_id
            near = np.argpartition(far, want - 1)[:want]
            near = near[rows[near] != row]
            score = cosines(x[near], query)
            best = near[(top := np.lexsort((ids[near], -score))[:k])]
            out += zip([row] * len(best), [name] * len(best), ids[best].tolist(), score[top].tolist(), strict=True)
        return result(out, pa.float64())

    return searched(table, index(table, places, prefix), is_query, search, k, "double")
