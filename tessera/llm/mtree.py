"""Exact top-k by inner product: a forest of M-trees, searched best first.

A vector x of a shard whose longest vector has length M becomes the point
(x, sqrt(M^2 - |x|^2)), a query q the point (q, 0): their squared distance is
|q|^2 + M^2 - 2<q, x>, so the nearest points are those of largest inner product.

A page holds up to ``CAPACITY`` entries. An entry of an inner page has its
routing point, covering radius and distance to the page's own routing point; an
entry of a leaf has its point and that distance. A search keeps a queue of pages
by the least distance that their radius allows and ends when that exceeds the
k-th best. An entry is skipped without computing its distance where the
triangle inequality over the stored distance already excludes it. The queries
of a block walk the tree together, so that a page is read once for all. Bounds are
floating point with a slack; scores are integers, computed exactly.

Vectors null, empty or with null or non-finite components take no part, nor do
rows without an id; vectors of other dimensions are other spaces; rows that
repeat an id are rows of their own; a query leaves out only its own row; an
empty table gives no rows; other columns are ignored. Points and queries are
divided by powers of two, which keep every digit, so that no finite vector is
too large for the bounds; a score among the best k that exceeds 64 bits raises
an error, for the result can't hold it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tessera.llm.common import written
from tessera.llm.vectors import dense, result, searched, usable

CAPACITY, FANOUT = 192, 16
SLACK = 1e-9  # of squared distances
_PAGE = "dim int, shard int, node int, leaf boolean, unit double, ids array<long>, refs array<long>, points array<double>, radii array<double>, to_parent array<double>"


@dataclass
class Page:
    leaf: bool
    ids: np.ndarray  # of children, or of vectors
    refs: np.ndarray  # rows of vectors; of children the smallest id below
    points: np.ndarray
    radii: np.ndarray
    to_parent: np.ndarray
    unit: float  # by which the tree's points were divided, a power of two


def power_above(x: np.ndarray) -> np.ndarray:
    """For each row a power of two, from 1 to 2**1023, that no component exceeds by more than a factor of two."""
    return np.ldexp(1.0, np.clip(np.frexp(np.abs(x).max(1, initial=0))[1], 0, 1023))


def quantized(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    norms = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(longest - norms, 0))[:, None]], axis=1)


def build(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, seed: int = 0) -> list[Page]:
    """Pages of an M-tree over the rows of ``x``; page 0 is the root."""
    unit = float(power_above(x).max(initial=1))
    x = x / unit
    points = lifted(x, float((x * x).sum(1).max(initial=0)))
    draw = np.random.default_rng(seed)
    pages: list[Page] = []

    def distances(at: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(((points[at] - centre) ** 2).sum(1))

    def make(at: np.ndarray, centre: np.ndarray) -> int:
        me = len(pages)
        pages.append(Page(True, ids[at], rows[at], points[at], np.zeros(len(at)), distances(at, centre), unit))
        if len(at) <= CAPACITY:
            return me
        pivots = points[draw.choice(at, FANOUT, replace=False)]
        nearest = ((points[at] ** 2).sum(1)[:, None] - 2 * points[at] @ pivots.T + (pivots**2).sum(1)).argmin(1)
        groups = [at[nearest == g] for g in range(FANOUT) if (nearest == g).any()]
        if len(groups) == 1:  # equal points
            groups = np.array_split(at, -(-len(at) // CAPACITY))
        children, centres, radii = [], [], []
        for group in groups:
            middle = points[group].mean(0)
            routing = points[group[distances(group, middle).argmin()]]
            radii.append(float(distances(group, routing).max()))
            centres.append(routing)
            children.append((make(group, routing), int(ids[group].min())))
        c = np.array(centres)
        pages[me] = Page(False, np.array([k for k, _ in children]), np.array([m for _, m in children]), c, np.array(radii), np.sqrt(((c - centre) ** 2).sum(1)), unit)
        return me

    if len(ids):
        make(np.arange(len(ids)), points[0])
    return pages


def best_first(pages: list[Page], queries: np.ndarray, own: np.ndarray, k: int, counts: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For each query the k best (score, vec_id) of the tree, best first, ties to the smaller id; row ``own`` is left out.

    The queries of a block share one queue, ordered by the least distance that
    any of them may find below a page; a page is read once, for those queries
    that it can still concern. ``counts`` gets the numbers of distances computed
    and avoided.
    """
    n = len(queries)
    best: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # heaps of (score, -id), worst first
    if not pages or not n:
        return best
    exact, units = queries, np.maximum(power_above(queries), pages[0].unit)
    queries, unit = queries / units[:, None], pages[0].unit
    longest = float((pages[0].points[0] ** 2).sum())
    own_squares = (queries * queries).sum(1)
    square = own_squares + longest
    slack = SLACK * (1 + square)
    limit = np.full(n, np.inf)  # squared distance of each query's k-th best, and some slack
    largest = max(float(np.abs(p.points[:, :-1]).max(initial=0)) for p in pages)
    safe = largest * unit * float(np.abs(exact).max(initial=0)) < 2**53 / queries.shape[1]  # products are exact in floating point
    queue: list[tuple] = [(0.0, 0, np.zeros(n), None)]
    done = avoided = 0
    while queue:
        least, node, bounds, to_routing = heapq.heappop(queue)
        if least * least > limit.max():
            break
        concerned = np.flatnonzero(bounds * bounds <= limit)
        page = pages[node]
        if not len(concerned):
            avoided += len(page.ids) * n
            continue
        at = np.arange(len(page.ids))
        if to_routing is not None:
            gap = np.maximum(np.abs(to_routing[concerned, None] - page.to_parent) - page.radii, 0)
            at = np.flatnonzero((gap * gap <= limit[concerned, None]).any(0))
        done += len(at) * len(concerned)
        avoided += len(page.ids) * n - len(at) * len(concerned)
        if not len(at):
            continue
        products = queries[concerned] @ page.points[at, :-1].T
        if not page.leaf:
            squares = own_squares[concerned, None] + (page.points[at] ** 2).sum(1) - 2 * products
            far = np.zeros((n, len(at)))
            far[concerned] = np.sqrt(np.maximum(squares, 0))
            below = np.full((n, len(at)), np.inf)
            below[concerned] = np.maximum(far[concerned] - page.radii[at] - np.sqrt(slack)[concerned, None], 0)
            for j, i in enumerate(at.tolist()):
                heapq.heappush(queue, (float(below[:, j].min()), int(page.ids[i]), below[:, j], far[:, j]))
            continue
        row, col = np.nonzero(square[concerned, None] - 2 * products <= limit[concerned, None])
        row, score, col = concerned[row], products[row, col], at[col]
        row, score, col = (x[page.refs[col] != own[row]] for x in (row, score, col))
        order = np.lexsort((page.ids[col], -score, row))
        row, score, col = row[order], score[order], col[order]
        if safe:  # a page gives a query its first k at most
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, score, col = (x[rank < k] for x in (row, score, col))
        for r, s, c in zip(row.tolist(), score.tolist(), col.tolist(), strict=True):
            entry = (int(s * unit * units[r]) if safe else exact_product(page.points[c, :-1] * unit, exact[r]), -int(page.ids[c]))
            heap = best[r]
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == k:
                limit[r] = square[r] - 2 * (heap[0][0] / (int(unit) * int(units[r]))) + slack[r]
    if any(not -(2**63) <= s < 2**63 for heap in best for s, _ in heap):
        raise OverflowError("an inner product exceeds 64 bits")
    if counts is not None:
        counts[0] += done
        counts[1] += avoided
    return [[(s, -i) for s, i in sorted(heap, key=lambda e: (-e[0], -e[1]))] for heap in best]


def exact_product(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product of integers held as doubles."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53 / len(a):
        return int(a @ b)
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def index(table: DataFrame, scale: float) -> DataFrame:
    """The forest as a table of pages."""
    def built(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        made = build(rows["vec_id"].to_numpy(), rows["row"].to_numpy(), quantized(dense(rows["v"]), scale), rows["shard"][0].as_py())
        out = {"dim": [rows["dim"][0].as_py()] * len(made), "shard": [rows["shard"][0].as_py()] * len(made), "node": range(len(made)), "leaf": [p.leaf for p in made], "unit": [p.unit for p in made]}
        out |= {n: [getattr(p, n).ravel() for p in made] for n in ("ids", "refs", "points", "radii", "to_parent")}
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), *(pa.list_(t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())))
        return pa.table({n: pa.array(list(c), t) for (n, c), t in zip(out.items(), kinds, strict=True)})

    return written(table.groupBy("dim", "shard").applyInArrow(built, _PAGE), "mtree")


def read_pages(rows: pa.Table) -> list[Page]:
    rows = rows.sort_by("node")
    column = {n: rows[n].to_pylist() if n in ("leaf", "unit") else [np.asarray(v.values) for v in rows[n]] for n in ("leaf", "ids", "refs", "points", "radii", "to_parent", "unit")}
    return [Page(leaf, i, r, p.reshape(len(i), -1), c, d, u) for leaf, i, r, p, c, d, u in zip(*column.values(), strict=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k rows of largest inner product over floor(scale * component): query_id, rank, vec_id, score."""
    table = usable(vectors, id_col, vector_col, nonzero=False)

    def search(pages: pa.Table, queries: pa.Table) -> pa.Table:
        if not pages.num_rows or not queries.num_rows:
            return result([], pa.int64())
        tree = read_pages(pages)
        points = quantized(dense(queries["v"]), scale)
        out = []
        found = best_first(tree, points, queries["row"].to_numpy(), k)
        for row, name, list_of in zip(queries["row"].to_pylist(), queries["vec_id"].to_pylist(), found, strict=True):
            out += [(row, name, i, s) for s, i in list_of]
        return result(out, pa.int64())

    return searched(table, index(table, scale), is_query, search, k, "long")
