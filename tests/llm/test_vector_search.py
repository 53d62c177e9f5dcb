"""Vector searches against brute force over small tables with ties, copies and unusable rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mtree, permutation, queries, vectors

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    draw = np.random.default_rng(11)
    x = draw.normal(size=(900, 6)).round(2)
    x[100:400] = x[100]  # a common vector
    x[400:430] *= 40
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(1000, None, None), (1001, [None, 1.0, 1.0, 1.0, 1.0, 1.0], None), (1002, [float("nan")] * 6, "y"), (1003, [float("inf")] * 6, "y"), (1004, [0.0] * 6, "y"), (1005, [], "y"), (None, [1.0] * 6, "y")]
    rows += [(1050, [1.0, 2.0], "y"), (1051, [2.0, 1.0], "y"), (50, x[50].tolist(), "again"), (1100, [0.5] * 6, "y")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)


def brute(rows, score, k):
    out = []
    for n, (i, v) in enumerate(rows):
        if i % 50 == 0:
            own = [(score(v, w), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v)]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(own, key=lambda e: (-e[0], e[1]))[:k])]
    return sorted(out)


def good(df, zero):
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["vec_id"] is not None and r["embedding"]]
    rows = [(i, np.array(v, float)) for i, v in rows if None not in v]
    return [(i, v) for i, v in rows if np.isfinite(v).all() and (zero or v.any())]


def product(v, w):
    return int(np.floor(256 * v) @ np.floor(256 * w))


def test_mtree_equals_brute_force(odd, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 300)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 8)
    got = mtree.top_k(odd, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(good(odd, True), product, 5)
    assert mtree.top_k(odd.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_mtree_avoids_distances_and_stays_exact_with_large_numbers():
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(30, 8)) * 1000
    x = np.floor(np.concatenate([c + draw.normal(size=(100, 8)) * 5 for c in centres]))
    pages, counts = mtree.build(np.arange(3000), np.arange(3000), x), [0, 0]
    got = mtree.best_first(pages, x[::100], np.arange(3000)[::100], 5, counts)
    for q, found in zip(range(0, 3000, 100), got):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert found == [(int(scores[j]), j) for j in sorted(range(3000), key=lambda j: (-scores[j], j))[:5]]
    assert counts[0] + counts[1] < 30 * 3000 and counts[1] > 0
    large = np.array([2.0**30, 3.0, 1.0])
    assert mtree.exact_product(large, large) == 2**60 + 10


def test_finite_vectors_of_any_size_lose_no_rows(spark):
    rows = [(0, [1e200, 1.0]), (50, [1.0, 2.0]), (1, [-2.0, 1.0]), (2, [3.0, 1.0]), (3, [0.5, 0.5]), (4, [1.0, -1.0])]
    pages = mtree.build(np.arange(6), np.arange(6), mtree.quantized(np.array([v for _, v in rows]), 256.0))
    ordinary = mtree.quantized(np.array([[-1.0, 2.0], [-1e-200, 1.0]]), 256.0)
    got = mtree.best_first(pages, ordinary, np.array([-1, -1]), 3)
    whole = [[int(c) for c in np.floor(256 * np.array(v))] for _, v in rows]
    for q, found in zip(ordinary, got, strict=True):
        want = sorted(((sum(int(a) * b for a, b in zip(q, v, strict=True)), -i) for i, v in enumerate(whole)), reverse=True)[:3]
        assert found == [(s, -i) for s, i in want]
    with pytest.raises(OverflowError):
        mtree.best_first(pages, mtree.quantized(np.array([[1.0, 1.0]]), 256.0), np.array([-1]), 3)
    odd = spark.createDataFrame([(0, [2e200, 1.0]), (1, [1e200, 1.0]), (2, [1e-200, 1e-200]), (50, [3e-200, 1e-200]), (3, [1.0, 1.0]), (4, [-5e-324, 0.0])], "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in permutation.nearest(odd, F.col("vec_id") % 50 == 0).collect()}
    assert len(found) == 10 and all(np.isfinite(s) for s in found.values())
    assert found[0, 1] == 1.0 and abs(found[0, 3] - 0.5**0.5) < 1e-15 and abs(found[0, 2] - found[0, 3]) < 1e-15 and found[0, 4] == -1.0 and abs(found[50, 2] - 4 / 20**0.5) < 1e-15


def test_permutation_recall_and_scores(spark, odd):
    got = permutation.nearest(odd, F.col("vec_id") % 50 == 0)

    def cosine(v, w):
        return float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())))

    want = brute(good(odd, False), cosine, 5)
    mine = sorted(map(tuple, got.collect()))
    assert [r[:2] for r in mine] == [r[:2] for r in want]
    vecs = dict(good(odd, False))
    assert all(abs(s - cosine(vecs[q], vecs[j])) < 1e-12 for q, _, j, s in mine)
    best = {(q, r): s for q, r, _, s in want}
    assert np.mean([s >= best[q, r] - 1e-9 for q, r, _, s in mine]) >= 0.9
    assert permutation.nearest(odd.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_permutation_recall_on_the_whole_table(spark):
    table = "/root/testdata/sf0.1"
    got = {}
    for r in queries.op10_permutation_neighbours(spark, table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = spark.read.parquet(f"{table}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), permutation.unit(np.array([r["embedding"] for r in rows], float))
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        hits.append(len({*ids[np.argsort(-s)[:5]].tolist()} & got[ids[q]]) / 5)
    assert np.mean(hits) >= 0.9


def test_footrule_from_files_equals_its_definition():
    draw = np.random.default_rng(4)
    lists = np.array([draw.permutation(12)[:5] for _ in range(40)])
    files = {p: (np.array([i for i in range(40) if p in lists[i]], np.int32), np.array([list(lists[i]).index(p) for i in range(40) if p in lists[i]], np.int32)) for p in range(12)}
    q = draw.permutation(12)[:5]

    def place(order, p):
        return list(order).index(p) if p in order else 5

    for own in (q, q[:3]):
        want = [sum(abs(place(own, p) - place(o, p)) for p in range(12)) for o in lists]
        assert permutation.footrules(own, files, 40, 5).tolist() == want
