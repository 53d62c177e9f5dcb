"""Vector search over tiers and the library, archives, order statistics, prefix sums and fingerprints against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import archive, fingerprint, library, prefix, search, selection

KEY = "0123456789abcdef0123456789abcdef"


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    a, b = a / abs(a).max(), b / abs(b).max()
    return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6) + 0.0


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    out = [(i, draw.normal(size=6).round(1).tolist(), "ab"[i % 2]) for i in range(300)]
    out[20:60] = [(i, out[20][1], "ab"[i % 2]) for i in range(20, 60)]  # ties
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows):
    odd = [(1000, None, "a"), (1001, [0.0] * 6, "a"), (1002, [None, 1.0, 1.0, 1.0, 1.0, 1.0], "a"), (1003, [float("nan")] * 6, "a"), (1004, [], "a"), (1005, [1.0, 2.0], "a"), (1100, [2.0, 1.0], "b"), (1006, [1e200] * 6, "a")]
    return spark.createDataFrame(rows + odd, "vec_id long, vector array<double>, part string")


def plain_best(rows, asked, k, scope=False):
    out = []
    for q, v, p in asked:
        near = sorted((-cosine(v, w), i) for i, w, r in rows if i != q and len(w) == len(v) and (not scope or r == p))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("at_once, block", [(8_000_000, 16_384), (500, 2)])
def test_best_equals_plain_search(vectors, rows, monkeypatch, at_once, block):
    monkeypatch.setattr(search, "AT_ONCE", at_once)
    monkeypatch.setattr(search, "BLOCK_ROWS", block)
    whole = [*rows, (1005, [1.0, 2.0], "a"), (1100, [2.0, 1.0], "b"), (1006, [1e200] * 6, "a")]
    asked = [r for r in whole if r[0] % 50 == 0]
    queries = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = search.best(queries, vectors, 7)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == plain_best(whole, asked, 7)
    scoped = search.best(queries, vectors, 3, ("part",))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in scoped.collect()) == plain_best(whole, asked, 3, True)
    assert search.best(queries.where("false"), vectors, 3).count() == 0 and search.best(queries, vectors.where("false"), 3).count() == 0


def test_tiers_merge_by_official_copy_and_drop_stale_ones(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")

    def tier(*rows):
        return spark.createDataFrame(rows, "vec_id long, vector array<double>")

    tiers = {
        "hot": tier((1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [1.0, 0.3]), (9, [1.0, 0.0])),
        "warm": tier((1, [1.0, 0.5]), (3, [1.0, 0.0]), (4, [1.0, 0.4])),
        "cold": tier((3, [1.0, 0.05]), (5, [0.0, 1.0]), (2, [1.0, 0.0])),
    }
    state = spark.createDataFrame([(1, "warm", True), (2, "hot", True), (3, None, True), (4, "warm", False), (5, "hot", True)], "vec_id long, current_tier string, is_current boolean")
    got = {r["vec_id"]: (r["rank"], r["tier"], r["score"]) for r in search.across_tiers(q, tiers, state, 5).collect()}
    assert got == {3: (1, "warm", 1.0), 2: (2, "hot", cosine([1, 0], [1, 0.2])), 1: (3, "warm", cosine([1, 0], [1, 0.5])), 5: (4, "cold", 0.0)}
    assert [r["vec_id"] for r in search.across_tiers(q, tiers, state, 2).orderBy("rank").collect()] == [3, 2]


def test_library_rights_and_revisions(spark):
    documents = spark.createDataFrame(
        [(1, "c1", "u1", 2, 7), (2, "c1", "u2", 1, 8), (3, "c2", "u3", 1, 8), (4, "c2", None, 1, 8), (5, "c2", "u5", 1, 8)], "document_id long, collection string, current_upload_id string, indexed_revision int, owner_id long")
    readers = spark.createDataFrame([(2, "clerk"), (3, "clerk"), (3, "clerk"), (4, "clerk"), (5, "boss")], "document_id long, role string")
    points = spark.createDataFrame(
        [(10, [1.0, 0.0], 1, 2, "u1", "c1"), (11, [1.0, 0.0], 1, 1, "u1", "c1"), (20, [1.0, 0.1], 2, 1, "u2", "c1"), (21, [1.0, 0.2], 2, 1, "u2", "c1"), (22, [1.0, 0.0], 2, 1, "old", "c1"),
         (30, [1.0, 0.3], 3, 1, "u3", "c2"), (31, [1.0, 0.0], 3, 1, "u3", "c1"), (40, [1.0, 0.0], 4, 1, "u4", "c2"), (50, [1.0, 0.0], 5, 1, "u5", "c2")],
        "vec_id long, vector array<double>, document_id long, index_revision int, upload_id string, collection string")
    actors = spark.createDataFrame([(7, "clerk"), (8, "boss"), (9, "guest")], "actor_id long, role string")
    queries = spark.createDataFrame([(100, [1.0, 0.0], 7), (101, [1.0, 0.0], 8), (102, [1.0, 0.0], 9)], "query_id long, vector array<double>, actor_id long")
    got = defaultdict(list)
    for r in library.scoped(queries, actors, documents, readers, points, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["document_id"], r["vec_id"]))
    assert got == {100: [(1, 10), (2, 20), (3, 30)], 101: [(5, 50), (2, 20), (3, 30)]}


def test_archives_open_under_their_own_header_only(spark):
    rows = spark.createDataFrame([(1, [0.5, 1.0]), (2, [2.0]), (3, []), (4, None)], "k long, vector array<double>")
    kept = rows.withColumn("archive", archive.sealed(F.col("k"), F.col("vector"), F.lit(KEY))).drop("vector")
    found = {r["k"]: (r["vector"], r["refused"]) for r in archive.opened(kept, "archive", "k", F.lit(KEY)).collect()}
    assert found[1] == ([0.5, 1.0], None) and found[2] == ([2.0], None) and found[3] == ([], None) and found[4] == (None, "SEAL")
    whole = {r["k"]: r["archive"] for r in kept.collect()}
    swapped = spark.createDataFrame([(1, (whole[2]["header"], whole[1]["body"])), (2, (whole[2]["header"].replace('"dimension":1', '"dimension":9'), whole[2]["body"])), (3, ("no json", whole[3]["body"])), (4, (None, None))], "k long, archive struct<header: string, body: binary>")
    assert {r["k"]: r["refused"] for r in archive.opened(swapped, "archive", "k", F.lit(KEY)).collect()} == {1: "OWNER", 2: "SEAL", 3: "FORMAT", 4: "FORMAT"}
    assert {r["refused"] for r in archive.opened(kept.where("k < 3"), "archive", "k", F.lit("another key of 32 characters ...")).collect()} == {"SEAL"}


@pytest.mark.parametrize("bins, few", [(4096, 4096), (2, 1), (7, 3)])
def test_order_statistics_of_any_group(spark, monkeypatch, bins, few):
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "FEW", few)
    draw = np.random.default_rng(1)
    groups = {"a": draw.normal(size=60).tolist(), "same": [3.0] * 30, "wide": [-1e308, 1e308, 0.0, 1e-300, 5.0], None: draw.integers(0, 4, 40).astype(float).tolist(), "one": [2.5]}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("none", None)], "g string, x double")
    ranks = {"low": F.lit(0), "mid": F.floor((F.col("n") - 1) / 2), "high": F.col("n") - 1, "beyond": F.col("n")}
    got = {r["g"]: tuple(r[c] for c in ("n", "low", "mid", "high", "beyond")) for r in selection.order_statistics(rows, ["g"], "x", ranks).collect()}
    assert got == {g: (len(x), min(x), sorted(x)[(len(x) - 1) // 2], max(x), None) for g, x in groups.items()}
    if bins > 2:
        whole = selection.quantiles(rows.where("g = 'a'"), [], "x", {"q": 0.99, "h": 0.5}).collect()
        assert len(whole) == 1 and np.allclose([whole[0]["q"], whole[0]["h"]], np.quantile(groups["a"], [0.99, 0.5]))


def test_prefix_sums_over_a_group_of_many_partitions(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "hot").alias("g"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    found = prefix.sums_before(rows.orderBy(F.desc("k")), ["g"], ["k"], {"before": F.col("v"), "n": F.lit(1)})
    total, n = defaultdict(int), defaultdict(int)
    for r in sorted(found.collect(), key=lambda r: r["k"]):
        assert (r["before"], r["n"]) == (total[r["g"]], n[r["g"]])
        total[r["g"]] += r["v"] or 0
        n[r["g"]] += 1
    assert n == {"hot": 333, None: 167}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_part_" in plan.split("Window")[1]
    assert prefix.sums_before(rows.where("false"), ["g"], ["k"], {"before": F.col("v")}).count() == 0


def test_fingerprints_do_not_depend_on_order_and_find_changes(spark):
    rows = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("s"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    ranges = fingerprint.ranges(rows, "s", F.col("text"))
    again = fingerprint.ranges(rows.orderBy(F.desc("k")).repartition(7).unionByName(rows.where("k = 3")), "s", F.col("text"))
    whole = {r["s"]: (r["n"], r["fingerprint"]) for r in fingerprint.of_sets(ranges, "s").collect()}
    assert whole == {r["s"]: (r["n"], r["fingerprint"]) for r in fingerprint.of_sets(again, "s").collect()} and whole[0][0] == 1000
    by = defaultdict(list)
    for i in range(0, 2000, 2):
        by[hashlib.sha256(f"t{i}".encode()).hexdigest()[:3]].append(f"t{i}")
    parts = [f"{k}:{hashlib.sha256('|'.join(sorted(v)).encode()).hexdigest()}" for k, v in sorted(by.items())]
    assert whole[0][1] == hashlib.sha256("|".join(parts).encode()).hexdigest()
    new = rows.where("k <> 5").withColumn("text", F.when(F.col("k") == 8, "other").when(F.col("k") == 9, F.lit(None)).otherwise(F.col("text"))).unionByName(spark.createDataFrame([(9000, 1, "new")], "k long, s long, text string"))
    assert {(r["s"], r["k"], r["operation"]) for r in fingerprint.changes(rows, new, "s", "k", F.col("text")).collect()} == {(1, 5, "delete"), (0, 8, "update"), (1, 9, "update"), (1, 9000, "insert")}
    assert fingerprint.changed_ranges(ranges, again, "s").count() == 0
