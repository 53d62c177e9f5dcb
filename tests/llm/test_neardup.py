"""Near-duplicate components against brute force."""

import random
import re
from math import comb

import numpy as np

from tessera.llm import graph, neardup, queries

SF = "/root/testdata/sf0.01"


def brute(rows, width, percent):
    sets = []
    for i, text in rows:
        words = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    holders = {}
    for n, s in enumerate(sets):
        for x in s if rows[n][0] is not None else ():
            holders.setdefault(x, []).append(n)
    for n, s in enumerate(sets):
        common = {}
        for x in s if rows[n][0] is not None else ():
            for m in holders[x]:
                if m < n:
                    common[m] = common.get(m, 0) + 1
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m]) - c):
                parent[root(n)] = root(m)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(least.get(root(n), i), i)
    return sorted(((i, len(sets[n]), None if i is None else least[root(n)]) for n, (i, _) in enumerate(rows)), key=str)


def test_small_families_equal_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for family in range(12):
        base = [f"W{draw.randint(0, 400)}" for _ in range(draw.choice([6, 30, 120]))]
        for _ in range(draw.choice([1, 3, 40])):
            words = [w if draw.random() > 0.03 else f"x{draw.randint(0, 9)}" for w in base]
            rows.append((draw.randint(0, 10_000), " ".join(words).lower() if draw.random() < 0.5 else "\n ".join(words)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É a"), (8, "é a"), (None, "one"), (9, "z " * 30_000), (10, "z z z"), (11, rows[0][1]), (11, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, set_key string")
    got = neardup.linked(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    kept = neardup.representatives(docs, 3, 85)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert neardup.linked(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (2, "something else here")], "doc_id long, text string")
    assert sorted(map(tuple, neardup.representatives(twice, 3, 85).collect())) == [(1, "a b c d"), (2, "something else here")]


def test_parities_bound_the_difference_from_below():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 40, 900)]
    sets += [np.unique(np.concatenate([s[: len(s) - k], draw.integers(0, 1 << 63, k, dtype=np.uint64)])) for s in sets for k in (0, 1, len(s) // 5)]
    words = neardup.parities(sets)
    for x, p in zip(sets, words, strict=True):
        for y, q in zip(sets, words, strict=True):
            unlike = sum(int(w).bit_count() for w in (p ^ q).view(np.uint64))
            assert unlike <= len(np.setxor1d(x, y)) and (len(x) != 40 or len(y) != 40 or unlike >= 0.8 * len(np.setxor1d(x, y)))


def test_names_that_clash_and_a_large_group_of_loose_copies(spark):
    draw = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(w if draw.random() > i / 6000 else f"x{draw.randint(0, 10**6)}" for w in base), 1, 2, 3) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _dropped_ int, _key_ int, node int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.linked(docs).collect()), key=str)
    assert got == brute([r[:2] for r in rows], 3, 85) and 50 < sum(c == 0 for _, _, c in got) < 650
    kept = neardup.representatives(docs, 3, 85)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in got})


def test_whole_table_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op2_near_duplicates(spark, SF).collect()), key=str)
    assert got == brute(rows, 3, 85) and any(c != i for i, _, c in got)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 150)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {150: 150, 200: 150}


def test_thresholds_follow_from_the_similarity():
    for percent in (80, 85, 100):
        matches, apart = neardup.thresholds(percent)
        j = percent / 100
        assert sum(comb(64, i) * j**i * (1 - j) ** (64 - i) for i in range(matches)) < 1e-6 <= 1 - sum(comb(64, i) * j**i * (1 - j) ** (64 - i) for i in range(matches + 1, 65)) or percent == 100
        assert matches > 32 and apart < 26
