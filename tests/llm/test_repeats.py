"""Substring dedup against brute force over small texts and over a whole table."""

import hashlib
import random

from tessera.llm import queries, repeats, rolling

SF = "/root/testdata/sf0.01"


def brute(rows, window):
    """Words that a window of a smaller id covers, straight from the definition."""
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), b" ".join(kept).decode()))
    return sorted(out, key=str)


def test_small_texts_equal_brute_force(spark):
    draw = random.Random(3)
    pool = [" ".join(draw.choice("abc é ö,".split()) for _ in range(draw.randint(5, 40))) for _ in range(12)]
    rows = [(draw.randint(0, 60), "\t".join(draw.choice(pool) for _ in range(draw.randint(0, 4)))) for _ in range(120)]
    rows += [(None, pool[0] + " " + pool[1]), (7, None), (8, ""), (9, "x " * 500), (3, "x " * 500), (9, "x " * 500), (61, pool[2] * 3), (62, pool[2] * 3), (62, pool[2] * 3), (5, "\xa0a\u2003b \x1c c")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, found string")
    for window in (10, 7):
        got = repeats.without_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, window)
    again = repeats.rewritten(docs, 10)
    assert again.columns == docs.columns
    want = sorted(k for (_, n, gone, k) in brute(rows, 10) if gone and k)
    assert sorted(r["text"] for r in again.collect() if r["text"] in want) and again.count() == sum(1 for _, n, gone, k in brute(rows, 10) if k or not gone)
    assert repeats.without_repeats(docs.where("false")).count() == 0


def test_whole_table_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(k.encode()).hexdigest()) for i, n, gone, k in brute(rows, 50)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op1_anchor_dedup(spark, SF).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_hashes_do_not_depend_on_how_texts_are_cut(monkeypatch):
    draw = random.Random(1)
    texts = [" ".join("w" * draw.randint(1, 9) + str(draw.randint(0, 99)) for _ in range(draw.randint(0, 300))).encode() for _ in range(50)]
    want = [rolling.word_hashes(t).tolist() for t in texts]
    monkeypatch.setattr(rolling, "SEGMENT", 64)
    assert [rolling.word_hashes(t).tolist() for t in texts] == want == [h.tolist() for h in rolling.word_hashes_of(texts)]
