"""Packing and the content-addressed store against the tokenizers library itself."""

import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import packing, queries, store, tokens
from tessera.llm.common import new_path

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "Hello, World's 3rd  test\n\n x", "tab\tand\r\nline  ", "ΑΣ ΣΑΣ İstanbul 漢字かな 1234", "<|endoftext|> a<|startoftext|>b", "x\x1cy   z  q", "école é ＡＢ", "don't we'll I'D", "a b  c   d", "z " * 5000, "y" * 3000]


@cache
def library(path):
    return Tokenizer.from_file(public_tokenizers.path(path))


def ids_of(path, text, end):
    t = library(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(3, "a", 1), (3, "b", 2), (None, "null id", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, start long")


def test_pack_edge_cases(docs):
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1).withColumn("crc", F.crc32("ids")).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    assert all(r["length"] & (r["length"] - 1) == 0 and 0 < r["length"] <= 2048 for r in rows)
    for i, text in enumerate(TEXTS):
        if i == 3:
            continue
        ids = ids_of("word_bpe_49k.json", text, 1)
        got = sorted((r["start"], r["length"], r["crc"], r["doc_tokens"]) for r in rows if r["doc_id"] == i)
        at, want = 0, []
        for n in packing.binary_lengths(len(ids)):
            want.append((at, n, crc(ids[at : at + n]), len(ids)))
            at += n
        assert got == want and at == len(ids), text


def test_store_edge_cases(spark, docs):
    path = new_path(spark, "store")
    store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert store.verify_manifest(spark, path)
    rows = sorted(store.read_checksums(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted([r["doc_id"] for r in docs.collect()], key=lambda x: (x is not None, x or 0))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None and r["doc_id"] != 3:
            ids = ids_of("byte_bpe_50k.json", TEXTS[r["doc_id"]], 2)
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), crc(ids)), TEXTS[r["doc_id"]]
    whole = {r["start"]: r["ids"] for r in store.read_ids(spark, path).collect()}
    assert all(crc(whole[r["start"]]) == r["ids_crc32"] for r in rows)
    stored = store.chunk_checksums(spark, path).collect()
    assert len({bytes(r["chunk_id"]) for r in stored}) == len(stored)


def test_whole_tables_match_the_library(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op6_content_store(spark, SF).collect()}
    assert got.keys() == docs.keys()
    at = 0
    for k in sorted(docs):
        ids = ids_of("byte_bpe_50k.json", docs[k], 2)
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    pieces = queries.op3_binary_packing(spark, SF).collect()
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == docs.keys()
    for k in sorted(docs):
        ids = ids_of("word_bpe_49k.json", docs[k], 1)
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in by_doc[k])
        assert sum(n for _, n, _ in mine) == len(ids) and all(c == crc(ids[s : s + n]) for s, n, c in mine)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0
    assert store.store_and_read(none, public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


def test_cuts_stay_within_bounds_and_follow_content():
    ids = np.random.default_rng(1).integers(0, 50_000, 60_000).astype(np.uint32)
    ends = store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= store.MOST and sizes[:-1].min() >= store.LEAST
    moved = store.cuts(np.concatenate([ids[:50], ids[40:]]))
    assert len({len(ids) - e for e in ends} & {len(ids) + 10 - e for e in moved}) > len(ends) * 0.8


@pytest.mark.parametrize("change", ["chunks", "ids", "start"])
def test_altered_recipes_are_refused(spark, docs, change):
    path = new_path(spark, "store")
    store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    recipes = spark.read.parquet(f"{path}/recipes")
    rows = [r.asDict() for r in recipes.collect()]
    a, b = next((x, y) for x in rows for y in rows if x["n_tokens"] == y["n_tokens"] and x["chunk_ids"] != y["chunk_ids"])
    if change == "start":
        a["start"], b["start"] = b["start"], a["start"]
    elif change == "chunks":
        a["chunk_ids"] = b["chunk_ids"]
    else:
        for r in rows:
            r["doc_id"] = None if r["doc_id"] is None else r["doc_id"] + 100
    altered = new_path(spark, "store")
    for part in ("objects", "manifest"):
        held = spark.read.parquet(f"{path}/{part}")
        (held.write.partitionBy("kind") if part == "objects" else held.write).parquet(f"{altered}/{part}")
    spark.createDataFrame(rows, recipes.schema).write.parquet(f"{altered}/recipes")
    assert store.verify_manifest(spark, path) and not store.verify_manifest(spark, altered)
    with pytest.raises(ValueError, match="manifest"):
        store.read_checksums(spark, altered)


def test_words_put_together_from_parts_equal_the_whole_encoder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, draw = tokens.Encoder(path, 60), random.Random(9)
    words = ["".join(draw.choices("aehnrstABüÑɏʒ字1.,-!'$_|~\n", k=draw.randint(1, 12))).strip() or "a" for _ in range(600)]
    words += ["don't", "ab.cd", "ab-'s", "'s", "a.\nNext", "Ab!!\nÄnd,", "...", "$$$", "x" * 90, "ªµº", "a\u00a0b", "a\tb", "a.\n1"]
    texts = [" ".join(draw.choices(words, k=25)) for _ in range(80)] + [None, "", "a", " a", "a ", "a\n", *words]
    assert [x.tolist() for x in own.encode_all(texts)] == [own.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert max(len(own.words), len(own.words.older)) <= 60


def test_new_words_need_no_lookup_of_their_own(monkeypatch):
    own, draw = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    texts = [" ".join("".join(draw.choices("aehnrst", k=9)) + draw.choice(["", ".", "$$$", "#!"]) for _ in range(50)) for _ in range(40)]
    asked = []
    monkeypatch.setattr(tokens._Words, "keep", lambda self, word, ids: asked.append(word) or self.__setitem__(word, ids))
    own.encode_all(texts)
    assert asked and all(word.isalpha() for word in asked)  # words with signs after them were remembered one by one


def test_pipeline_packs_with_few_words_remembered(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{w}{chr(97 + i % 26)}" for w in ("alpha", "beta", "gamma"))) for i in range(60)], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    few = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in packing.pack(docs, path, 1, remembered=5).collect()}
    assert few == {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in packing.pack(docs, path, 1).collect()}
    own = tokens.encoder(path, 5)
    own.encode_all([r["text"] for r in docs.collect()])
    assert max(len(own.words), len(own.words.older)) <= 5 and 2 * corpus_pipeline.REMEMBERED < tokens.CACHE_WORDS
