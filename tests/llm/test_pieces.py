"""N-best segmentation against enumeration, and decoding against the texts themselves."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import sentencepiece

from tessera.llm import pieces, queries

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", "Hello  world ", " lead", "tab\tand\nline", "naïve café 漢字 𐍈", "²..", "...?!", "x" * 300, "\u2581", "e.g., this; that: (so)"]


def by_text():
    return {text: (i, score) for i, (text, score, kind) in enumerate(pieces_of()) if kind == "piece"}


def edges_of(lattice, table, unit, j):
    """(end, ids, score) of the edges that leave position j."""
    out = [(k, (table[x][0],), table[x][1]) for k in range(j + 1, min(len(unit), j + 20) + 1) if (x := unit[j:k]) in table]
    if unit[j] not in table:
        ids = tuple(lattice.byte_ids[b] for b in unit[j].encode())
        out.append((j + 1, ids, lattice.byte_score * len(ids)))
    return out


def every(lattice, table, unit):
    """All segmentations of a unit with their scores, straight from the definition."""
    if not unit:
        return [(0.0, ())]
    return [(score + s, (*ids, *rest)) for k, ids, score in edges_of(lattice, table, unit, 0) for s, rest in every(lattice, table, unit[k:])]


def two_best(lattice, table, unit):
    """The two best scores, by a dynamic programme over positions."""
    best = [[] for _ in range(len(unit) + 1)]
    best[0] = [0.0]
    for j in range(len(unit)):
        for k, _, score in edges_of(lattice, table, unit, j):
            best[k] = sorted(best[k] + [b + score for b in best[j]], reverse=True)[:2]
    return best[-1]


def test_nbest_equals_enumeration():
    lattice, table = pieces.Lattice(pieces_of(), 5), by_text()
    assert max(map(len, table)) <= 20
    draw = random.Random(2)
    for text in ["the cat", "token", "a.b", "naïve", "字x", *("".join(draw.choices("abcetn .é", k=9)).strip() or "a" for _ in range(60))]:
        ids, score, gaps = lattice.encode(text)
        got = [score, *(score - g for g, _ in gaps)]
        all_ways = every(lattice, table, "\u2581" + text.replace(" ", "\u2581"))
        assert np.allclose(got, sorted((s for s, _ in all_ways), reverse=True)[: len(got)]) and len(got) == min(5, len(all_ways))
        scores = dict((np.array(i, "<u4").tobytes(), s) for s, i in all_ways)
        assert all(abs(scores[i] - s) < 1e-6 for i, s in [(ids, score), *((x, score - g) for g, x in gaps)]) and len({ids, *(x for _, x in gaps)}) == len(got)


def pieces_of():
    lattice_of = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [(lattice_of.id_to_piece(i), lattice_of.get_score(i), "byte" if lattice_of.is_byte(i) else "other" if i < 3 else "piece") for i in range(lattice_of.get_piece_size())]


def test_long_runs_take_no_time():
    lattice, table = pieces.lattice(MODEL), by_text()
    for c in "-=_*.a字":
        began = time.process_time()
        ids, score, gaps = lattice.encode("a " + c * 10_000 + " b")
        assert time.process_time() - began < 4
        assert lattice.decode(ids) == "a " + c * 10_000 + " b"
        expected = two_best(lattice, table, "\u2581a\u2581" + c * 10_000 + "\u2581b")
        assert np.allclose([score, *(score - g for g, _ in gaps)], expected)


def test_words_learnt_together_equal_words_asked_one_by_one():
    draw = random.Random(4)
    texts = ["  ".join("".join(draw.choices("aenrstABü字.,-\n", k=draw.randint(1, 14))) for _ in range(40)) for _ in range(30)] + ["", " ", "x" * 200]
    together, alone = pieces.Lattice(pieces_of(), 3), pieces.Lattice(pieces_of(), 3)
    together.learn([pieces.split_words(t) for t in texts])
    assert [together.encode(t) for t in texts] == [alone.encode(t) for t in texts]


def test_texts_together_equal_texts_alone_though_words_are_forgotten():
    draw = random.Random(5)
    words = ["".join(draw.choices("aenrstABü字.,-\n\u2581", k=draw.randint(1, 14))) for _ in range(400)] + ["x" * 200, "1.5-" * 40, "²" * 70]
    together, free, alone = (pieces.Lattice(pieces_of()) for _ in range(3))
    together.lists = pieces.Pairs(150)
    for n in range(8):
        texts = [None, "", " ", "  a", "b ", *(draw.choice([" ", "  "]).join(draw.choices(words, k=30)) for _ in range(20))][n % 2 :]
        assert together.of_texts(texts) == free.of_texts(texts) == [alone.encode(text or "") for text in texts]
    assert together.lists.n < free.lists.n and max(map(len, free.lists.words)) < pieces.CACHE_LENGTH
    assert together.of_texts([]) == [] and together.of_texts([None, ""]) == [(b"", 0.0, ())] * 2


def test_new_words_of_a_batch_are_searched_together(monkeypatch):
    lattice, calls, searched = pieces.Lattice(pieces_of()), [], pieces.Lattice._searched
    monkeypatch.setattr(pieces.Lattice, "_searched", lambda self, units: calls.append(len(units)) or searched(self, units))
    draw = random.Random(6)
    lattice.of_texts([" ".join("".join(draw.choices("aenrst.-", k=draw.choice([5, 90]))) for _ in range(20)) for _ in range(20)])
    assert len(calls) == 1  # long words were searched one by one


def test_edge_cases_decode_as_the_library_does(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, "no id", "n"), (0, None, "n")], "doc_id long, text string, nbest string")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pieces.encode(docs, MODEL).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids = np.frombuffer(r["nbest"][0]["ids"], "<u4").tolist()
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert r["decoded"] == sp.decode(ids) == text.replace("\u2581", " ")
    assert pieces.encode(docs.where("false"), MODEL).count() == 0


def test_whole_table_decodes_to_itself(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_piece_lattice(spark, SF).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    lattice, table = pieces.lattice(MODEL), by_text()
    for r in rows:
        expected = two_best(lattice, table, "\u2581" + texts[r["doc_id"]].replace(" ", "\u2581")) if texts[r["doc_id"]] else [0.0]
        assert np.allclose([r["score"], *([] if r["second_score"] is None else [r["second_score"]])], expected, rtol=1e-9)
