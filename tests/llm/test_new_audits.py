"""Token alignment, adaptive rules and source divergence against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import align, divergence, queries, rules

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "\n", "a b", " a", "a ", "a  b", "The cat sat on the mat.", "The cat sat on the mat.", "tab\tand\r\nline  \n\n end", "ünï ©ødé 漢字かな 𝔘 é ﬁ",
    "<|endoftext|> <s> </s> <0x41> <unk>", "a▁b", "▁", "x\x00y z", "don't we'll 1234 3.14", "a" * 5000, "word " * 4000, "Ab1_%" * 900, "  　x", "🙂🙃 zz",
]
COLUMNS = "doc_id long, text string, lang string, source string, n long, slice string, kind string"


def rows_of(texts):
    return [(None if i == 4 else i // 2 * 2 if i in (10, 11) else i, t, (None, "en", "")[i % 3], (None, "s", "", "t")[i % 4], i, "x", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(ODD), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def plain_alignment(texts):
    a_side, b_side = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for text in texts:
        a, b, raw = [], [], (" " + (text or "")).encode()
        if text:
            a = [(i, bytes(back[c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, b_bytes(i)) for i in b_side.encode(text)]
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append(([], []))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        groups, links, i, j = [[[], []]], [], 0, 0
        while i < len(spans[0]):
            (p, p0, p1), (q, q0, q1) = spans[0][i], spans[1][j]
            links.append((p, q))
            for k, x, whole in ((0, p, p1 <= q1), (1, q, q1 <= p1)):
                if whole:
                    groups[-1][k].append(x)
            i, j = i + (p1 <= q1), j + (q1 <= p1)
            if p1 == q1:
                groups.append([[], []])
        assert i == len(spans[0]) and j == len(spans[1])
        counts.update(links)
        found.append((groups[:-1], links))
    best = defaultdict(int)
    for (_, q), n in counts.items():
        best[q] = max(best[q], n)
    return [
        (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in groups).encode()).hexdigest() if groups else "")
        for groups, links in found
    ], counts


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_odd_texts(spark, odd, monkeypatch):
    want, counts = plain_alignment(ODD)
    got = align.aligned(odd, BYTES, PIECES).collect()
    ids = [r[0] for r in rows_of(ODD)]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([(r["doc_id"], *(r[c] for c in ALIGNED)) for r in got], key=key) == sorted([(i, *w) for i, w in zip(ids, want, strict=True)], key=key)
    assert {(r["a"], r["b"]): r["count"] for r in align.pair_counts(odd, BYTES, PIECES).collect()} == dict(counts)
    assert align.aligned(odd.where("false"), BYTES, PIECES).count() == 0
    assert {tuple(r[c] for c in ALIGNED) for r in align.aligned(odd.where("text is null or text = ''"), BYTES, PIECES).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_alignment_does_not_depend_on_slices(odd, monkeypatch):
    texts = [t for t in ODD if t]
    aligner = align.Aligner(BYTES, PIECES)
    rows, pairs, counts = aligner.align(texts)
    one = [aligner.align([t]) for t in texts]
    assert rows["groups_sha256"].tolist() == [x["groups_sha256"][0] for x, _, _ in one] and counts.sum() == rows["n_links"].sum()
    total = Counter()
    for _, p, n in one:
        total.update(dict(zip(p.tolist(), n.tolist(), strict=True)))
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == total
    monkeypatch.setattr(align, "SLICE", 10)
    assert [*align._cut(pd.Series(["a" * 6, "b" * 6, None, "c" * 30, "d"]))] == [(0, 1), (1, 3), (3, 4), (4, 5)] and [*align._cut(pd.Series([], dtype=object))] == []


def test_alignment_of_the_table(spark, documents):
    want = plain_alignment([t for _, t, *_ in documents])[0]
    got = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in queries.op11_token_alignment(spark, SF).collect()}
    assert got == {i: w for (i, *_), w in zip(documents, want, strict=True)}


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again, lines = set(), 0, 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            lines += 1
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, again, len(inside)


def plain_verdicts(rows):
    """(base_failed, kept) of (lang, source, text), by sorted values in place of sketches: each one's bin is known."""
    counted = [plain_counts(t) for *_, t in rows]

    def shares(c):
        return {"mean_word": c[1] / c[0], "symbol_rate": c[2] / c[0], "dup_line_share": c[4] / c[3], "repeat_share": c[5] / c[0]} if c[0] else {}

    def middle(x):
        n = int(rules.bin_number(x))
        return rules.FLOOR * rules.STEP ** (n - 0.5) if n > 0 else 0.0

    out = []
    for (lang, source, _), c in zip(rows, counted, strict=True):
        base = c[0] < 50 or 100 * c[5] > 50 * c[0]
        kept = not base
        for metric, side, slack in rules.RULES if c[0] else ():
            own, same, every = ([middle(shares(x)[metric]) for (a, b, _), x in zip(rows, counted, strict=True) if x[0] and ok(a, b)] for ok in (lambda a, b: (a, b) == (lang, source), lambda a, _: a == lang, lambda a, b: True))
            weighed = sorted([(x, Fraction(1)) for x in own] + [(x, Fraction(int(rules.PRIOR), len(same))) for x in same] + [(x, Fraction(int(rules.PRIOR), len(every))) for x in every])
            total, ends = sum(w for _, w in weighed), []
            for q in (Fraction(1, 4), Fraction(3, 4)):
                run = Fraction(0)
                for x, w in weighed:
                    run += w
                    if run >= q * total:
                        ends.append(x)
                        break
            reach = max(slack, rules.REACH * (ends[1] - ends[0]))
            value = shares(c)[metric]
            kept &= value <= ends[1] + reach + 1e-9 if side == "high" else value >= ends[0] - reach - 1e-9
        out.append((base, kept))
    return counted, out


def test_counts_of_odd_texts():
    texts = [*ODD, "a b c a b c", "a a a a", "a b c\na b c\n\na b c", "x y\nz", "one two", "a,b c| #$% <> &*\n \n \n", "é ü é ü é ü", " a b c d a b c"]
    assert [tuple(r) for r in rules.measured(texts).tolist()] == [plain_counts(t) for t in texts]
    assert rules.measured([]).shape == (0, 6)


def test_rules_against_plain_quantiles(spark, documents):
    rows = [(lang, source, text) for _, text, lang, source in documents]
    counted, verdicts = plain_verdicts(rows)
    got = {r["doc_id"]: r for r in queries.op12_adaptive_rules(spark, SF).collect()}
    assert len(got) == len(documents)
    for (i, *_), c, (base, kept) in zip(documents, counted, verdicts, strict=True):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (*c[:3], *c[4:]) and (r["base_failed"], r["kept"]) == (base, kept), i
    assert 0 < sum(r["kept"] for r in got.values()) < len(got)


def test_rules_keep_good_documents_and_find_bad_ones(spark):
    large = "/root/testdata/sf0.01"
    rows = queries.op12_adaptive_rules(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    kept = {q: np.mean([r["kept"] for r in rows if r["quality"] == q]) for q in (0, 1)}
    assert kept[1] > 0.99 and kept[0] < 0.25


def test_rules_of_odd_rows(spark, odd):
    rows = rules.judged(odd).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows if not r["n_words"])
    _, verdicts = plain_verdicts([(r[2], r[3], r[1]) for r in rows_of(ODD)])
    assert sorted((r["base_failed"], r["kept"]) for r in rows) == sorted(verdicts)
    assert rules.judged(odd.where("false")).count() == 0


def plain_audit(rows, least=30, top=50):
    counts, groups, holders = Counter(), set(), Counter()
    for text, lang, source in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        counts.update((lang, source, w) for w in found)
        holders.update((lang, w) for w in set(found))
    out = []
    for lang in {a for a, _ in groups}:
        terms = sorted(w for (a, w), n in holders.items() if a == lang and n >= least)
        sources = sorted(s for a, s in groups if a == lang)

        def shares(of):
            total = sum(of)
            return [1 + 10**9 * (n + 5) // (total + 5 * len(terms)) for n in of]

        table = {s: [counts[lang, s, w] for w in terms] for s in sources}
        p, q = {s: shares(x) for s, x in table.items()}, shares([sum(x) for x in zip(*table.values())])
        for s in sources:
            pairs = sorted((-sum(abs(x - y) for x, y in zip(p[s], p[o])), o.encode()) for o in sources if o != s)
            words = sorted((y - x, w.encode()) for w, n, x, y in zip(terms, table[s], p[s], q, strict=True) if n and x > y)[:top]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", words)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_divergence_of_the_table(spark, documents):
    got = audited(queries.op13_source_divergence(spark, SF))
    assert got == plain_audit([(t, a, b) for _, t, a, b in documents])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == sorted(con.execute(f"select lang, source, part, item, value, rank from ({queries.ORACLES['op13_source_divergence']})").fetchall())


@pytest.mark.parametrize("team, block, held, band", [(128, 2048, 400_000, 4_000_000), (1, 3, 5, 1), (2, 1, 1, 7)])
def test_divergence_by_small_blocks_and_teams(odd, monkeypatch, team, block, held, band):
    for name, value in (("TEAM", team), ("BLOCK_TERMS", block), ("HELD", held), ("AT_ONCE", band)):
        monkeypatch.setattr(divergence, name, value)
    got = audited(divergence.audit(odd, least_docs=2, top=3))
    assert got == plain_audit([(r[1], r[2], r[3]) for r in rows_of(ODD)], 2, 3) and any(r[2] == "term" for r in got)


def test_divergence_without_terms(spark, odd):
    assert audited(divergence.audit(odd.where("text is null or text = ''"))) == [], "a source alone in its language"
    two = spark.createDataFrame([("", None, None), (None, "", "s"), ("1 2", "", "s")], "text string, lang string, source string")
    assert audited(divergence.audit(two)) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]
    assert divergence.audit(odd.where("false")).count() == 0


def test_shares_are_exact():
    draw = np.random.default_rng(3)
    for _ in range(300):
        v = int(draw.integers(1, 10**6))
        total = int(draw.integers(0, 8 * 10**15))
        count = int(draw.integers(0, total + 1))
        assert int(divergence.share(np.int64(count), np.int64(total), v)) == 1 + 10**9 * (count + 5) // (total + 5 * v)
