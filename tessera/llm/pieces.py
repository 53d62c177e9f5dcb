"""SentencePiece encoding and decoding by N-best search over the piece lattice.

The lattice of a text has an edge for every piece that matches somewhere, with
the piece's score, and for every character without a piece of its own one edge
of its bytes' ids (``BYTE_PENALTY`` below the least ordinary score). A forward
Viterbi pass gives the best score of reaching each position; backward A* from
the end takes these as its heuristic, which is exact, so segmentations leave the
queue in the order of their scores. Since every entry of the queue ends in a
segmentation of just its own score, the queue keeps no more entries than are
still to be found, and an entry is followed to the start along its best edges:
N walks give the N best, however many segmentations tie. All words that a batch
of texts brings anew are searched side by side, as arrays.

Between two characters that stand next to each other in no piece every
segmentation has a boundary. Words are cut there, the parts' N-best lists are
kept in a bounded dictionary, and a text's N-best list is that of the sums of
its parts: only the N - 1 parts with the smallest gaps can differ from their
best in it. For two of each, the lists are rows of arrays (``Pairs``), and those
of all words and texts of a batch are put together at once.

The model's normalisation is the identity with a leading space, spaces written
as U+2581. Decoding joins the pieces and undoes that; it gives the text back,
but for U+2581 itself, which becomes a space.

Nulls: a null text has no pieces, as an empty one; null ids and repeated rows
are kept; an empty table gives no rows; other columns are ignored. Of equal
scores the one that departs from a better one nearer the start comes first, and
at one place the longer piece.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices
from tessera.llm.tokens import CACHE_LENGTH, _Words

NBEST = 2
BYTE_PENALTY = 10.0
SPACE = "▁"
_OTHERS = re.compile(r"[\W\d_]+").finditer
#: N-best lists remembered by a worker in each of two generations; twice as many as rows of arrays.
CACHE_LISTS = 300_000
#: Bytes of text that are split and put together at once.
SLICE = 2_000_000
#: Cells of the path arrays of units that are searched together.
_CELLS = 1 << 21
#: (ids as bytes, score, gaps), gaps being (score below the best, ids) of the other segmentations, in order.
Found = tuple[bytes, float, tuple]
#: For each unit: score and number of ids, 0 where there is no such segmentation; and all ids.
Walk = tuple[np.ndarray, np.ndarray, np.ndarray]


def split_words(text: str) -> list[str]:
    """Words at single spaces; further spaces go before the word that follows them."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
    return text.split(" ") if text else []


class Trie:
    """Pieces by their characters. Nodes are numbers, 0 the root; a step looks up node and character together."""

    def __init__(self, pieces: list[tuple[str, int, float]]) -> None:
        """``pieces``: (text, id, score)."""
        chars = {c: k for k, c in enumerate(sorted({c for text, _, _ in pieces for c in text}), 1)}
        self.kinds = len(chars) + 1
        self.kind = np.zeros(0x110000, np.int64)  # 0: in no piece
        self.kind[[ord(c) for c in chars]] = [*chars.values()]
        steps: dict[int, int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for text, i, score in pieces:
            node = 0
            for c in text:
                node = steps.setdefault(node * self.kinds + chars[c], len(steps) + 1)
            ends[node] = (i, score)
        at = sorted(steps)
        self.keys, self.nodes = np.array(at, np.int64), np.array([steps[k] for k in at], np.int64)
        self.piece, self.score = np.full(len(steps) + 1, -1, np.int64), np.zeros(len(steps) + 1)
        self.piece[[*ends]], self.score[[*ends]] = [i for i, _ in ends.values()], [x for _, x in ends.values()]

    def step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none."""
        key = node * self.kinds + kind
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (kind > 0), self.nodes[at], -1)


class Pairs:
    """The two best segmentations of words (``words``, by what follows their space) and of units within words
    (``inner``) as rows of arrays; when there are more than ``most``, the half used longest ago goes."""

    def __init__(self, most: int) -> None:
        self.most, self.turn, self.n, self.n_ids = most, 0, 0, 0
        self.words: dict[str, int] = {}
        self.inner: dict[str, int] = {}
        self.score, self.gap, self.used = np.zeros(1 << 10), np.zeros(1 << 10), np.zeros(1 << 10, np.int64)
        self.begin, self.size = np.zeros((1 << 10, 2), np.int64), np.zeros((1 << 10, 2), np.int32)  # of the best's ids and the second's
        self.ids = np.zeros(1 << 12, "<u4")

    def _put(self, name: str, n: int, more: np.ndarray) -> None:
        held = getattr(self, name)
        if n + len(more) > len(held):
            held = np.concatenate([held[:n], np.zeros((max(len(more), n // 2), *held.shape[1:]), held.dtype)])
            setattr(self, name, held)
        held[n : n + len(more)] = more

    def add(self, best: Walk, second: Walk | None = None, gap: np.ndarray | None = None) -> int:
        """The first of the new rows. Where the second has no ids there is none."""
        total, sizes, ids = best
        others, other_sizes, other_ids = second or (total, np.zeros(len(total), np.int64), ids[:0])
        begin = self.n_ids + np.cumsum(sizes) - sizes
        other_begin = self.n_ids + len(ids) + np.cumsum(other_sizes) - other_sizes
        self._put("ids", self.n_ids, np.concatenate([ids, other_ids]))
        for name, x in (("score", total), ("gap", np.where(other_sizes > 0, total - others if gap is None else gap, np.inf)), ("used", np.full(len(total), self.turn)), ("begin", np.stack([begin, other_begin], 1)), ("size", np.stack([sizes, other_sizes], 1))):
            self._put(name, self.n, x)
        self.n_ids += len(ids) + len(other_ids)
        self.n += len(total)
        return self.n - len(total)

    def _gathered(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        return self.ids[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def joined(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each run of ``counts`` rows (one at least), the concatenation's score, gap, number of ids and ids, and number
        of ids and ids of its second: there the first of the members with the least gap takes its second."""
        if not len(rows):
            return np.zeros(0), np.zeros(0), counts, self.ids[:0], counts, self.ids[:0]
        run = np.repeat(np.arange(len(counts)), counts)
        scores = np.bincount(run, self.score[rows])  # in order
        first = np.cumsum(counts) - counts
        gap = self.gap[rows]
        least = np.minimum.reduceat(gap, first)
        lowest = np.flatnonzero(gap == least[run])
        changed = lowest[np.searchsorted(lowest, first)]
        begin, size = self.begin[rows, 0], self.size[rows, 0].astype(np.int64)
        other_begin, other_size = begin.copy(), np.where((least < np.inf)[run], size, 0)
        other_begin[changed], other_size[changed] = self.begin[rows[changed], 1], self.size[rows[changed], 1]
        return scores, least, np.add.reduceat(size, first), self._gathered(begin, size), np.add.reduceat(other_size, first), self._gathered(other_begin, other_size)

    def trim(self) -> None:
        self.turn += 1
        if self.n <= self.most and self.n_ids <= 32 * self.most:
            return
        kept = np.flatnonzero(self.used[: self.n] > np.median(self.used[: self.n]))
        number = np.full(self.n, -1)
        number[kept] = np.arange(len(kept))
        number = number.tolist()
        self.words, self.inner = ({name: number[row] for name, row in of.items() if number[row] >= 0} for of in (self.words, self.inner))
        size = self.size[kept]
        ids = self._gathered(self.begin[kept].ravel(), size.ravel().astype(np.int64))
        begin = (np.cumsum(size.ravel(), dtype=np.int64) - size.ravel()).reshape(-1, 2)
        self.score, self.gap, self.used, self.begin, self.size, self.ids = self.score[kept], self.gap[kept], self.used[kept], begin, size, ids
        self.n, self.n_ids = len(kept), len(ids)


class Lattice:
    """The pieces of a model as a trie, and N-best search over them."""

    def __init__(self, pieces: list[tuple[str, float, str]], nbest: int = NBEST) -> None:
        """``pieces``: (text, score, kind) by id; kind is "piece", "byte" or "other"."""
        self.nbest = nbest
        self.spelled = [text.encode() if kind == "piece" else bytes([int(text[1:-1], 16)]) if kind == "byte" else b"" for text, _, kind in pieces]
        self.byte_ids = {int(text[1:-1], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == "byte"}
        whole = [(text, i, score) for i, (text, score, kind) in enumerate(pieces) if kind == "piece"]
        self.pairs = {x + y for text, _, _ in whole for x, y in zip(text, text[1:])}
        self.byte_score = min((score for _, _, score in whole if score > -1e8), default=0.0) - BYTE_PENALTY
        self.trie = Trie(whole)
        self.lists = Pairs(2 * CACHE_LISTS)
        self.parts, self.words = _Words(lambda unit: self.search([unit])[0], CACHE_LISTS), _Words(self._word, CACHE_LISTS)

    def search(self, units: list[str]) -> list[Found]:
        """N-best lists of units of one character at least."""
        found: list = [None] * len(units)
        for group, walks in self._walks(units):
            lists: list[list[tuple[float, bytes]]] = [[] for _ in group]
            for total, sizes, ids in walks:
                data, last = ids.tobytes(), 0
                for segmentations, score, to in zip(lists, total.tolist(), (4 * np.cumsum(sizes)).tolist(), strict=True):
                    if to > last:
                        segmentations.append((score, data[last:to]))
                    last = to
            for k, x in zip(group, lists, strict=True):
                found[k] = x[0][1], x[0][0], tuple([(x[0][0] - score, ids) for score, ids in x[1:]])
        return found

    def _walks(self, units: list[str]) -> Iterator[tuple[list[int], list[Walk]]]:
        """Numbers of units that are searched together, and their segmentations, best ones first."""
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        i = 0
        while i < len(order):  # units of about one length together
            j = i + 1
            while j < len(order) and (j + 1 - i) * len(units[order[j]]) <= _CELLS:
                j += 1
            yield order[i:j], self._searched([units[k] for k in order[i:j]])
            i = j

    def _edges(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """Positions are numbered through all units, n + 1 for n characters. Edges by their end, longer ones first:
        (from, to, id, score), -1 for the id of a character as its bytes; and the characters' codes."""
        lengths = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        unit = np.repeat(np.arange(len(units)), lengths)
        at = np.arange(len(codes)) + unit  # the position before each character
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters to the end of the unit
        kinds = self.trie.kind[codes]
        here = np.arange(len(codes))
        node = self.trie.step(np.zeros(len(codes), np.int64), kinds)
        own = np.where(node >= 0, self.trie.piece[node], -1)
        bare = np.flatnonzero(own < 0)
        bytes_of = 1 + (codes[bare] > 0x7F) + (codes[bare] > 0x7FF) + (codes[bare] > 0xFFFF)
        parts = [(at[bare], at[bare] + 1, np.full(len(bare), -1), self.byte_score * bytes_of)]
        depth = 1
        while True:
            alive = node >= 0
            here, node = here[alive], node[alive]
            if not len(here):
                break
            ends = self.trie.piece[node] >= 0
            parts.append((at[here[ends]], at[here[ends]] + depth, self.trie.piece[node[ends]], self.trie.score[node[ends]]))
            more = left[here] > depth
            here, node = here[more], node[more]
            node = self.trie.step(node, kinds[here + depth])
            depth += 1
        start, end, piece, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((start, end))
        return start[by], end[by], piece[by], score[by], codes

    def _searched(self, units: list[str]) -> list[Walk]:
        n = len(units)
        lengths = np.array([len(u) for u in units])
        first = np.concatenate([[0], np.cumsum(lengths + 1)])  # each unit's first position, its last being before the next's
        start, end, piece, score, codes = self._edges(units)
        edge_of = np.searchsorted(end, np.arange(first[-1] + 1))  # the edges into each position
        # forward: the best score of reaching each position, and the edge that does
        best, back = np.zeros(first[-1]), np.full(first[-1], -1)
        for k in range(1, int(lengths.max()) + 1):
            to = first[:-1][lengths >= k] + k
            count = edge_of[to + 1] - edge_of[to]
            group = np.concatenate([[0], np.cumsum(count)])
            edges = np.arange(group[-1]) + np.repeat(edge_of[to] - group[:-1], count)
            reached = best[start[edges]] + score[edges]
            top = np.maximum.reduceat(reached, group[:-1])
            best[to] = top
            back[to] = np.minimum.reduceat(np.where(reached == np.repeat(top, count), edges, len(start)), group[:-1])
        # backward: entries of the queue are (unit, -f, steps from the end, edge, score after it, walk it departs from)
        walks: list[Walk] = []
        paths: list[np.ndarray] = []
        queue = tuple(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, float, np.int64))
        unit, at, after, depth = np.arange(n), first[1:] - 1, np.zeros(n), np.zeros(n, np.int64)
        path = np.zeros((n, int(lengths.max())), np.int64)
        while len(unit):
            wanted, met = self.nbest - len(paths) - 1, [queue]
            steps, total = np.zeros(n, np.int64), np.zeros(n)
            while len(unit):
                ended = at == first[unit]
                steps[unit[ended]], total[unit[ended]] = depth[ended], after[ended]
                unit, at, after, depth = (x[~ended] for x in (unit, at, after, depth))
                edge = back[at]
                if wanted and len(unit):
                    count = edge_of[at + 1] - edge_of[at]
                    group = np.concatenate([[0], np.cumsum(count)])
                    other = np.arange(group[-1]) + np.repeat(edge_of[at] - group[:-1], count)
                    owner = np.repeat(np.arange(len(unit)), count)
                    apart = other != edge[owner]
                    other, owner = other[apart], owner[apart]
                    behind = after[owner] + score[other]
                    met.append((unit[owner], -(behind + best[start[other]]), depth[owner], other, behind, np.full(len(other), len(paths))))
                path[unit, depth] = edge
                at, after, depth = start[edge], after + score[edge], depth + 1
            paths.append(path)
            walks.append((total, *self._spelt(path, steps, start, piece, codes)))
            if not wanted:
                return walks
            queue = tuple(np.concatenate(x) for x in zip(*met, strict=True))
            by = np.lexsort((start[queue[3]], -queue[2], queue[1], queue[0]))
            queue = tuple(x[by] for x in queue)
            place = np.arange(len(by)) - np.searchsorted(queue[0], queue[0])  # within the unit
            unit, _, depth, edge, after, parent = (x[place == 0] for x in queue)
            queue = tuple(x[(place > 0) & (place < wanted)] for x in queue)
            path = np.zeros_like(path)
            for w, earlier in enumerate(paths):
                path[unit[parent == w]] = earlier[unit[parent == w]]
            path[unit, depth] = edge
            at, depth = start[edge], depth + 1
        return walks

    def _spelt(self, path: np.ndarray, steps: np.ndarray, start: np.ndarray, piece: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each unit's path, which runs from the end to the start, spells, and all these ids."""
        unit, step = np.nonzero(np.arange(path.shape[1]) < steps[:, None])
        edges = path[unit, steps[unit] - 1 - step]
        ids = piece[edges]
        bare = np.flatnonzero(ids < 0)
        as_bytes = [chr(codes[start[e] - u]).encode() for e, u in zip(edges[bare].tolist(), unit[bare].tolist(), strict=True)]
        count = np.ones(len(ids), np.int64)
        count[bare] = [len(x) for x in as_bytes]
        ids = np.repeat(ids, count)
        ids[ids < 0] = [self.byte_ids[b] for x in as_bytes for b in x]
        return np.bincount(unit, weights=count, minlength=len(steps)).astype(np.int64), ids.astype("<u4")

    def _units(self, word: str) -> list[str]:
        """A word with the space before it, cut beside characters other than letters where two stand together in no
        piece; long words wherever two do."""
        unit = SPACE + word.replace(" ", SPACE)
        long = len(unit) > CACHE_LENGTH
        if word.isalpha() and not long:
            return [unit]
        pairs, cut, last = self.pairs, [], 0
        places = range(1, len(unit)) if long else sorted({k for m in _OTHERS(unit, 1) for k in range(m.start(), m.end() + 1)})
        for k in places:
            if k < len(unit) and unit[k - 1 : k + 1] not in pairs:
                cut.append(unit[last:k])
                last = k
        cut.append(unit[last:])
        return cut

    def _word(self, word: str) -> Found:
        """N-best list of a word."""
        return self.joined([self.parts[p] for p in self._units(word)])

    def learn(self, texts: list[list[str]]) -> None:
        """Searches all new units of the texts' words side by side, and keeps the words' N-best lists."""
        known, older, parts = self.words, self.words.older, self.parts
        cut = {w: self._units(w) for w in set().union(*texts) if w not in known and w not in older and len(w) < CACHE_LENGTH}
        units = [*{u for of_word in cut.values() for u in of_word if u not in parts and u not in parts.older}]
        new = dict(zip(units, self.search(units), strict=True))
        for word, of_word in cut.items():
            if len(of_word) == 1:
                known.keep(word, new[of_word[0]] if of_word[0] in new else parts[of_word[0]])
                continue
            for unit in of_word:
                if unit in new:
                    parts.keep(unit, new[unit])
            known.keep(word, self.joined([parts[u] for u in of_word]))

    def joined(self, units: list[Found]) -> Found:
        """N-best list of the concatenation."""
        if len(units) == 1:
            return units[0]
        ids, total, near = [], 0.0, []
        if self.nbest == 2:
            least, at = 1e300, -1
            for i, (x, score, gaps) in enumerate(units):
                ids.append(x)
                total += score
                if gaps and gaps[0][0] < least:
                    least, at = gaps[0][0], i
            best = b"".join(ids)
            if at < 0:
                return best, total, ()
            ids[at] = units[at][2][0][1]
            return best, total, ((least, b"".join(ids)),)
        for i, (x, score, gaps) in enumerate(units):
            ids.append(x)
            total += score
            if gaps:
                near.append((gaps[0][0], i))
        near = heapq.nsmallest(self.nbest - 1, near)
        top: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
        for _, i in near:
            more = [(gap + other, changed | {i: x}) for gap, changed in top for other, x in units[i][2]]
            top = heapq.nsmallest(self.nbest, top + more, key=lambda t: t[0])
        gaps = tuple([(gap, b"".join([changed.get(i, x) for i, x in enumerate(ids)])) for gap, changed in top[1:]])
        return b"".join(ids), total, gaps

    def of_texts(self, texts: list[str | None]) -> list[Found]:
        """N-best lists of whole texts, the new units of all their words searched side by side."""
        if self.nbest != 2:
            split = [split_words(text or "") for text in texts]
            self.learn(split)
            return [*map(self.of_words, split)]
        plain, odd = [], []
        for i, text in enumerate(texts):
            if text:
                (odd if "  " in text or text[0] == " " or text[-1] == " " else plain).append(i)
        split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        others = [split_words(texts[i]) for i in odd]
        counts = np.concatenate([np.diff(split.offsets.to_numpy()), np.array([*map(len, others)], np.int64)])
        coded = pa.concat_arrays([split.values, pa.array([*chain.from_iterable(others)], pa.large_string())]).dictionary_encode()
        rows = self._rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        scores, gaps, sizes, ids, other_sizes, other_ids = self.lists.joined(rows[coded.indices.to_numpy()], counts)
        out, last, other_last, best, second = [(b"", 0.0, ())] * len(texts), 0, 0, ids.tobytes(), other_ids.tobytes()
        for i, score, gap, to, other_to in zip(chain(plain, odd), scores.tolist(), gaps.tolist(), (4 * np.cumsum(sizes)).tolist(), (4 * np.cumsum(other_sizes)).tolist(), strict=True):
            out[i] = (best[last:to], score, ((gap, second[other_last:other_to]),) if other_to > other_last else ())
            last, other_last = to, other_to
        return out

    def _rows(self, words: list[str]) -> np.ndarray:
        """The rows of different words; new units are searched side by side, new words put together at once."""
        held = self.lists
        held.trim()
        rows = [*map(held.words.get, words)]
        single, several = {}, {}
        for word in [word for word, row in zip(words, rows, strict=True) if row is None]:
            cut = self._units(word)
            if len(cut) == 1:
                single[word] = cut[0]
            else:
                several[word] = cut
        inner = {}
        for cut in several.values():
            if (first := cut[0][1:]) not in held.words:
                single[first] = cut[0]
            for unit in cut[1:]:
                if unit not in held.inner:
                    inner[unit] = unit
        units = [*single.values(), *inner]
        place = np.zeros(len(units), np.int64)
        for group, walks in self._walks(units):
            place[group] = held.add(*walks) + np.arange(len(group))
        held.words.update(zip(single, place[: len(single)].tolist(), strict=True))
        held.inner.update(zip(inner, place[len(single) :].tolist(), strict=True))
        if several:
            members = [row for cut in several.values() for row in (held.words[cut[0][1:]], *map(held.inner.__getitem__, cut[1:]))]
            scores, gaps, sizes, ids, other_sizes, other_ids = held.joined(np.array(members), np.array([*map(len, several.values())]))
            at = held.add((scores, sizes, ids), (scores - gaps, other_sizes, other_ids), gaps)
            held.words.update(zip(several, range(at, at + len(several)), strict=True))
        found = np.array([held.words[word] if row is None else row for word, row in zip(words, rows, strict=True)], np.int64)
        held.used[found] = held.turn
        for names in (single, several, inner):  # long ones are not remembered, so that their number bounds the memory
            for name in [name for name in names if len(name) >= CACHE_LENGTH]:
                (held.inner if names is inner else held.words).pop(name, None)
        return found

    def encode(self, text: str) -> Found:
        return self.of_words(split_words(text))

    def of_words(self, words: list[str]) -> Found:
        return self.joined([*map(self.words.__getitem__, words)]) if words else (b"", 0.0, ())

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        spelled = self.spelled
        text = b"".join([spelled[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


_lattices: dict[tuple[str, int], Lattice] = {}


def lattice(model: str, nbest: int = NBEST) -> Lattice:
    """The worker's lattice for a model file; loaded once."""
    if (model, nbest) not in _lattices:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        kind = ["byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece" for i in range(sp.get_piece_size())]
        _lattices[model, nbest] = Lattice([(sp.id_to_piece(i), sp.get_score(i), k) for i, k in enumerate(kind)], nbest)
    return _lattices[model, nbest]


def encode(docs: DataFrame, model: str, nbest: int = NBEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: doc_id, ``nbest`` (score, ids as little-endian unsigned 32 bits; best first) and ``decoded``, the text of the best."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = lattice(model, nbest)
        for batch in slices(batches, "text", SLICE):
            lists, texts = [], []
            found = search.of_texts(batch.column(1).to_pylist())
            gc.freeze()  # what is remembered holds no cycles
            for ids, score, gaps in found:
                lists.append([{"score": score, "ids": ids}, *({"score": score - g, "ids": x} for g, x in gaps)])
                texts.append(search.decode(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind), pa.array(texts, pa.string())], ["doc_id", "nbest", "decoded"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, nbest array<struct<score: double, ids: binary>>, decoded string")
