"""Token ids by the ``tokenizers`` library, one lookup a word.

Both public vocabularies split a text into pre-tokens before any merge, so a
word between isolated spaces has the same ids wherever it stands. Each worker
keeps the ids of words it has met, in a dictionary of bounded size, and asks
the library only for new ones. Texts that spell a special token of the
vocabulary go through the library's whole encoder, whose defaults hold.

The byte vocabulary takes many texts at once: each different word of them is
looked up once, the new ones go to the library's model in one call (the space
before a word begins a token of its own, which tells the words apart), and the
texts' ids are gathered by word, each word's from those of its letters and of
what follows them. Words outside plain Latin letters, and in the byte vocabulary
texts with runs of white space, go through the whole encoder.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words remembered by a worker in each of two generations; the older one goes when the newer is full.
CACHE_WORDS = 600_000
#: Longer words are not remembered, so that their number bounds the memory.
CACHE_LENGTH = 64

_PLAIN = re.compile("[!-~¡-¬®-įı-ɏ]+").fullmatch
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
_PLAIN_LINES = re.compile("[!-~¡-¬®-įı-ɏ][\n!-~¡-¬®-įı-ɏ]*(?<!\n)").fullmatch
_BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+").findall
#: Latin letters, other signs of ASCII than the apostrophe after them, and a line end with the letters after it.
_LETTERS = "[A-Za-zªµºÀ-ÖØ-öø-ɏ]+"
_PARTS = rf"\A(?P<head>{_LETTERS})(?P<signs>[!-&(-/:-@\[-`{{-~]*)(?P<line>\n?)(?P<after>(?:{_LETTERS})?)\z"
_STOPS = ".,;:!?"
_RUN = re.compile(r"\s\s").search
_NO_IDS = np.zeros(0, "<u4")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Words(dict):
    """Bytes of a word's ids (little-endian, unsigned, 32 bits), made when first asked for."""

    def __init__(self, make: Callable, most: int = CACHE_WORDS) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word):
        out = self.older.get(word)
        if out is None:
            out = self.make(word)
            if len(word) > CACHE_LENGTH:
                return out
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def keep(self, word, out) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = out


class Encoder:
    """Encodes whole texts to the bytes of their ids, as the tokenizer file at ``path`` does."""

    def __init__(self, path: str, remembered: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        alphabet = byte_alphabet()
        self.spelled = {c: "".join([alphabet[b] for b in c.encode()]) for c in map(chr, range(0x250))}
        if self.whole.normalizer is not None:
            self.words = _Words(self._word, remembered)
            self.begins = None
        else:
            self.words, self.firsts, self.tails = _Words(self._spaced, remembered), _Words(self._exactly, remembered), _Words(self._piece, remembered)
            self.pieces = Tokenizer(self.whole.model)  # takes pre-tokens as they are, between spaces
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.space, self.spell = alphabet[32], str.maketrans(self.spelled)
            vocabulary = self.whole.get_vocab()
            self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that start with a space
            self.begins[[i for token, i in vocabulary.items() if token[0] == alphabet[32]]] = True

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, little-endian and unsigned in 32 bits; none for a null."""
        out, together = [_NO_IDS] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any([s in text for s in self.special]):
                out[i] = np.frombuffer(self._exactly(text), "<u4")
            elif self.begins is None:
                out[i] = np.frombuffer(self._encode_words(text), "<u4")
            elif _RUN(text):
                out[i] = np.frombuffer(self._exactly(text), "<u4")
            else:
                together.append(i)
        if together:
            for i, ids in zip(together, self._encode_spaced([texts[i] for i in together]), strict=True):
                out[i] = ids
        return out

    def _exactly(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() or piece.isspace():
            piece = "".join(map(self.spelled.__getitem__, piece))
        elif piece[0] == " ":
            piece = self.spelled[" "] + piece[1:]
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()

    def _pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self._piece, pieces))

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and text.isascii():
            lower = text.lower()
            return self._piece(lower) if lower == text else self.words[lower.encode()]
        if not _PLAIN(text):
            return self._exactly(text)
        core = text.rstrip(_STOPS)
        if core != text and core and core[-1].isalnum():  # stops are pre-tokens of their own after a letter or digit
            return self.words[core.encode()] + self.words[text[len(core) :].encode()]
        lower = "".join([c.lower() for c in text])
        if lower != text:
            return self.words[lower.encode()]
        return self._piece(text) if text.isalpha() else self._pieces(_WORD_PIECES(text))

    def _encode_words(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.encode().split()))

    def _spaced(self, word: str) -> bytes:
        return self._exactly(" " + word)

    def _heads(self, words: list[str]) -> list[bytes]:
        """Ids of different words of letters with a space before each; the new ones are encoded in one call."""
        known, older = self.words, self.words.older
        out = list(map(known.get, words))
        new = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            if (ids := older.get(words[i])) is None:
                new.append(i)
            else:
                out[i] = ids
                known.keep(words[i], ids)
        if new:
            asked = [words[i] for i in new]
            text = self.space + f" {self.space}".join(asked)
            if not text.isascii():
                text = f" {self.space}".join([x if x.isascii() else x.translate(self.spell) for x in asked])
                text = self.space + text
            ids = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts, data = (4 * np.flatnonzero(self.begins[ids])).tolist(), ids.tobytes()
            for i, word, a, b in zip(new, asked, starts, [*starts[1:], len(data)], strict=True):
                out[i] = made = data[a:b]
                if len(word) <= CACHE_LENGTH:
                    known.keep(word, made)
        return out

    def _odd(self, word: str) -> bytes:
        """Ids of any word with a space before it."""
        known = self.words
        ids = known.get(word) or known.older.get(word)
        if ids is None and _PLAIN_LINES(word):
            first, *others = _BYTE_PIECES(" " + word)
            ids = self._heads([first[1:]])[0] + b"".join(map(self.tails.__getitem__, others))
        if ids is None:
            return known[word]
        if len(word) <= CACHE_LENGTH:
            known.keep(word, ids)
        return ids

    def _found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of different words with a space before each: how many ids each has, and all ids. Letters, punctuation after
        them, a line end and the letters of the next line are pre-tokens of their own."""
        cut = pc.extract_regex(words, _PARTS)
        fits = pc.is_valid(cut).to_numpy(zero_copy_only=False)
        parts = [part.dictionary_encode() for part in cut.filter(pa.array(fits)).flatten()]
        odd = np.flatnonzero(~fits)
        ids_of = [self._odd(word) for word in words.take(pa.array(odd)).to_pylist()]
        at = np.empty((len(words), 4), np.int64)
        at[odd, 0] = np.arange(len(odd))
        for k, part in enumerate(parts):
            different = part.dictionary.to_numpy(zero_copy_only=False).tolist()
            at[fits, k] = part.indices.to_numpy(zero_copy_only=False) + len(ids_of)
            ids_of += self._heads(different) if not k else [self.tails[x] if x else b"" for x in different]
        at[odd, 1:] = len(ids_of)
        sizes = np.fromiter(map(len, [*ids_of, b""]), np.int64, len(ids_of) + 1) // 4
        return sizes[at].sum(1), _gathered(np.frombuffer(b"".join(ids_of), "<u4"), (np.cumsum(sizes) - sizes)[at.ravel()], sizes[at.ravel()])

    def _encode_spaced(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without runs of white space; only a text's first word has no space before it."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        codes, bounds = coded.indices.to_numpy().copy(), split.offsets.to_numpy()
        begins = bounds[:-1]
        firsts = [self.firsts[word] for word in coded.take(pa.array(begins)).to_pylist()]
        codes[begins] = np.arange(len(coded.dictionary), len(coded.dictionary) + len(texts))
        sizes, data = self._found(coded.dictionary)
        sizes = np.concatenate([sizes, np.fromiter(map(len, firsts), np.int64, len(firsts)) // 4])
        count = sizes[codes]
        ids = _gathered(np.concatenate([data, np.frombuffer(b"".join(firsts), "<u4")]), (np.cumsum(sizes) - sizes)[codes], count)
        return np.split(ids, np.cumsum(count)[bounds[1:-1] - 1])


def _gathered(data: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``data`` that begin there, one after the other."""
    at = np.repeat(begin - np.cumsum(count) + count, count)
    at += np.arange(len(at))
    return data[at]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = CACHE_WORDS) -> Encoder:
    """The worker's encoder for a tokenizer file, with so many words in a generation; loaded once."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]
