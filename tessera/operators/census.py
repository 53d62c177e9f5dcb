"""Counts of what variants hold, from their bytes: a batch of records is walked where it lies and leaves one row for each path and kind.

An expression that walks a record makes every node a value of its own, over a millisecond a record of thirty nodes; the bytes
of a variant say what each node is without that. Names are looked up once for each different list of fields, paths are put
together once, and a task that remembers too many hands its counts on and starts afresh.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Paths, and lists of names, that a task remembers before it hands its counts on and starts afresh.
REMEMBERED = 50_000
COUNTS = "path string, kind string, n long, truncated boolean"

KINDS = ("null", "bool", "int", "long", "double", "string", "unknown", "object", "array")
_INT, _LONG, _DOUBLE, _OBJECT, _SEE = 2, 3, 4, 7, 9
#: Kinds by the first byte of a value: two bits tell short strings, objects and lists, six more the type of the others. Whole
#: numbers of 64 bits and decimals are seen by their value.
_TYPES = {0: 0, 1: 1, 2: 1, 3: _INT, 4: _INT, 5: _INT, 6: _SEE, 7: _DOUBLE, 8: _SEE, 9: _SEE, 10: _SEE, 14: _DOUBLE, 16: 5}
_KIND = [(None, 5, _OBJECT, 8)[head & 3] or _TYPES.get(head >> 2, 6) for head in range(256)]


def _whole(data: bytes, at: int, size: int) -> int:
    return data[at] if size == 1 else int.from_bytes(data[at : at + size], "little")


def _starts(data: bytes, at: int, n: int, size: int) -> Iterable[int]:
    if size == 1:
        return data[at : at + n]
    return struct.unpack_from(f"<{n}H", data, at) if size == 2 else [_whole(data, at + size * i, size) for i in range(n)]


def _seen(value: bytes, at: int) -> int:
    if value[at] >> 2 == 6:
        return _INT if -(2**31) <= int.from_bytes(value[at + 1 : at + 9], "little", signed=True) < 2**31 else _LONG
    return _DOUBLE if value[at + 1] else _LONG  # the scale as written: 1.0 is no whole number


def _names(metadata: bytes) -> tuple[str, ...]:
    """The dictionary of a variant."""
    size = (metadata[0] >> 6) + 1
    n = _whole(metadata, 1, size)
    ends = [_whole(metadata, 1 + size * (i + 1), size) for i in range(n + 1)]
    data = 1 + size * (n + 2)
    return tuple(metadata[data + a : data + b].decode() for a, b in zip(ends, ends[1:], strict=False))


class _Path:
    """What is known of a path, whatever way it was reached."""

    __slots__ = ("kinds", "last", "present", "truncated")

    def __init__(self) -> None:
        self.kinds, self.present, self.last, self.truncated = [0] * len(KINDS), 0, -1, False


class _Spot:
    """A place of the walk: a path, how many names deep it is, and the places below it, one by one and by lists of names."""

    __slots__ = ("below", "closed", "depth", "held", "inside", "lists", "path")

    def __init__(self, path: str, depth: int, held: _Path) -> None:
        self.path, self.depth, self.held, self.closed, self.below, self.lists, self.inside = path, depth, held, path.endswith("[]"), {}, {}, None


class _Census:
    def __init__(self, names_deep: int, most: int, remembered: int) -> None:
        self.names_deep, self.most, self.limit = names_deep, most, remembered
        self.afresh()

    def afresh(self) -> None:
        self.paths: dict[str, _Path] = defaultdict(_Path)
        self.dictionaries: dict[bytes, tuple[int, tuple[str, ...]]] = {}
        self.root, self.records, self.remembered = _Spot("", 0, self.paths[""]), 0, 0

    def full(self) -> bool:
        return max(len(self.paths), self.remembered) > self.limit

    def add(self, value: bytes | None, metadata: bytes | None) -> None:
        self.records += 1
        if value is None:
            return
        names = self.dictionaries.get(metadata)
        if names is None:
            names = self.dictionaries[metadata] = len(self.dictionaries), _names(metadata)
            self.remembered += 1
        if _KIND[value[0]] >= _OBJECT:
            self._inside(value, 0, names, self.root)

    def _below(self, spot: _Spot, ids: Iterable[int], names: tuple[int, tuple[str, ...]]) -> list[_Spot]:
        out = []
        for name in (names[1][i] for i in ids):
            if name not in spot.below:
                path = f"{spot.path}.{name}" if spot.path else name
                spot.below[name] = _Spot(path, spot.depth + 1, self.paths[path])
            out.append(spot.below[name])
        return out

    def _inside(self, value: bytes, at: int, names: tuple[int, tuple[str, ...]], spot: _Spot) -> None:
        """Counts the fields of an object, or the elements of a list, that is at ``spot``."""
        head = value[at]
        if head & 3 == 2:
            first = at + (5 if head & 64 else 2)
            n, wide, step = _whole(value, at + 1, first - at - 1), (head >> 4 & 3) + 1, (head >> 2 & 3) + 1
            if not n:
                return
            if spot.depth >= self.names_deep:
                spot.held.truncated = True
                return
            ends = first + n * wide
            key = names[0], value[first:ends]
            spots = spot.lists.get(key)
            if spots is None:
                spots = spot.lists[key] = self._below(spot, _starts(value, first, n, wide), names)
                self.remembered += 1
            data, starts = ends + (n + 1) * step, _starts(value, ends, n, step)
        else:
            if spot.closed:  # a list of lists says that its elements are lists and no more
                return
            first = at + (5 if head & 16 else 2)
            n, step = _whole(value, at + 1, first - at - 1), (head >> 2 & 3) + 1
            if not n:
                return
            if spot.inside is None:
                path = f"{spot.path}[]"
                spot.inside = _Spot(path, spot.depth, self.paths[path])
            spots, data, starts = repeat(spot.inside), first + (n + 1) * step, _starts(value, first, min(n, self.most), step)
        record = self.records
        for each, start in zip(spots, starts):  # noqa: B905  elements all have one spot
            place, held = data + start, each.held
            kind = _KIND[value[place]]
            if kind == _SEE:
                kind = _seen(value, place)
            held.kinds[kind] += 1
            if held.last != record:
                held.last = record
                held.present += 1
            if kind >= _OBJECT:
                self._inside(value, place, names, each)

    def counts(self) -> pa.RecordBatch:
        rows = [("", "record", self.records, False)]
        for path, held in self.paths.items():
            if path != "":  # the record itself, and fields without a name at its top
                rows += [(path, "present", held.present, held.truncated), *((path, kind, n, held.truncated) for kind, n in zip(KINDS, held.kinds, strict=True) if n)]
        paths, kinds, n, truncated = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.string()), pa.array(n, pa.int64()), pa.array(truncated, pa.bool_())], ["path", "kind", "n", "truncated"])


def counted(rows: DataFrame, record: Column, names_deep: int, most: int, remembered: int = REMEMBERED) -> DataFrame:
    """(path, kind, n, truncated) in parts that add up: how many values of a kind are at a path, as kind ``present`` how many
    records hold the path, and as kind ``record`` of the empty path how many records there are, null ones included.
    ``truncated``: the path has objects whose fields were not looked at."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        census = _Census(names_deep, most, remembered)
        for batch in batches:
            column = batch.column(0)
            there = column.is_valid().to_pylist()
            for known, value, metadata in zip(there, column.field("value").to_pylist(), column.field("metadata").to_pylist(), strict=True):
                census.add(value if known else None, metadata)
                if census.full():
                    yield census.counts()
                    census.afresh()
        yield census.counts()

    return rows.select(record.alias("record")).mapInArrow(walk, COUNTS)
