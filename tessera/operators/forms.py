"""Cases of response adaptation by their form: what differs in values alone is summed up in the batches that it comes in.

Which fields a method keeps follows from the fields' names, the entity and the question, never from values, so cases that
agree in these are one row: how many they are, and the bytes of each field's values. A task holds ``HELD`` forms at most and
then hands on what it has, so a form may come in several rows, whose numbers add up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.nested import DEEPEST
from tessera.operators.staging import staged

HELD = 20_000
COLUMNS = (
    "entity string, question string, relevant array<string>, irrelevant array<string>, raw array<string>, fields array<string>, "
    "cases long, input_fields long, input_bytes long, sizes array<long>"
)


class _Number(str):
    """A number as it is written."""

    __slots__ = ()


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _size(value) -> int:
    """Bytes of a value as compact JSON."""
    if isinstance(value, _Number):
        return len(value)
    if isinstance(value, str):
        return _bytes(encode_basestring(value))
    if isinstance(value, dict):
        return 1 + max(1, sum(_size(k) + _size(v) + 2 for k, v in value.items()))
    if isinstance(value, list):
        return 1 + max(1, sum(_size(v) + 1 for v in value))
    return 5 if value is False else 4


def _flat(value, path: str, depth: int, out: list) -> None:
    """The leaves that ``nested.flattened`` finds."""
    if depth <= DEEPEST:
        if isinstance(value, dict) and value:
            for name, below in value.items():
                _flat(below, f"{path}.{name}" if path else name, depth + 1, out)
            return
        if isinstance(value, list) and value and isinstance(value[0], dict):
            _flat(value[0], f"{path}[]", depth + 1, out)
            return
    out.append((path or "value", value))


def _leaves(value, depth: int = 0) -> int:
    """As ``nested.leaf_count``."""
    if depth > DEEPEST or not value or not isinstance(value, (dict, list)):
        return 1
    return sum(_leaves(v, depth + 1) for v in value.values()) if isinstance(value, dict) else _leaves(value[0], depth + 1)


def _measured(text: str | None, key: str) -> tuple[tuple[str, ...], tuple[str, ...], int, int | None, list[int]]:
    """Of a body: the paths of its leaves and of those inside the envelope, its leaves, its bytes, and those of the inner values."""
    if text is None:
        return (), (), 0, None, []
    body = json.loads(text, parse_int=_Number, parse_float=_Number)
    inside = body.get(key) if isinstance(body, dict) else None
    whole, inner = [], []
    _flat(body, "", 0, whole)
    _flat(inside if isinstance(inside, dict) else body, "", 0, inner)
    inner.sort(key=lambda x: x[0])
    return tuple(sorted(p for p, _ in whole)), tuple(p for p, _ in inner), _leaves(body), _bytes(text), [_size(v) for _, v in inner]


def summed(cases: DataFrame, key: str = "data", held: int = HELD) -> DataFrame:
    """(case_id, and ``COLUMNS``) of cases (entity, question, relevant, irrelevant, body): ``raw`` and ``fields`` are the paths of a
    body's leaves, without and with its envelope taken off; ``sizes`` the bytes of the fields' values. ``case_id`` is a row's own."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[tuple, list] = {}
        for batch in batches:
            for entity, question, relevant, irrelevant, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, fields, n, size, sizes = _measured(text, key)
                form = entity, question, None if relevant is None else tuple(relevant), None if irrelevant is None else tuple(irrelevant), raw, fields
                row = forms.get(form)
                if row is None:
                    if len(forms) >= held:
                        yield rows(forms)
                        forms = {}
                    row = forms[form] = [0, 0, None, [0] * len(sizes)]
                row[0] += 1
                row[1] += n
                if size is not None:
                    row[2] = size + (row[2] or 0)
                row[3] = [a + b for a, b in zip(row[3], sizes, strict=True)]
        yield rows(forms)

    def rows(forms: dict[tuple, list]) -> pa.RecordBatch:
        words, whole = pa.list_(pa.string()), pa.int64()
        kinds = (pa.string(), pa.string(), words, words, words, words, whole, whole, whole, pa.list_(whole))
        columns = zip(*((*form, *row) for form, row in forms.items()), strict=True) if forms else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array([list(x) if isinstance(x, tuple) else x for x in c], kind) for c, kind in zip(columns, kinds, strict=True)], names)

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    found = cases.select("entity", "question", "relevant", "irrelevant", F.to_json("body").alias("body")).mapInArrow(walk, COLUMNS)
    return staged(found.withColumn("case_id", F.monotonically_increasing_id()), "forms")  # written, so that a row keeps its id
