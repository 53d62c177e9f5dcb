"""Transformation rules: a closed registry of operations, compiled to columns.

A compiled rule maps a value column to struct<value, issue>; a chain stops at
the first issue.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import casts, text

Step = tuple[Column, Column]  # value and issue, both text
_PYTHON_FORMAT = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM"}


def no_issue() -> Column:
    return F.lit(None).cast("string")


def java_format(strptime: str) -> str:
    return re.sub(r"%[a-zA-Z]", lambda m: _PYTHON_FORMAT[m[0]], strptime)


def _copy(value: Column) -> Step:
    return value, no_issue()


def _cast(value: Column, to: str) -> Step:
    out = casts.CASTS[to](value)
    return out["value"].cast("string"), out["issue"]


def _default(value: Column, value_if_null: str) -> Step:
    return F.coalesce(value, F.lit(value_if_null)), no_issue()


def _enum_map(value: Column, mapping: dict[str, str], fallback: str | None = None, passthrough: bool = False) -> Step:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    known = F.try_element_at(table, value)
    otherwise = F.lit(fallback) if fallback is not None else value if passthrough else no_issue()
    return F.when(F.map_contains_key(table, F.coalesce(value, F.lit(""))), known).otherwise(otherwise), F.when(value.isNotNull() & known.isNull(), "UNKNOWN_ENUM_VALUE")


def _nested_path(value: Column, path: str) -> Step:
    return F.get_json_object(value, "$." + path), no_issue()


def _date_parse(value: Column, format: str) -> Step:
    parsed = F.try_to_date(value, java_format(format))
    return parsed.cast("string"), F.when(value.isNotNull() & parsed.isNull(), "DATE_PARSE_FAILED")


def _split(value: Column, separator: str, index: int) -> Step:
    part = F.try_element_at(F.split(value, re.escape(separator)), F.lit(index + 1 if index >= 0 else index))
    return part, F.when(value.isNotNull() & part.isNull(), "SPLIT_INDEX_OUT_OF_RANGE")


def _trim(value: Column, chars: str | None = None) -> Step:
    return F.btrim(value) if chars is None else F.btrim(value, F.lit(chars)), no_issue()


def _constant(value: Column, to: str) -> Step:
    return F.lit(to), no_issue()


def _redact(value: Column, mask: str = "***") -> Step:
    return F.when(value.isNotNull(), mask), no_issue()


def _null_markers(value: Column, markers: Sequence[str]) -> Step:
    return text.null_if_marked(value, tuple(markers)), no_issue()


OPERATIONS: dict[str, Callable[..., Step]] = {
    "copy": _copy, "rename": _copy, "cast": _cast, "default": _default, "enum_map": _enum_map, "nested_path": _nested_path, "date_parse": _date_parse, "split": _split, "trim": _trim,
    "constant": _constant, "redact": _redact, "null_markers": _null_markers,
}


def concat(fields: Sequence[Column], separator: str = "", skip_missing: bool = True) -> Column:
    """struct<value, issue>: the fields joined; without ``skip_missing`` a null one is an issue."""
    joined = F.concat_ws(separator, *fields)
    if skip_missing:
        return F.struct(joined.alias("value"), no_issue().alias("issue"))
    missing = F.exists(F.array(*fields), lambda x: x.isNull())
    return F.struct(F.when(~missing, joined).alias("value"), F.when(missing, "CONCAT_INPUT_NULL").alias("issue"))


def at_key(value: Column, key: Column) -> Column:
    """struct<value, issue>: the text that a JSON object holds at each row's own key, whatever characters the key has."""
    return F.struct(F.try_element_at(F.from_json(value, "map<string,string>"), key).alias("value"), no_issue().alias("issue"))


def compiled(chain: Sequence[tuple[str, dict]], value: Column) -> Column:
    """struct<value, issue> of a chain of (operation, options); unknown operations are refused at once."""
    issue = no_issue()
    for name, options in chain:
        if name not in OPERATIONS:
            raise ValueError(f"unknown rule operation {name!r}")
        new, found = OPERATIONS[name](value, **options)
        value, issue = F.when(issue.isNull() & found.isNull(), new), F.coalesce(issue, F.when(issue.isNull(), found))
    return F.struct(value.alias("value"), issue.alias("issue"))
