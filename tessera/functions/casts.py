"""Guarded conversions: each gives struct<value, issue>, and never raises.

Spark's own casts accept more than is meant here (a year as a date, "yes" as a
boolean) and less ("12.0" as an integer), so a pattern decides first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"
DECIMAL = "decimal(38,18)"


def _checked(text: Column, value: Column, issue: str) -> Column:
    return F.struct(value.alias("value"), F.when(text.isNotNull() & value.isNull(), issue).alias("issue"))


def to_decimal(text: Column) -> Column:
    trimmed = F.btrim(text)
    return _checked(text, F.when(trimmed.rlike(NUMBER), trimmed.try_cast(DECIMAL)), "INVALID_DECIMAL")


def to_integer(text: Column) -> Column:
    """Whole numbers, also written as 12.0 or 1e3; fractions are refused."""
    number = to_decimal(text)["value"]
    return _checked(text, F.when(number == F.floor(number), number.try_cast("bigint")), "INVALID_INTEGER")


def to_boolean(text: Column, true: tuple[str, ...] = ("true",), false: tuple[str, ...] = ("false",)) -> Column:
    low = F.lower(F.btrim(text))
    return _checked(text, F.when(low.isin(*true), True).when(low.isin(*false), False), "INVALID_BOOLEAN")


def to_date(text: Column, formats: tuple[str, ...] = ()) -> Column:
    """ISO dates, then the formats in order; a time of day is refused."""
    trimmed = F.btrim(text)
    iso = F.when(trimmed.rlike(DATE), F.try_to_date(trimmed, "yyyy-MM-dd"))
    return _checked(text, F.when(~trimmed.rlike("[T ]"), F.coalesce(iso, *[F.try_to_date(trimmed, f) for f in formats])), "INVALID_DATE")


def to_datetime(text: Column, formats: tuple[str, ...] = (), promote_dates: bool = True) -> Column:
    """ISO date-times (UTC where none is named), then the formats; dates become midnight where promoted."""
    trimmed = F.btrim(text)
    tries = [F.when(trimmed.rlike(DATETIME), trimmed.try_cast("timestamp"))]
    if promote_dates:
        tries.append(F.when(trimmed.rlike(DATE), trimmed.try_cast("timestamp")))
    tries += [F.try_to_timestamp(trimmed, F.lit(f)) for f in formats]
    return _checked(text, F.coalesce(*tries), "INVALID_DATETIME")


def to_binary(text: Column) -> Column:
    ok = text.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return _checked(text, F.when(ok, F.unbase64(F.when(ok, text))), "INVALID_BASE64")


def to_text(value: Column, kind: str) -> Column:
    """Text of a typed value; booleans are refused, times are written in UTC."""
    if kind == "boolean":
        return _checked(value, F.lit(None).cast("string"), "BOOLEAN_NOT_TEXT")
    if kind == "timestamp":
        return _checked(value, F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "INVALID_TEXT")
    return _checked(value, value.cast("string"), "INVALID_TEXT")


CASTS = {"integer": to_integer, "decimal": to_decimal, "boolean": to_boolean, "date": to_date, "datetime": to_datetime, "binary": to_binary}
