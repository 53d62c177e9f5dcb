"""Profiles of columns, uniqueness of keys, and what may be told of a value.

A profile reads a table once: a row becomes an entry for each column, equal
values of a column meet by partial counts, and what is left is one entry for
each different value. So distinct counts are exact and no row is copied once
for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, n, n_null, null_share, n_distinct, low, high, shortest, longest, mean_length): numbers have a range,
    texts have lengths; a blank text is a value. A table without rows has no profile."""
    kinds = dict(rows.dtypes)

    def entry(name: str) -> Column:
        number = F.col(name).cast("double") if kinds[name] in _NUMBERS or kinds[name].startswith("decimal") else F.lit(None).cast("double")
        length = F.length(name) if kinds[name] == "string" else F.lit(None).cast("int")
        value = F.col(name).cast("string")
        value = F.when(F.length(value) > 32, F.sha2(value, 256)).otherwise(value)  # long texts meet by their digest
        return F.struct(F.lit(name).alias("column_name"), value.alias("value"), number.alias("number"), length.alias("length"))

    each = rows.select(F.explode(F.array(*map(entry, names))).alias("e")).groupBy("e.column_name", "e.value", "e.number", "e.length").agg(F.count("*").alias("held"))
    there = F.col("value").isNotNull()
    n, n_null = F.sum("held"), F.coalesce(F.sum(F.when(~there, F.col("held"))), F.lit(0))
    return each.groupBy("column_name").agg(
        n.alias("n"), n_null.alias("n_null"), F.round(n_null / n, 4).alias("null_share"), F.count_if(there).alias("n_distinct"), F.min("number").alias("low"), F.max("number").alias("high"),
        F.min("length").alias("shortest"), F.max("length").alias("longest"), F.round(F.sum(F.col("length") * F.col("held")) / F.sum(F.when(F.col("length").isNotNull(), F.col("held"))), 4).alias("mean_length"),
    )


def unique_keys(rows: DataFrame, candidates: list[tuple[str, ...]]) -> DataFrame:
    """(key, rows_with_key, repeated, is_unique) of candidate keys; rows with a null part have no key. A candidate that only
    orders another's columns otherwise is that one."""
    seen: dict[frozenset, tuple[str, ...]] = {}
    for c in candidates:
        seen.setdefault(frozenset(c), c)
    out = None
    for c in seen.values():
        held = rows.select(*c).dropna("any").groupBy(*c).agg(F.count("*").alias("n"))
        own = held.agg(F.lit(",".join(c)).alias("key"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_with_key"), F.count_if(F.col("n") > 1).alias("repeated"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("is_unique", (F.col("repeated") == 0) & (F.col("rows_with_key") > 0))


def value_summary(value: Column, kind: str) -> Column:
    """What may be told of a value in a finding: its type and size, never itself."""
    return F.when(value.isNull(), "null").when(F.lit(kind == "string"), F.concat(F.lit("string of "), F.length(value.cast("string")).cast("string"))).otherwise(F.lit(kind))


def wanted(catalog: DataFrame, namespace: str, table: str, include: list[str] | None = None, exclude: tuple[str, ...] = (), system: tuple[str, ...] = ("information_schema", "pg_catalog", "sys"), include_namespaces: list[str] | None = None) -> DataFrame:
    """The entries of a catalog that are asked for: no system namespace, nothing excluded, and only what is included where
    anything is. Names differ in more than case."""
    space, name = F.lower(F.coalesce(F.col(namespace), F.lit(""))), F.lower(table)
    out = catalog.where(~space.isin(*map(str.lower, system)))
    if include_namespaces is not None:
        out = out.where(space.isin(*map(str.lower, include_namespaces)) if include_namespaces else F.lit(False))
    if exclude:
        out = out.where(~name.isin(*map(str.lower, exclude)))
    return out if include is None else out.where(name.isin(*map(str.lower, include)) if include else F.lit(False))


def payload(rows: DataFrame, always: list[str], filters: list[str], text: str | None = None, with_text: bool = False) -> DataFrame:
    """What travels with a vector: identity, the filters that have a value, as one map, and the text only where asked for."""
    entries = F.map_filter(F.create_map(*(x for c in filters for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull() & (F.btrim(v) != ""))
    shown = [F.col(text).alias("text")] if with_text and text else []
    return rows.select(*always, entries.alias("filters"), *shown)
