"""Queries of profiles, keys, catalogs of sources, vector payloads and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import profile
from tessera.operators.staging import shared_dir
from tessera.plans.registry import query
from tessera.sources.versioned import VersionedTable

_LINE = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
_TEXTS = ("l_returnflag", "l_linestatus")


def _profile_sql(columns):
    each = "SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*), 4) AS null_share, count(DISTINCT {c}) AS n_distinct, {numbers}, {lengths} FROM lineitem"
    numbers, lengths = "min(CAST({c} AS DOUBLE)) AS low, max(CAST({c} AS DOUBLE)) AS high", "min(length({c})) AS shortest, max(length({c})) AS longest, round(avg(length({c})), 4) AS mean_length"
    none = "NULL::DOUBLE AS low, NULL::DOUBLE AS high", "NULL::BIGINT AS shortest, NULL::BIGINT AS longest, NULL::DOUBLE AS mean_length"
    return " UNION ALL ".join(each.format(c=c, numbers=none[0] if c in _TEXTS else numbers.format(c=c), lengths=lengths.format(c=c) if c in _TEXTS else none[1]) for c in columns)


@query("profile_columns", _profile_sql(_LINE))
def profile_columns(load, spark):
    return profile.columns(load("lineitem"), list(_LINE)).withColumns({c: F.col(c).cast("bigint") for c in ("shortest", "longest")})


@query("profile_texts", "SELECT column_name, count(*) AS n, count(*) - count(v) AS n_null, count(DISTINCT v) AS n_distinct, min(length(v)) AS shortest, max(length(v)) AS longest, round(avg(length(v)), 4) AS mean_length FROM (SELECT unnest(['text', 'lang', 'source']) AS column_name, unnest([text, lang, source]) AS v FROM documents) GROUP BY 1")
def profile_texts(load, spark):
    found = profile.columns(load("documents"), ["text", "lang", "source"])
    return found.select("column_name", "n", "n_null", "n_distinct", F.col("shortest").cast("bigint").alias("shortest"), F.col("longest").cast("bigint").alias("longest"), "mean_length")


_KEYS = (("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ("l_linenumber", "l_orderkey"), ("l_orderkey",))


@query("unique_keys", " UNION ALL ".join(f"SELECT '{','.join(c)}' AS key, CAST(sum(n) AS BIGINT) AS rows_with_key, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n > 1) = 0 AS is_unique FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(c)})" for c in _KEYS if c[0] != "l_linenumber"))
def unique_keys(load, spark):
    return profile.unique_keys(load("lineitem"), list(_KEYS))


@query("value_summaries", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'null' ELSE 'string of ' || length(props) END AS props, 'decimal' AS value FROM events WHERE value IS NOT NULL")
def value_summaries(load, spark):
    hidden = F.when(F.col("event_id") % 5 != 0, F.col("props"))
    return load("events").where("value is not null").select("event_id", profile.value_summary(hidden, "string").alias("props"), profile.value_summary(F.col("value"), "decimal").alias("value"))


@query("source_selection", "SELECT source, lang, count(*) AS n FROM documents WHERE lower(source) NOT IN ('src3', 'src4') AND lang IN ('en', 'de') GROUP BY 1, 2")
def source_selection(load, spark):
    """A catalog of the sources that the documents show, by language as namespace."""
    catalog = load("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return profile.wanted(catalog, "lang", "source", exclude=("SRC3", "Src4"), include_namespaces=["EN", "de"])


@query("vector_payloads", "SELECT vec_id, array_to_string(list_filter(['label=' || label, CASE WHEN source IS NOT NULL THEN 'source=' || source END, CASE WHEN lang <> 'en' THEN 'lang=' || lang END], lambda x: x IS NOT NULL), ';') AS payload FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def vector_payloads(load, spark):
    texts = load("documents").select(F.col("doc_id").alias("vec_id"), "source", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), "text")
    made = profile.payload(load("embeddings").join(texts, "vec_id", "left"), ["vec_id"], ["label", "source", "lang"], "text")
    return made.select("vec_id", F.array_join(F.transform(F.map_entries("filters"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("payload"))


@query("optimistic_version_conflicts", "SELECT vec_id, CASE WHEN vec_id % 4 <> vec_id % 3 THEN 'conflict' ELSE 'applied' END AS outcome, CASE WHEN vec_id % 4 <> vec_id % 3 THEN vec_id % 4 ELSE vec_id % 4 + 1 END AS version FROM embeddings")
def optimistic_version_conflicts(load, spark):
    """Every vector's state is written under the version that its writer has seen; what another has written meanwhile stays."""
    v = F.col("vec_id")
    table = VersionedTable(spark, f"{shared_dir(spark)}/states-{uuid.uuid4().hex}", "vec_id", 16)
    table.create(load("embeddings").select("vec_id", F.lit("old").alias("state"), (v % 4).alias("version")))
    made, _ = table.merge(load("embeddings").select("vec_id", F.lit("new").alias("state"), (v % 3).alias("expected")))
    return table.read(made).select("vec_id", F.when(F.col("state") == "new", "applied").otherwise("conflict").alias("outcome"), "version")
