"""Queries of response adaptation: an event is a response, and each asks one of four questions of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import adapt, evaluate, forms
from tessera.plans.registry import query

#: Question, the fields its answer needs, those it doesn't, and, for the SQL, its content words with what its phrasing implies.
_QUESTIONS = (
    ("what is the amount and currency", ("amount", "currency"), ("sync_token", "row_version", "created_by", "contact.phone"), ("amount", "currency")),
    ("show the contact of the customer", ("contact.email", "contact.phone"), ("sync_token", "row_version", "items[].label"), ("contact", "customer", "email", "phone")),
    ("how many items", ("items[].quantity",), ("created_by", "currency", "contact.email"), ("items", "quantity", "count")),
    ("tell me everything", ("amount", "status", "event_id"), ("weather",), ("tell", "everything")),
)
#: Field, names of its canonical field, that field's entity, whether it identifies.
_MAPPING = (("amount", ("amount", "price"), "purchase", False), ("customer.contact.email", ("email",), "signup", False), ("event_id", ("event_id",), "purchase", True), ("status", ("status",), "error", False))
_BODY = """'{"data":{"amount":' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ',"created_by":"batch","currency":"EUR","customer":{"contact":{"email":"u' || user_id || '@example.com","phone":"' || (user_id * 7) || '"},"id":' || user_id
 || '},"event_id":' || event_id || ',"items":' || CASE WHEN event_id % 6 = 0 THEN '[]' ELSE '[{"label":"a","quantity":1},{"label":"b","quantity":2}]' END || ',"row_version":7,"status":"' || event_type || '","sync_token":"t' || event_id || '"},"ok":true,"server_time":"x"}'"""


def _cases(load):
    n = (F.col("event_id") % 4).cast("int")
    pick = lambda k: F.get(F.array(*(F.lit(q[0]) if k == 0 else F.array(*map(F.lit, q[k])) for q in _QUESTIONS)), n)
    body = F.try_parse_json(F.expr(_BODY.replace("VARCHAR", "STRING")))
    return load("events").select(F.col("event_id").alias("case_id"), F.col("event_type").alias("entity"), body.alias("body"), pick(0).alias("question"), pick(1).alias("relevant"), pick(2).alias("irrelevant"))


def _mapping(spark):
    return spark.createDataFrame([(f, list(n), e, i) for f, n, e, i in _MAPPING], "field string, names array<string>, of_entity string, is_identity boolean")


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_FOUR = lambda k: "[" + ", ".join(_list(q[k]) for q in _QUESTIONS) + "][1 + event_id % 4]"
_TOKENS = "list_filter(string_split(regexp_replace(lower({x}), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '')"
_TELLING = "CASE WHEN len(list_filter({t}, lambda w: NOT list_contains({s}, w))) > 0 THEN list_filter({t}, lambda w: NOT list_contains({s}, w)) ELSE {t} END".replace("{s}", _list(adapt.STRUCTURAL))
_NODES = f"""cases AS (SELECT event_id, event_type AS entity, {_BODY} AS body, {_FOUR(1)} AS relevant, {_FOUR(2)} AS irrelevant, {_FOUR(3)} AS asked FROM events),
raw AS (SELECT event_id, t.fullkey, t.type, CAST(t.value AS VARCHAR) AS value FROM cases, json_tree(cases.body) t WHERE t.fullkey <> '$' AND NOT regexp_matches(t.fullkey, '\\[[1-9]')),
leaves AS (SELECT event_id, regexp_replace(substr(fullkey, 3), '\\[0\\]', '[]') AS path, value FROM raw WHERE type NOT IN ('OBJECT', 'ARRAY') OR value IN ('[]', '{{}}')),
inside AS (SELECT event_id, substr(path, 6) AS field, value FROM leaves WHERE path LIKE 'data.%')"""
_COVER = "(CASE WHEN least(len({a}), len({b})) <= 0 THEN 0 ELSE round(len(list_intersect({a}, {b})) / least(len({a}), len({b})), 6) END)"
_MAP_SQL = "(VALUES " + ", ".join(f"('{f}', {_list(n)}, '{e}', {i})" for f, n, e, i in _MAPPING) + ") m(field, names, of_entity, is_identity)"
_SCORED = f"""{_NODES}, words AS (SELECT i.event_id, i.field, i.value, c.entity, CASE WHEN list_contains(asked, 'everything') THEN [] ELSE list_filter(asked, lambda w: w <> c.entity) END AS asked, names, of_entity, coalesce(is_identity, false) AS is_identity, list_distinct({_TELLING.replace('{t}', _TOKENS.replace('{x}', 'i.field'))}) AS own
 FROM inside i JOIN cases c USING (event_id) LEFT JOIN {_MAP_SQL} USING (field)),
scored AS (SELECT event_id, field, value, is_identity, round(0.45 * coalesce(list_max(list_transform(names, lambda n: {_COVER.format(a=f"list_filter(list_distinct({_TELLING.replace('{t}', _TOKENS.replace('{x}', 'n'))}), lambda w: w <> entity)", b='asked')})), 0)
 + 0.3 * {_COVER.format(a='list_filter(own, lambda w: w <> entity)', b='asked')} + 0.15 * CASE WHEN names IS NULL THEN 0 WHEN of_entity = entity THEN 1 ELSE 0.25 END + 0.1 * CASE WHEN is_identity THEN 1 ELSE 0 END, 6)::DOUBLE AS score FROM words)"""
_CHOSEN = "{x}_any AS (SELECT *, max(CASE WHEN score >= 0.25 AND NOT is_identity THEN 1 ELSE 0 END) OVER (PARTITION BY event_id) AS good FROM {scored}), {x}_n AS (SELECT *, NOT is_identity AND (score >= 0.25 OR good = 0) AS c FROM {x}_any), {x} AS (SELECT *, CASE WHEN is_identity THEN 'IDENTITY' WHEN c AND sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY score DESC, field ROWS UNBOUNDED PRECEDING) <= {most} THEN CASE WHEN good = 0 THEN 'FALLBACK' ELSE 'RELEVANT' END WHEN c THEN 'OVER_BUDGET' ELSE 'IRRELEVANT' END AS reason FROM {x}_n)"
_MOST = 6


@query("query_tokens", f"SELECT event_id, array_to_string({_FOUR(3)}, ' ') AS tokens FROM events")
def query_tokens(load, spark):
    return _cases(load).select(F.col("case_id").alias("event_id"), F.array_join(adapt.query_tokens(F.col("question")), " ").alias("tokens"))


@query("field_relevance", f"WITH {_SCORED} SELECT event_id, field, score FROM scored")
def field_relevance(load, spark):
    return evaluate.scored_fields(_cases(load), _mapping(spark)).select(F.col("case_id").alias("event_id"), "field", "score")


def _selected(load, spark):
    return adapt.selected(evaluate.scored_fields(_cases(load), _mapping(spark)), "case_id", _MOST)


@query("field_selection", f"WITH {_SCORED}, {_CHOSEN.format(x='chosen', scored='scored', most=_MOST)} SELECT event_id, field, reason FROM chosen")
def field_selection(load, spark):
    return _selected(load, spark).select(F.col("case_id").alias("event_id"), "field", "reason")


@query("removal_summary", f"WITH {_SCORED}, {_CHOSEN.format(x='chosen', scored='scored', most=_MOST)} SELECT reason, count(*) AS n FROM chosen WHERE reason IN ('IRRELEVANT', 'OVER_BUDGET') GROUP BY 1")
def removal_summary(load, spark):
    return _selected(load, spark).where("not selected").groupBy("reason").agg(F.count("*").alias("n"))


@query("adapt_props", f"WITH {_SCORED}, {_CHOSEN.format(x='chosen', scored='scored', most=_MOST)} SELECT event_id, field, value, reason FROM chosen WHERE reason NOT IN ('IRRELEVANT', 'OVER_BUDGET')")
def adapt_props(load, spark):
    """Response bodies unwrapped and flattened, their fields scored against the question, the relevant ones kept."""
    return _selected(load, spark).where("selected").select(F.col("case_id").alias("event_id"), "field", "value", "reason")


@query("adaptation_eval", f"""WITH {_SCORED}, {_CHOSEN.format(x='chosen', scored='scored', most=_MOST)}, {_CHOSEN.format(x='blind', scored='(SELECT * REPLACE (0.0::DOUBLE AS score) FROM scored)', most=_MOST)},
kept AS (SELECT 'raw' AS method, event_id, path AS field, value FROM leaves UNION ALL SELECT 'generic', event_id, field, value FROM inside
 UNION ALL SELECT 'adaptive', event_id, field, value FROM chosen WHERE reason NOT IN ('IRRELEVANT', 'OVER_BUDGET') UNION ALL SELECT 'adaptive_all', event_id, field, value FROM blind WHERE reason NOT IN ('IRRELEVANT', 'OVER_BUDGET')),
out AS (SELECT method, event_id, list(field) AS fields, count(*) AS output_fields, 1 + sum(strlen(value) + strlen(field) + 4) AS output_bytes FROM kept GROUP BY 1, 2),
met AS (SELECT method, c.entity, len(list_filter(relevant, lambda r: len(list_filter(fields, lambda f: f = r OR suffix(f, '.' || r))) > 0)) AS kept, len(relevant) AS wanted,
 len(list_filter(irrelevant, lambda r: len(list_filter(fields, lambda f: f = r OR suffix(f, '.' || r))) = 0)) AS removed, len(irrelevant) AS unwanted, n AS input_fields, output_fields, strlen(body) AS input_bytes, CASE WHEN method = 'raw' THEN strlen(body) ELSE output_bytes END AS output_bytes
 FROM out JOIN cases c USING (event_id) JOIN (SELECT event_id, count(*) AS n FROM leaves GROUP BY 1) USING (event_id))
SELECT method, entity, CAST(grouping(method, entity) AS BIGINT) AS level, count(*) AS cases, round(sum(kept) / sum(wanted), 6) AS recall, round(count(*) FILTER (kept = wanted) / count(*), 6) AS perfect, round(sum(removed) / sum(unwanted), 6) AS removal,
 round(1 - sum(output_fields) / sum(input_fields), 6) AS field_reduction, round(1 - sum(output_bytes) / sum(input_bytes), 6) AS byte_reduction FROM met GROUP BY GROUPING SETS ((method, entity), (method))""")
def adaptation_eval(load, spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt out: a few megabytes of events are much work
    held = forms.summed(_cases(lambda name: load(name).select("event_id", "user_id", "event_type", "value").repartition(n, "event_id")))
    return evaluate.totals(held, evaluate.produced(held, _mapping(spark), _MOST))
