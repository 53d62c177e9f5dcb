"""Evaluation of response adaptation: what each method keeps of what an answer needs, and an ablation.

A case is a response body, a question and the labels of the fields that its
answer needs or does not. ``raw`` hands the body on, ``generic`` unwraps and
flattens it, ``adaptive`` selects fields by the question besides, and
``adaptive_all`` does all of that but the question (the ablation). A label is
met by a field of its name, or of a path that ends with ``.`` and the label.
Ratios of a group are those of its sums, never means of ratios; cases of one
form (``forms``) go through the methods together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import adapt, forms, nested

METHODS = ("raw", "generic", "adaptive", "adaptive_all")


def unwrapped(body: Column, key: str = "data") -> Column:
    """The record inside an envelope, or the body where it has none."""
    inside = F.try_variant_get(body, f"$.{key}", "variant")
    return F.when(F.try_variant_get(inside, "$", "map<string,variant>").isNotNull(), inside).otherwise(body)


def scored_fields(cases: DataFrame, mapping: DataFrame) -> DataFrame:
    """(case_id, entity, field, value, is_identity, score) of the cases' records. ``mapping`` (field, names, of_entity,
    is_identity) says which canonical fields the record's fields stand for; it has a row for each field at most.

    A score follows from field, entity and question, so each different one is worked out once and joined back.
    """
    fields = cases.select("case_id", "entity", "question", F.explode(nested.flattened(unwrapped(F.col("body")))).alias("field", "value"))
    return _scored(fields, mapping)


def _scored(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    known = fields.select("field", "entity", "question").distinct().join(mapping, "field", "left").withColumn("is_identity", F.coalesce("is_identity", F.lit(False)))
    score = adapt.relevance(F.col("field"), F.col("names"), F.col("of_entity"), F.col("is_identity"), F.col("entity"), F.col("question"))
    scores = known.select(F.struct("field", "entity", "question").alias("asked"), "is_identity", score.alias("score"))
    met = fields.withColumn("asked", F.struct("field", "entity", "question")).join(scores, "asked")  # a struct is never null itself
    return met.select("case_id", "entity", "field", "value", "is_identity", "score")


def produced(held: DataFrame, mapping: DataFrame, most: int = adapt.MOST_FIELDS) -> DataFrame:
    """(case_id, method, fields, output_fields, output_bytes) of every row of ``forms.summed`` and method; the last two are sums
    over the row's cases."""
    each = F.transform(F.arrays_zip("fields", "sizes"), lambda x: F.struct(x["fields"].alias("field"), x["sizes"].alias("value")))
    whole = held.select("case_id", F.lit("raw").alias("method"), F.col("raw").alias("fields"), F.col("input_fields").alias("output_fields"), F.col("input_bytes").alias("output_bytes"))
    generic = held.select("case_id", F.lit("generic").alias("method"), each.alias("kept"))
    scored = _scored(held.select("case_id", "entity", "question", F.explode(each).alias("x")).select("case_id", "entity", "question", "x.field", "x.value"), mapping)
    kept = F.array_sort(F.collect_list(F.when(F.col("selected"), F.struct("field", "value"))))
    adaptive = adapt.selected(scored, "case_id", most).groupBy("case_id").agg(F.lit("adaptive").alias("method"), kept.alias("kept"))
    blind = adapt.selected(scored.withColumn("score", F.lit(0.0)), "case_id", most).groupBy("case_id").agg(F.lit("adaptive_all").alias("method"), kept.alias("kept"))
    others = generic.unionByName(adaptive).unionByName(blind).join(held.select("case_id", "cases"), "case_id")
    # bytes of the fields as one compact object a case
    size = F.aggregate(F.transform("kept", lambda x: x["value"] + F.col("cases") * (F.octet_length(x["field"]) + 4)), F.col("cases"), lambda a, b: a + b)
    size = F.when(F.size("kept") == 0, 2 * F.col("cases")).otherwise(size)
    others = others.select("case_id", "method", F.transform("kept", lambda x: x["field"]).alias("fields"), (F.size("kept") * F.col("cases")).alias("output_fields"), size.alias("output_bytes"))
    return whole.unionByName(others)


def is_present(label: Column, fields: Column) -> Column:
    return F.exists(fields, lambda f: (f == label) | f.endswith(F.concat(F.lit("."), label)))


def totals(held: DataFrame, outputs: DataFrame) -> DataFrame:
    """(method, entity, cases, recall, perfect, removal, field_reduction, byte_reduction), entity null for all of a method, of the
    rows of ``forms.summed`` and what was ``produced`` of them."""
    met = held.select("case_id", "cases", "entity", "relevant", "irrelevant", "input_fields", "input_bytes").join(outputs, "case_id")
    met = met.withColumns({
        "kept": F.size(F.filter("relevant", lambda x: is_present(x, F.col("fields")))), "removed": F.size(F.filter("irrelevant", lambda x: ~is_present(x, F.col("fields")))),
        "wanted": F.size("relevant"), "unwanted": F.size("irrelevant"),
    })
    sums = {c: F.sum(F.col(c) * F.col("cases")) for c in ("kept", "wanted", "removed", "unwanted")} | {c: F.sum(c) for c in ("input_fields", "output_fields", "input_bytes", "output_bytes")}
    perfect = F.coalesce(F.sum(F.when(F.col("kept") == F.col("wanted"), F.col("cases"))), F.lit(0))
    rows = met.groupingSets([[F.col("method"), F.col("entity")], [F.col("method")]], F.col("method"), F.col("entity"))
    rows = rows.agg(F.sum("cases").alias("cases"), perfect.alias("perfect_cases"), F.grouping_id().alias("level"), *(s.alias(f"s_{c}") for c, s in sums.items()))

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 6)).otherwise(0.0)

    def reduction(before: str, after: str) -> Column:
        return F.when(F.col(before) > 0, F.round(1 - F.col(after) / F.col(before), 6)).otherwise(0.0)

    return rows.select(
        "method", "entity", "level", "cases", ratio("s_kept", "s_wanted").alias("recall"), ratio("perfect_cases", "cases").alias("perfect"), ratio("s_removed", "s_unwanted").alias("removal"),
        reduction("s_input_fields", "s_output_fields").alias("field_reduction"), reduction("s_input_bytes", "s_output_bytes").alias("byte_reduction"),
    )
