"""Query-relevant field selection under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import canonical_tokens, split_tokens

# Weights and limits.
ALIAS, NAME, ENTITY, IDENTITY = 0.45, 0.30, 0.15, 0.10
LEAST, MOST_FIELDS, MOST_CHARS = 0.25, 24, 8000
# Words that tell nothing about a field, those that a question's phrasing stands for, structural parts of
# field names, endings of identifying fields, and words that ask for a whole record.
STOPWORDS = (
    "a", "an", "and", "any", "are", "as", "at", "be", "by", "can", "did", "do", "does", "for", "from", "get", "give", "has", "have", "how", "i", "in", "is", "it", "its", "many", "me", "much",
    "my", "of", "on", "or", "please", "show", "that", "the", "their", "them", "there", "these", "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your",
)
INTENTS = {
    "how much": ("amount", "total", "price"), "how many": ("quantity", "count"), "total": ("amount",), "cost": ("amount",), "costs": ("amount",), "price": ("amount",), "worth": ("amount",),
    "owe": ("amount", "status"), "owed": ("amount", "status"), "outstanding": ("amount", "status"), "balance": ("amount", "status"), "who": ("customer", "supplier", "name"), "named": ("name",),
    "called": ("name",), "when": ("date",), "where": ("address", "location"), "overdue": ("due", "date", "status"), "late": ("due", "date", "status"), "paid": ("status", "payment"),
    "unpaid": ("status", "payment"), "settled": ("status", "payment"), "approved": ("status",), "approval": ("status",), "rejected": ("status",), "pending": ("status",), "contact": ("email", "phone"),
    "reach": ("email", "phone"), "tax": ("tax", "amount"), "vat": ("tax", "amount"), "shipped": ("status", "date", "address"), "delivered": ("status", "date", "address"),
}
STRUCTURAL = ("id", "no", "num", "nbr", "number", "code", "key", "ref", "reference", "name", "value", "flag", "ind", "indicator")
IDENTITY_ENDINGS = ("id", "no", "num", "nbr", "number", "ident")
BROAD = ("everything", "all", "full", "complete", "entire", "whole", "overview", "summary", "details", "anything")


def query_tokens(query: Column) -> Column:
    """The content words of a question, then what its phrasing implies; each once."""
    def content(raw: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.array_join(raw, " "), F.lit(" "))
        implied = [F.when(F.contains(spaced, F.lit(f" {phrase} ")), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for phrase, words in INTENTS.items()]
        return F.array_distinct(F.concat(F.filter(raw, lambda w: ~w.isin(*STOPWORDS)), *implied))

    return F.transform(F.array(canonical_tokens(F.coalesce(query, F.lit("")))), content)[0]  # a lambda, so that the split text is made once


def is_broad(tokens: Column) -> Column:
    """Whether a question asks for the whole record."""
    return F.arrays_overlap(tokens, F.array(*map(F.lit, BROAD)))


def coverage(target: Column, query: Column, ignore: Column | None = None) -> Column:
    """Shared tokens over the smaller set. Structural parts of a name count only where it has no others; ``ignore``
    (the words of the record's own entity) counts on neither side."""
    telling = F.filter(target, lambda w: ~w.isin(*STRUCTURAL))
    a, b = F.array_distinct(F.when(F.size(telling) > 0, telling).otherwise(target)), F.array_distinct(query)
    if ignore is not None:
        a, b = F.array_except(a, ignore), F.array_except(b, ignore)
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, 0.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / least, 6))


def relevance(field: Column, names: Column, of_entity: Column, is_identity: Column, entity: Column, query: Column) -> Column:
    """Weighted mean of the alias, name, entity and identity signals of a field.

    ``names``: name and aliases of the canonical field it maps to, null where it
    maps to none; ``of_entity``: that field's entity; ``entity``: the record's.
    A broad question has no words of its own.
    """
    words = query_tokens(query)
    words = F.when(is_broad(words), F.array().cast("array<string>")).otherwise(words)
    own = canonical_tokens(F.coalesce(entity, F.lit("")))
    alias = F.coalesce(F.array_max(F.transform(names, lambda n: coverage(canonical_tokens(n), words, own))), F.lit(0.0))
    belongs = F.when(names.isNull(), 0.0).when(entity.isNull(), 0.5).when(of_entity == entity, 1.0).otherwise(0.25)
    return F.round(ALIAS * alias + NAME * coverage(canonical_tokens(field), words, own) + ENTITY * belongs + IDENTITY * F.coalesce(is_identity, F.lit(False)).cast("double"), 6)


def inferred_identity(names: Column) -> Column:
    """The first of a record's field names that ends like an identifier, null where none does."""
    parts = lambda n: split_tokens(n)
    return F.get(F.filter(names, lambda n: (F.size(parts(n)) > 1) & F.element_at(parts(n), -1).isin(*IDENTITY_ENDINGS)), 0)


def selected(fields: DataFrame, case: str, most: int = MOST_FIELDS, least: float = LEAST) -> DataFrame:
    """Adds ``selected`` and ``reason``: identity fields always, then the best up to the budget; all up to it if none is good enough."""
    order = W.partitionBy(case).orderBy(F.desc("score"), "field")
    good = (F.col("score") >= least) & ~F.col("is_identity")
    rows = fields.withColumn("_any_", F.max(good.cast("int")).over(W.partitionBy(case)))
    candidate = ~F.col("is_identity") & ((F.col("score") >= least) | (F.col("_any_") == 0))
    rows = rows.withColumn("_c_", candidate.cast("int")).withColumn("_n_", F.sum("_c_").over(order.rowsBetween(W.unboundedPreceding, 0)))
    reason = F.when(F.col("is_identity"), "IDENTITY").when((F.col("_c_") == 1) & (F.col("_n_") <= most), F.when(F.col("_any_") == 0, "FALLBACK").otherwise("RELEVANT")).when(F.col("_c_") == 1, "OVER_BUDGET").otherwise("IRRELEVANT")
    return rows.withColumn("reason", reason).withColumn("selected", F.col("reason").isin("IDENTITY", "RELEVANT", "FALLBACK")).drop("_any_", "_c_", "_n_")


def within_budget(fields: DataFrame, case: str, size: Column, most: int = MOST_CHARS) -> DataFrame:
    """Adds ``kept``: from the best field down as long as their sizes fit."""
    order = W.partitionBy(case).orderBy(F.desc("score"), "field").rowsBetween(W.unboundedPreceding, 0)
    return fields.withColumn("kept", F.sum(size).over(order) <= most)
