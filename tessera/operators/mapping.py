"""Field mapping: scores of source fields against a canonical model, and decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import canonical_tokens, identifier, jaccard

# Weights, thresholds and how source types fit target types.
NAME, TYPE, ENTITY, PATH = 0.50, 0.20, 0.20, 0.10
EXACT_NAME, SAME_NAME, ALIAS_NAME, LEAST_JACCARD, NEUTRAL = 1.0, 0.98, 0.94, 0.25, 0.5
HIGH, MARGIN, LEAST, CANDIDATES = 0.75, 0.05, 0.20, 5
FIT = {"exact": 1.0, "widening": 0.85, "lossy": 0.45, "unknown": 0.30, "incompatible": 0.0}
WIDENING = ("integer>decimal", "date>datetime")
LOSSY = (
    "decimal>integer", "integer>string", "decimal>string", "boolean>string", "boolean>integer", "string>integer", "string>decimal", "string>boolean", "datetime>date",
    "string>date", "string>datetime", "date>string", "datetime>string", "integer>datetime", "integer>date", "binary>string", "string>binary",
)


def type_fit(source: Column, target: Column) -> Column:
    pair = F.concat_ws(">", source, target)
    return F.when((source == "unknown") | (target == "unknown"), "unknown").when(source == target, "exact").when(pair.isin(*WIDENING), "widening").when(pair.isin(*LOSSY), "lossy").otherwise("incompatible")


def fit_score(fit: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in FIT.items() for x in pair]), fit)


def name_score(source: Column, target: Column, alias: Column) -> Column:
    """Null where the names have too little in common."""
    words = jaccard(canonical_tokens(source), canonical_tokens(target))
    return F.when(source == target, EXACT_NAME).when(identifier(source) == identifier(target), SAME_NAME).when(alias, ALIAS_NAME).when(words >= LEAST_JACCARD, words)


def entity_score(source: Column, target: Column) -> Column:
    a, b = canonical_tokens(source), canonical_tokens(target)
    return F.when(F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)) == 0, 1.0).when(F.size(F.array_except(b, a)) == 0, 0.85).when(F.size(F.array_except(a, b)) == 0, 0.75).otherwise(F.greatest(jaccard(a, b), F.lit(NEUTRAL)))


def path_score(path: Column, name: Column, entity: Column, target: Column) -> Column:
    """How well a nested field's whole path fits the target; a flat field has nothing to say."""
    own, other = canonical_tokens(F.concat_ws(".", path, name)), F.concat(canonical_tokens(entity), canonical_tokens(target))
    return F.when(path.isNull(), NEUTRAL).otherwise(jaccard(own, F.array_distinct(other)))


def pairs(fields: DataFrame, model: DataFrame, aliases: DataFrame) -> DataFrame:
    """The fields with the targets they may stand for: those that share a word of their names, the same identifier, or an
    alias. Only these can have a name score, so no field meets the whole model."""
    def index(rows: DataFrame, name: str) -> Column:
        words = F.transform(F.array_distinct(canonical_tokens(F.col(name))), lambda w: F.concat(F.lit("word:"), w))
        return F.array_distinct(F.concat(words, F.array(F.concat(F.lit("name:"), identifier(F.col(name))))))

    left = fields.withColumn("_word_", F.explode(F.concat(index(fields, "field"), F.array(F.concat(F.lit("alias:"), identifier(F.col("field")))))))
    known = aliases.select(F.concat(F.lit("alias:"), identifier(F.col("alias"))).alias("_word_"), "target_entity", "target").distinct()
    targets = model.withColumn("_word_", F.explode(index(model, "target")))
    targets = targets.unionByName(known.join(model, ["target_entity", "target"]).select(*model.columns, "_word_"))
    met = left.join(targets, "_word_").withColumn("_alias_", F.col("_word_").startswith("alias:"))
    return met.groupBy(*fields.columns, *model.columns).agg(F.max("_alias_").alias("_alias_"))


def scored(fields: DataFrame, model: DataFrame, aliases: DataFrame) -> DataFrame:
    """All candidates above the least score. ``fields`` may have a dotted ``path`` of what encloses the field."""
    if "path" not in fields.columns:
        fields = fields.withColumn("path", F.lit(None).cast("string"))
    out = pairs(fields, model, aliases).withColumns({
        "name_score": name_score(F.col("field"), F.col("target"), F.col("_alias_")), "fit": type_fit(F.col("type"), F.col("target_type")),
        "entity_score": entity_score(F.col("entity"), F.col("target_entity")), "path_score": path_score(F.col("path"), F.col("field"), F.col("target_entity"), F.col("target")),
    })
    total = NAME * F.col("name_score") + TYPE * fit_score(F.col("fit")) + ENTITY * F.col("entity_score") + PATH * F.col("path_score")
    out = out.where("name_score is not null").withColumn("score", F.round(total, 6))
    return out.where(F.col("score") >= LEAST).select("entity", "field", "type", "target_entity", "target", "fit", "name_score", "entity_score", "score")


def matched_entities(entities: DataFrame, model: DataFrame, least: float = 0.6) -> DataFrame:
    """(entity, matched): the model's entity that each one fits best, by shared words, null where none fits well."""
    left = entities.select("entity").distinct().withColumn("_word_", F.explode(F.array_distinct(canonical_tokens(F.col("entity")))))
    right = model.select("target_entity").distinct().withColumn("_word_", F.explode(F.array_distinct(canonical_tokens(F.col("target_entity")))))
    met = left.join(right, "_word_").select("entity", "target_entity").distinct().withColumn("s", entity_score(F.col("entity"), F.col("target_entity")))
    best = met.where(F.col("s") >= least).groupBy("entity").agg(F.max_by("target_entity", F.struct("s", "target_entity")).alias("matched"))
    return entities.select("entity").distinct().join(best, "entity", "left")


def candidates(scores: DataFrame, most: int = CANDIDATES) -> DataFrame:
    at = W.partitionBy("entity", "field").orderBy(F.desc("score"), "target_entity", "target")
    return scores.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= most)


def decided(ranked: DataFrame, fields: DataFrame) -> DataFrame:
    """One row a field: its best target, the margin to the runner-up, and what is to be done."""
    at = W.partitionBy("entity", "field").orderBy("rank")
    best = ranked.withColumn("margin", F.round(F.col("score") - F.lead("score").over(at), 6)).where("rank = 1")
    out = fields.select("entity", "field").join(best, ["entity", "field"], "left")
    decision = F.when(F.col("score").isNull(), "unmapped").when(F.col("fit") == "incompatible", "review_type").when(F.col("score") < HIGH, "review_score").when(F.col("margin") < MARGIN, "review_ambiguous").otherwise("auto")
    return out.withColumn("decision", decision)


def without_collisions(decisions: DataFrame) -> DataFrame:
    """Of fields that claim one target the best keeps it, the others go to review."""
    at = W.partitionBy("entity", "target_entity", "target").orderBy(F.desc("score"), "field")
    auto = decisions.where("decision = 'auto'").withColumn("decision", F.when(F.row_number().over(at) > 1, "review_collision").otherwise("auto"))
    return auto.unionByName(decisions.where("decision <> 'auto'"))
