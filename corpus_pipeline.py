"""The training-data pipeline: from raw documents to packed sequences, stage by stage.

Every stage takes what its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces. ``run`` writes each stage's
rows to the session's shared folder, as a scheduler between stages would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import neardup, packing, quality, repeats, secrets
from tessera.llm.common import table, written

#: Words that a worker remembers in each of two generations while it packs: it still holds them in the stages of a next run.
REMEMBERED = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more."""
    return quality.accepted(docs, quality.learn(docs, table(spark, sf_dir, "labels")), 0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by runs of five words at a similarity of 0.8."""
    return neardup.representatives(docs, width=5, percent=80)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that an earlier document holds."""
    return repeats.rewritten(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by their kinds."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, remembered=REMEMBERED)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("substring dedup", repeat_stage),
    ("secret scan", secret_stage),
    ("packing", packing_stage),
]

#: Learned rules and tokenizers are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
