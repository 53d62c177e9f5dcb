"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import align, divergence, mtree, neardup, packing, permutation, pieces, quality, repeats, rules, secrets, store, toxicity
from tessera.llm.common import is_training_row, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_permutation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return _predicted(scores, 0.5).select("doc_id", "held_out", "score", "predicted", F.transform("evidence", lambda e: e["doc_id"]).alias("evidence"))


def _predicted(scores: DataFrame, threshold: float) -> DataFrame:
    held_out = ~is_training_row(F.col("doc_id"))
    return scores.withColumn("held_out", F.coalesce(held_out, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("novel"))


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pieces.encode(docs, _tokenizer("piece_bpe_32k.model"))
    best, second = F.col("nbest")[0], F.get("nbest", 1)
    return found.select(
        "doc_id", (F.octet_length(best["ids"]) / 4).cast("long").alias("n_pieces"), best["score"].alias("score"), F.crc32(best["ids"]).alias("ids_crc32"),
        (F.octet_length(second["ids"]) / 4).cast("long").alias("second_pieces"), second["score"].alias("second_score"), F.crc32(second["ids"]).alias("second_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return _predicted(quality.scored(docs, model), 0.3).select("doc_id", "held_out", "score", "predicted")


def op6_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store_and_read(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_anchor_dedup": op1_anchor_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_binary_packing": op3_binary_packing,
    "op4_mtree_top_k": op4_mtree_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_content_store": op6_content_store,
    "op7_secret_scan": op7_secret_scan,
    "op8_piece_lattice": op8_piece_lattice,
    "op9_rule_quality": op9_rule_quality,
    "op10_permutation_neighbours": op10_permutation_neighbours,
    "op11_token_alignment": op11_token_alignment,
    "op12_adaptive_rules": op12_adaptive_rules,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op4_mtree_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT lang, source, row, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN kept USING (lang, term)),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM own WHERE own.lang = d.lang AND own.source = d.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(own.n, 0) + 5) // (g.total + 5 * v.v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (kept.n + 5) // (v.total + 5 * v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
