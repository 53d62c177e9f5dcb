"""Queries that cover every row and whole texts, on tables that a bounded sample would miss."""

import json

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from tessera.operators import sync
from tessera.plans import registry


def run(spark, path, query, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return registry.QUERIES[query](spark, str(path)).collect()


def test_every_row_of_a_slot_is_retired(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "src1").otherwise("src2").alias("source"))
    got = run(spark, tmp_path, "lifecycle_retire", documents=docs)
    assert sorted(r["doc_id"] for r in got) == [i for i in range(400) if i % 4] and {(r["state"], r["cleanup_pending"]) for r in got} == {("superseded", True)}
    assert sync.retired(docs.where("false"), "doc_id").count() == 0


def test_words_anywhere_in_a_text_classify_it(spark, tmp_path):
    texts = [(3, "invoice " + "x " * 150), (7, "x " * 150), (11, "an invoice " + "x " * 40)]
    got = run(spark, tmp_path, "classify_documents", benchmark=spark.createDataFrame(texts, "item_id long, text string"))
    kinds = {r["item_id"]: r["kind"] for r in got}
    assert kinds[7] == "unclassified_document" and kinds[3] == kinds[11] != kinds[7]


def test_first_key_of_more_than_fifty_key_lists(spark, tmp_path):
    rows = [(i, json.dumps({f"k{i}": f"v{i}", "z": 1})) for i in range(300)]
    odd = [(300, '{"a.b": "dot"}'), (301, '{"a b": {"c": [1, 2]}}'), (302, "{\"it's\": 1.5}"), (303, '{"n": null}'), (304, "{}"), (305, "not json"), (306, None), (307, '{"": "empty"}'), (308, '{"t": true}'), (309, '{"b": 12345678901234567890123}')]
    got = {r["event_id"]: (r["value"], r["issue"]) for r in run(spark, tmp_path, "rule_nested_path", events=spark.createDataFrame(rows + odd, "event_id long, props string"))}
    assert all(got[i] == (f"v{i}", None) for i in range(300))
    assert [got[i][0] for i in range(300, 310)] == ["dot", '{"c":[1,2]}', "1.5", None, None, None, None, "empty", "true", "12345678901234567890123"]


def test_searches_answer_every_hundredth_vector(spark, tmp_path):
    vectors = spark.range(700).select(F.col("id").alias("vec_id"), F.array(*[F.sin((F.col("id") + 1) * k).cast("float") for k in (1, 2, 3, 5)]).alias("embedding"), (F.col("id") % 5).cast("int").alias("label"))
    documents = spark.range(350).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 7).alias("source"))
    people = spark.range(1, 101).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"))
    for i, name in enumerate(("cold_search", "vector_topk", "hybrid_search", "library_search")):
        got = run(spark, tmp_path / str(i), name, embeddings=vectors, documents=documents, customer=people)
        assert {r["query_id"] for r in got} == {*range(0, 700, 100)}, name


def test_labels_come_from_counted_paths(spark):
    labels = registry.QUERIES["humanize_label"](spark, "/root/testdata/sf0.001")
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert "try_parse_json" not in plan and "o_orderkey" not in plan  # the records are behind it, walked once in batches
    assert ("order.customer.id", "Order Customer Id") in {tuple(r) for r in labels.collect()}
