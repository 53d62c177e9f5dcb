"""The pipeline stage by stage against plain Python on a small table."""

import corpus_pipeline
from tessera.llm import quality, secrets
from tests.llm.test_neardup import brute as groups
from tests.llm.test_packing_store import ids_of
from tests.llm.test_repeats import brute as repeats

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {i: t for i, t in rows.items() if float(model.score(quality.np.array([quality.measure(t)]))[0]) >= 0.3}
    one = corpus_pipeline.quality_stage(spark, docs, SF)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {*rows}
    rows = {i: rows[i] for i, _, c in groups(sorted(rows.items()), 5, 80) if i == c}
    changed = {i: (gone, kept) for i, _, gone, kept in repeats(sorted(rows.items()), 50)}
    rows = {i: changed[i][1] if changed[i][0] else t for i, t in rows.items()}
    rows = {i: secrets.redacted(t, secrets.spans_of(t)) for i, t in rows.items() if t or not changed[i][0]}
    want = {i: len(ids_of("word_bpe_49k.json", t, 1)) for i, t in rows.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_take_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "text " * 60, "en", "s", 5), (2, "", "en", "s", 0), (3, "text " * 60, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        out.collect()
        assert stage(spark, odd.where("false"), SF).count() == 0
