"""Versioned tables: writers that meet, readers that keep their version, and what a merge touches."""

import pytest
from pyspark.sql import functions as F

from tessera.sources.versioned import VersionConflict, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedTable(spark, f"file://{tmp_path}/t", "k", 8)
    made.create(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("state"), F.lit(1).alias("version")))
    return made


def update(spark, *rows):
    return spark.createDataFrame(rows, "k long, state string, expected int")


def test_the_second_of_two_writers_is_refused(spark, table):
    base = table.snapshot()
    table.merge(update(spark, (1, "first", 1)), base)
    with pytest.raises(VersionConflict):
        table.merge(update(spark, (1, "second", 1)), base)
    assert table.versions() == [0, 1]
    assert {r["state"] for r in table.read().where("k = 1").collect()} == {"first"} and table.read().count() == 100
    assert {r["state"] for r in table.read(base).where("k = 1").collect()} == {"a"}, "a reader keeps its version"
    made, refused = table.merge(update(spark, (1, "second", 2)))
    assert (made.number, refused) == (2, 0) and table.read().where("k = 1 and state = 'second' and version = 3").count() == 1


def test_rows_that_expect_another_version_go_to_the_conflicts(spark, table):
    made, refused = table.merge(update(spark, (1, "x", 1), (2, "x", 7), (500, "new", 0), (501, "x", 3), (3, "p", 1), (3, "q", 1), (4, None, 1)))
    assert refused == 3 and made.number == 1
    held = {r["k"]: (r["state"], r["version"]) for r in table.read().where("k in (1, 2, 3, 4, 500, 501)").collect()}
    assert held[1] == ("x", 2) and held[2] == ("a", 1) and held[500] == ("new", 1) and 501 not in held and held[3][0] in "pq" and held[4] == (None, 2)
    assert {(r["k"], r["expected"], r["stored"]) for r in table.appended("conflicts").collect()} == {(2, 7, 1), (501, 3, 0), (3, 1, 1)}
    assert sorted(r["key"] for r in table.appended("audit").collect()) == ["1", "3", "4", "500"]


def test_a_merge_touches_its_buckets_only(spark, table):
    before = table.snapshot()
    made, _ = table.merge(update(spark, (7, "x", 1)))
    changed = {k for k in before.buckets if before.buckets[k] != made.buckets.get(k)}
    assert changed == {table.bucket_of(update(spark, (7, "x", 1))).collect()[0]["bucket"]}
    assert table.read(before).inputFiles() != table.read(made).inputFiles() and table.read(made, [*changed]).where("k = 7").count() == 1
    same, refused = table.merge(update(spark))
    assert (same.number, refused) == (2, 0) and table.read().count() == 100


def test_a_merge_moves_stored_rows_once_and_keeps_null_keys_and_copies(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/u", "k", 2)
    rows = [(None, "n", 1), (None, "m", 1), (1, "a", 1), (2, "b", 1), (2, "c", 1), (3, "d", 1)]
    base = table.create(spark.createDataFrame(rows, "k long, state string, version int"))
    plans, write = [], table._write
    table._write = lambda dealt: (plans.append(dealt._jdf.queryExecution().executedPlan().toString()), write(dealt))[1]
    table.merge(update(spark, (3, "new", 1), (None, "new", 0), (4, "four", 0)), base)
    said = lambda r: (r["k"] is None, r["k"] or 0, r["state"], r["version"])
    assert sorted(map(said, table.read().collect())) == [(False, 1, "a", 1), (False, 2, "b", 1), (False, 2, "c", 1), (False, 3, "new", 2), (False, 4, "four", 1), (True, 0, "m", 1), (True, 0, "n", 1), (True, 0, "new", 1)]
    assert plans[0].count("Exchange ") == 1
