"""Cases summed up by their form against the expressions on each case."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, forms, nested
from tests.test_nested import DEEP, RECORDS

BODIES = [
    *RECORDS, DEEP, None, "no json", '{"data":{"a":1.50,"b":1e5,"c":-0.0,"d":1E400,"e":12345678901234567890,"f":1.0},"ok":true}', '{"data":[1],"x":{"data":{"y":1}}}', '{"data":{}}', '{"data":null,"":{"":1},"z":""}',
    '{"data":{"t":"tab\\tquote\\" back\\\\ line\\n \\u0001 \\u007f \\u2028 ü 😀 /","ü":["é",{"k":"\\b"}],"l":[{"b":[{"c":[]}]},{"b":7}],"g":[[{"h":1}]]}}', '{"data":{"s":[" ",false,true,null,{},[],2.5e-7]}}',
]


@pytest.mark.parametrize("held", [20_000, 2])
def test_forms_hold_what_expressions_find(spark, held):
    rows = [(i, "e" if i % 3 else None, "q", ["a"] if i % 2 else None, [], b) for i, b in enumerate([*BODIES, *BODIES[3:6]])]
    cases = spark.createDataFrame(rows, "case_id long, entity string, question string, relevant array<string>, irrelevant array<string>, text string").withColumn("body", F.try_parse_json("text"))
    flat = lambda x: F.map_entries(nested.flattened(x))
    inside = flat(evaluate.unwrapped(F.col("body")))
    each = cases.select("entity", "relevant", F.transform(flat(F.col("body")), lambda e: e["key"]).alias("raw"), F.transform(inside, lambda e: e["key"]).alias("fields"), nested.leaf_count(F.col("body")).alias("n"), F.octet_length(F.to_json("body")).alias("b"), F.transform(inside, lambda e: F.octet_length(e["value"])).alias("sizes"))
    want, sums = Counter(), {}
    for r in each.collect():
        form = r["entity"], tuple(r["relevant"] or ()), tuple(r["raw"] or ()), tuple(r["fields"] or ())
        want[form] += 1
        n, b, sizes = sums.get(form, (0, 0, [0] * len(form[3])))
        sums[form] = n + r["n"], b + (r["b"] or 0), [x + y for x, y in zip(sizes, r["sizes"] or (), strict=True)]
    got, found = Counter(), {}
    table = forms.summed(cases.coalesce(1), held=held).collect()
    assert len({r["case_id"] for r in table}) == len(table) and (held > 2) == (len(table) == len(want))
    for r in table:
        form = r["entity"], tuple(r["relevant"] or ()), tuple(r["raw"]), tuple(r["fields"])
        got[form] += r["cases"]
        n, b, sizes = found.get(form, (0, 0, [0] * len(form[3])))
        found[form] = n + r["input_fields"], b + (r["input_bytes"] or 0), [x + y for x, y in zip(sizes, r["sizes"], strict=True)]
    assert got == want and found == sums


def test_evaluation_does_not_depend_on_how_cases_are_summed(spark):
    body = '{"data":{"amount":%d,"customer":{"email":"u%d@x"},"event_id":%d,"note":"%s"},"ok":true}'
    rows = [(f"e{i % 2}", ("what is the amount", "tell me everything")[i % 2], ["amount", "email"], ["note"], body % (i, i, 10**i, "n" * i)) for i in range(12)]
    cases = spark.createDataFrame(rows, "entity string, question string, relevant array<string>, irrelevant array<string>, text string").withColumn("body", F.try_parse_json("text"))
    mapping = spark.createDataFrame([("amount", ["amount"], "e0", False), ("event_id", ["event_id"], "e0", True)], "field string, names array<string>, of_entity string, is_identity boolean")

    def said(held):
        return sorted(map(str, evaluate.totals(held, evaluate.produced(held, mapping, 2)).collect()))

    got = said(forms.summed(cases))
    assert got == said(forms.summed(cases, held=1)) == said(forms.summed(cases.repartition(12))) and len(got) == 12
    assert forms.summed(cases.coalesce(1)).count() == 2


def test_cases_of_a_form_are_one_row_of_the_query(spark, tmp_path):
    from tessera.plans import queries_adapt, registry

    spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") % 50).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") / 4).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    load = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    assert forms.summed(queries_adapt._cases(load)).count() == 6  # four questions, of which even ids ask with and without items
    got = {(r["method"], r["entity"]): r["cases"] for r in registry.QUERIES["adaptation_eval"](spark, str(tmp_path)).collect()}
    assert got == {(m, e): 400 for m in evaluate.METHODS for e in ("view", None)}
