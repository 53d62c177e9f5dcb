"""The nested walk against a plain recursive one, on records of every shape."""

import json
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.operators import census, evaluate, nested

DEEP = '{"a":' * 15 + "1" + "}" * 15
RECORDS = [
    '{"b":{"x":1,"y":null},"l":[{"s":1},{"s":"t","u":2}],"e":[],"m":[1,"two",true],"n":[[{"q":1}]],"o":{},"z":3000000000,"f":1.5}', DEEP, '{"p":[{"q":[{"r":[]},{"r":[1]}]}]}', "{}", "[]", "7", '"text"', "null", '[{"k":{"v":[{"w":2}]}}]',
    '{"big":12345678901234567890,"neg":-2147483649,"t":false,"s":"","n":null}', '{"Meta":{"x":1},"keep":{"meta":2,"y":[1,{"meta":3}]}}', '{"deep":' + '[{"a":' * 14 + "1" + "}]" * 14 + "}",
]


def plain_flat(value, prefix="", depth=0):
    if depth > 12 or not isinstance(value, (dict, list)) or not value:
        return {prefix or "value": value}
    if isinstance(value, dict):
        return {k: v for key in value for k, v in plain_flat(value[key], f"{prefix}.{key}" if prefix else key, depth + 1).items()}
    return plain_flat(value[0], f"{prefix}[]", depth + 1) if isinstance(value[0], dict) else {prefix or "value": value}


def plain_count(value, depth=0):
    if depth > 12 or not isinstance(value, (dict, list)) or not value:
        return 1
    return sum(plain_count(v, depth + 1) for v in value.values()) if isinstance(value, dict) else plain_count(value[0], depth + 1)


def plain_kind(v):
    if v is None or isinstance(v, (bool, str, dict, list)):
        return {type(None): "null", bool: "bool", str: "string", dict: "object", list: "array"}[type(v)]
    return "double" if isinstance(v, float) else "int" if -(2**31) <= v < 2**31 else "long"


def plain_structure(records, deep):
    types, elements, present = defaultdict(Counter), defaultdict(Counter), Counter()

    def walk(record, prefix, names, seen):
        for key, value in record.items():
            path = f"{prefix}.{key}" if prefix else key
            seen.add(path)
            types[path][plain_kind(value)] += 1
            if isinstance(value, dict) and names + 1 < deep:
                walk(value, path, names + 1, seen)
            for x in value if isinstance(value, list) else ():
                elements[path][plain_kind(x)] += 1
                if isinstance(x, dict) and names + 1 < deep:
                    walk(x, f"{path}[]", names + 1, seen)

    for r in records:
        seen = set()
        if isinstance(r, dict):
            walk(r, "", 0, seen)
        present.update(seen)
    said = lambda c: ",".join(f"{k}:{n}" for k, n in sorted(c.items()))
    return {p: (present[p], sum(c.values()), c["null"], said(+c), said(elements[p])) for p, c in types.items()}


def frame(spark, records):
    return spark.createDataFrame(list(enumerate(records)), "i int, text string").withColumn("v", F.try_parse_json("text"))


def test_leaves_and_counts(spark):
    rows = frame(spark, [*RECORDS, "no json", None])
    for r in rows.select("i", nested.flattened(F.col("v")).alias("flat"), nested.leaf_count(F.col("v")).alias("n")).collect():
        if r["i"] >= len(RECORDS):
            assert not r["flat"] and not r["n"]
            continue
        value = json.loads(RECORDS[r["i"]])
        assert {k: json.loads(v) for k, v in r["flat"].items()} == plain_flat(value), RECORDS[r["i"]]
        assert r["n"] == plain_count(value), RECORDS[r["i"]]


def test_structure_of_a_collection(spark):
    records = [r for r in RECORDS if r.startswith("{")] * 2
    for deep in (8, 2):
        got = {r["path"]: tuple(r[c] for c in ("present", "n_values", "nulls", "types", "element_types")) for r in nested.structure(frame(spark, records), F.col("v"), deep).collect()}
        assert got == plain_structure([json.loads(r) for r in records], deep)
    by = {r["path"]: r for r in nested.structure(frame(spark, RECORDS[:1]), F.col("v")).collect()}
    assert by["m"]["source_type"] == "array<mixed<bool|int|string>>" and by["e"]["source_type"] == "array<empty>" and by["l[].s"]["source_type"] == "mixed<int|string>" and by["l[].s"]["field_type"] == "unknown"
    assert by["b.y"]["source_type"] == "null" and by["f"]["field_type"] == "decimal" and by["n"]["source_type"] == "array<array>"
    assert nested.structure(frame(spark, RECORDS[:1]).where("false"), F.col("v")).count() == 0
    mixed = nested.structure(frame(spark, ['{"w":1}', '{"w":2.5}', '{"v":1}']), F.col("v")).where("path = 'w'").collect()[0]
    assert (mixed["field_type"], mixed["source_type"], mixed["presence"]) == ("decimal", "mixed<double|int>", round(2 / 3, 6))


def test_operational_fields_are_left_out_at_any_level(spark):
    got = frame(spark, [RECORDS[10], '{"a":{"meta":1}}']).select(nested.business_leaves(F.col("v"), ("META",)).alias("m")).collect()
    assert got[0]["m"] == {"keep.y": '[1,{"meta":3}]'} and got[1]["m"] == {}


def test_envelopes_and_labels(spark):
    rows = frame(spark, ['{"data":{"a":1},"ok":true}', '{"data":[1],"b":2}', '{"c":3}'])
    assert [r["x"] for r in rows.select(F.to_json(evaluate.unwrapped(F.col("v"))).alias("x")).collect()] == ['{"a":1}', '{"b":2,"data":[1]}', '{"c":3}']
    met = spark.range(1).select(*(evaluate.is_present(F.lit(x), F.array(F.lit("customer.contact.email"), F.lit("amount"))).alias(f"c{i}") for i, x in enumerate(("contact.email", "email", "amount", "act.email", "customer"))))
    assert [*met.collect()[0]] == [True, True, True, False, False]


ODD = [
    '{"":{"a":1,"b":[]},"a.b":1,"a":{"b":[{"c":null}]},"x[]":[1,[2]],"é":"ü"}', '[[1],{"k":[[{"z":1}]]},null]', '{"x[]":{"y":[[1,2],{"q":true}]},"empty":{},"none":null}',
    json.dumps({f"k{i:03}": {"v": i, "w": "x" * 300} for i in range(300)}), json.dumps({"long": [*range(250), *["t"] * 60], "far": [{"v": "y" * 70_000}, {"v": 2**40}, {"v": -(2**31)}, {"v": -(2**31) - 1}, {"v": 2**31}]}),
    json.dumps({"huge": ["z" * 9_000_000, "z" * 9_000_000, {"last": 1e300}]}), '{"d":[1.25,1e5,1E-3,123456789012345678901234567890,-0.5],"e":{"f":{"g":{}}}}',
]


def test_counts_from_bytes_equal_the_walk_by_expressions(spark):
    rows = frame(spark, [*ODD, *RECORDS, *ODD[:3], "no json", None, '{"k000":{"v":[]},"k001":{"w":7}}'])
    for deep, most, remembered in ((8, 100, 50_000), (2, 3, 50_000), (1, 300, 5)):
        nodes = rows.select("i", F.explode(nested.observed(F.col("v"), deep, most)).alias("x")).select("i", "x.*").collect()
        want, there, cut = Counter((r["path"], r["kind"]) for r in nodes), Counter(p for _, p in {(r["i"], r["path"]) for r in nodes}), {r["path"] for r in nodes if r["deeper"]}
        want |= {("", "record"): rows.count()} | {(p, "present"): n for p, n in there.items()}
        got = census.counted(rows.coalesce(1), F.col("v"), deep, most, remembered).groupBy("path", "kind").agg(F.sum("n").alias("n"), F.max("truncated").alias("cut")).collect()
        assert {(r["path"], r["kind"]): r["n"] for r in got} == want and {r["path"] for r in got if r["cut"]} == cut


def test_a_decimal_point_makes_a_double_as_in_the_sql(spark):
    got = nested.structure(frame(spark, ['{"a":1.0,"b":[2.0,3]}', '{"a":100.0,"b":[]}']), F.col("v")).collect()
    assert {r["path"]: (r["types"], r["element_types"], r["field_type"]) for r in got} == {"a": ("double:2", "", "decimal"), "b": ("array:2", "double:1,int:1", "array")}


def test_records_are_walked_once(spark):
    walked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        walked.add(1)
        return text

    rows = spark.range(20).select(F.try_parse_json(told(F.lit('{"a":[1,{"b":2}]}'))).alias("v"))
    got = nested.structure(rows, F.col("v")).collect()
    assert {(r["path"], r["present"], r["presence"]) for r in got} == {("a", 20, 1.0), ("a[].b", 20, 1.0)} and walked.value == 20
