"""Candidates by the inverted index against all pairs; entities, profiles, keys and catalog selection on odd rows."""

from pyspark.sql import functions as F

from tessera.operators import mapping, profile


def test_indexed_candidates_equal_all_pairs(spark):
    names = ["order_no", "OrderNumber", "cust_ref", "customer", "amt", "total amount", "", "x", "ship-to.city", "table", "the_field", "tot", "e_mail", "no"]
    fields = spark.createDataFrame([("invoice", n, "string") for n in names], "entity string, field string, type string")
    targets = ["order_number", "customer_reference", "amount", "total_amount", "city", "email", "number", "x", "table", "unlike"]
    model = spark.createDataFrame([(e, t, "string") for e in ("invoice", "order") for t in targets], "target_entity string, target string, target_type string")
    aliases = spark.createDataFrame([("TOT", "invoice", "unlike"), ("tot", "invoice", "unlike"), ("gone", "invoice", "amount")], "alias string, target_entity string, target string")
    got = {(r["field"], r["target_entity"], r["target"]): r["name_score"] for r in mapping.scored(fields, model, aliases).collect()}
    alias = (F.lower("field") == "tot") & (F.col("target_entity") == "invoice") & (F.col("target") == "unlike")
    every = fields.crossJoin(model).withColumn("s", mapping.name_score(F.col("field"), F.col("target"), alias)).where("s is not null")
    want = {(r["field"], r["target_entity"], r["target"]): r["s"] for r in every.collect()}
    assert got == want and got["tot", "invoice", "unlike"] == mapping.ALIAS_NAME and ("tot", "order", "unlike") not in got
    assert mapping.scored(fields.where("false"), model, aliases).count() == 0


def test_paths_speak_for_nested_fields(spark):
    fields = spark.createDataFrame([("invoice", "email", "string", "customer.contact"), ("invoice", "email", "string", None)], "entity string, field string, type string, path string")
    model = spark.createDataFrame([("customer", "email", "string"), ("invoice", "email", "string")], "target_entity string, target string, target_type string")
    none = spark.createDataFrame([], "alias string, target_entity string, target string")
    rows = mapping.pairs(fields, model, none).withColumn("p", mapping.path_score(F.col("path"), F.col("field"), F.col("target_entity"), F.col("target"))).collect()
    assert {(r["path"], r["target_entity"]): r["p"] for r in rows} == {("customer.contact", "customer"): round(2 / 3, 6), ("customer.contact", "invoice"): 0.25, (None, "customer"): 0.5, (None, "invoice"): 0.5}


def test_entities(spark):
    names = spark.createDataFrame([("tbl_invoice",), ("inv",), ("shipment",), ("customers",)], "entity string")
    model = spark.createDataFrame([("invoice",), ("customer",)], "target_entity string")
    assert {r["entity"]: r["matched"] for r in mapping.matched_entities(names, model).collect()} == {"tbl_invoice": "invoice", "inv": "invoice", "shipment": None, "customers": None}


def test_profiles_of_odd_columns(spark):
    rows = spark.createDataFrame([(1, "a", 1.5, None), (1, "", None, None), (None, None, -2.0, None), (3, "z" * 50, 1.5, None), (3, "z" * 49 + "y", 1.5, None)], "k int, t string, x double, none string")
    found = {r["column_name"]: r for r in profile.columns(rows, ["k", "t", "x", "none"]).collect()}
    assert tuple(found["k"])[1:7] == (5, 1, 0.2, 2, 1.0, 3.0) and tuple(found["t"])[1:] == (5, 1, 0.2, 4, None, None, 0, 50, 25.25)
    assert tuple(found["x"])[1:7] == (5, 1, 0.2, 2, -2.0, 1.5) and tuple(found["none"])[1:] == (5, 5, 1.0, 0, None, None, None, None, None)
    assert profile.columns(rows.where("false"), ["k"]).count() == 0
    keys = {r["key"]: (r["rows_with_key"], r["repeated"], r["is_unique"]) for r in profile.unique_keys(rows, [("k",), ("k", "t"), ("t", "k"), ("none",)]).collect()}
    assert keys == {"k": (4, 2, False), "k,t": (4, 0, True), "none": (0, 0, False)}
    shown = rows.select(profile.value_summary(F.col("t"), "string").alias("t"), profile.value_summary(F.col("x"), "decimal").alias("x")).collect()
    assert [tuple(r) for r in shown][:3] == [("string of 1", "decimal"), ("string of 0", "null"), ("null", "decimal")]


def test_selection_of_a_catalog_and_payloads(spark):
    catalog = spark.createDataFrame([("public", "Orders"), ("PUBLIC", "items"), ("sys", "x"), (None, "orders"), ("other", "orders")], "space string, name string")
    pick = lambda **how: sorted((r["space"] or "", r["name"]) for r in profile.wanted(catalog, "space", "name", **how).collect())
    assert pick() == [("", "orders"), ("PUBLIC", "items"), ("other", "orders"), ("public", "Orders")]
    assert pick(include=["ORDERS"], include_namespaces=["public"]) == [("public", "Orders")] and pick(exclude=("orders",)) == [("PUBLIC", "items")] and pick(include=[]) == []
    rows = spark.createDataFrame([(1, "a", None, "secret"), (2, " ", "b", "secret")], "id long, f string, g string, body string")
    kept = profile.payload(rows, ["id"], ["f", "g"], "body").collect()
    assert [r["filters"] for r in kept] == [{"f": "a"}, {"g": "b"}] and "text" not in kept[0].asDict() and profile.payload(rows, ["id"], ["f"], "body", True).collect()[0]["text"] == "secret"
