"""Nested records: walks over variants of any shape, their leaves, and the structure of a collection.

A walk is one expression on a record, a loop over levels: the containers of one
level give the nodes of the next, and ends where none is left, so a record never
leaves its row and no node is visited twice. Paths are dotted;
``[]`` stands for the elements of a list.

Lists of records are walked through their first element (``flattened``,
``leaf_count``: the shape counts, not the number of rows) or all of them up to a
cap (``observed``). Containers below the deepest level are leaves with all they
hold. A null record has no nodes; a text that is no JSON is a null record.

``structure`` needs counts only and walks the records' bytes (``census``), in the same order and to the same depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import census
from tessera.operators.staging import staged

#: Levels below which a container is a leaf; elements of a list that are observed; depth of observed names.
DEEPEST, ELEMENTS, NAMES_DEEP = 12, 100, 8
_NODE = "struct<path: string, depth: int, value: variant>"


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def is_null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def kind(value: Column) -> Column:
    """The type of a value: null, bool, int (32 bits), long, double, string, object or array."""
    whole = F.try_variant_get(value, "$", "bigint")
    said = F.schema_of_variant(value)
    return (
        F.when(is_null(value), "null").when(said == "BIGINT", F.when(whole.between(-(2**31), 2**31 - 1), "int").otherwise("long"))
        .when(said == "BOOLEAN", "bool").when(said == "STRING", "string").when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array")
        .when(said.startswith("DECIMAL") & said.endswith(",0)"), "long").when(said.startswith("DECIMAL") | said.isin("DOUBLE", "FLOAT"), "double").otherwise("unknown")
    )


def _node(path: Column, depth: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), depth.cast("int").alias("depth"), value.alias("value")).cast(_NODE)


def _below(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _shapes(record: Column, lists: str, hidden: tuple[str, ...] = ()) -> Column:
    """The leaves of a record. ``lists``: which lists are gone into through their first element, those of ``records``,
    ``all`` or ``none``; ``hidden`` names fields left out at any level."""
    def into(node: Column) -> Column:
        elements = _elements(node["value"])
        return {"records": F.coalesce(_fields(F.get(elements, 0)).isNotNull(), F.lit(False)), "all": F.coalesce(F.size(elements) > 0, F.lit(False)), "none": F.lit(False)}[lists]

    def opens(node: Column) -> Column:
        return (node["depth"] <= DEEPEST) & (F.coalesce(F.size(_fields(node["value"])) > 0, F.lit(False)) | into(node))

    def children(node: Column) -> Column:
        fields = _fields(node["value"])
        entries = F.map_entries(fields)
        if hidden:
            entries = F.filter(entries, lambda e: ~F.lower(e["key"]).isin(*hidden))
        named = F.transform(entries, lambda e: _node(_below(node["path"], e["key"]), node["depth"] + 1, e["value"]))
        first = F.array(_node(F.concat(node["path"], F.lit("[]")), node["depth"] + 1, F.get(_elements(node["value"]), 0)))
        return F.when(fields.isNotNull(), named).otherwise(first)

    return _walked(record, opens, children, DEEPEST + 1, keep_opened=False)


def _walked(record: Column, opens, children, levels: int, keep_opened: bool) -> Column:
    """Nodes of a record, level by level: those that ``opens`` says are replaced by (or, with ``keep_opened``, followed by) their children."""
    start = F.when(record.isNotNull(), F.array(_node(F.lit(""), F.lit(0), record))).otherwise(F.array().cast(f"array<{_NODE}>"))
    state = F.struct(F.array().cast(f"array<{_NODE}>").alias("done"), start.alias("front"))

    def level(held: Column, _: Column) -> Column:
        done = held["front"] if keep_opened else F.filter(held["front"], lambda n: ~opens(n))
        front = F.flatten(F.transform(F.filter(held["front"], opens), children))
        return F.struct(F.concat(held["done"], done).alias("done"), front.alias("front"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), state, level, lambda held: F.concat(held["done"], held["front"]))


def leaves(record: Column) -> Column:
    """array<struct<path, value>> of a variant: its leaves under dotted paths; a bare value is under ``value``."""
    return _named(_shapes(record, "records"))


def _named(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: F.struct(F.when(n["path"] == "", "value").otherwise(n["path"]).alias("path"), n["value"].alias("value")))


def _in_order(found: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.transform(found, lambda x: F.struct(x["path"].alias("key"), F.to_json(x["value"]).alias("value")))))


def flattened(record: Column) -> Column:
    """map<path, JSON text> of a variant's leaves in path order."""
    return _in_order(leaves(record))


def business_leaves(record: Column, operational: tuple[str, ...]) -> Column:
    """map<path, JSON text> of the leaves that tell something of the business: lists are values, and fields of the
    ``operational`` names are left out at any level, with all below them."""
    hidden = tuple(name.lower() for name in operational)
    return _in_order(F.filter(_named(_shapes(record, "none", hidden)), lambda x: ~F.coalesce(_fields(x["value"]).isNotNull(), F.lit(False)) | (x["path"] == "value")))


def leaf_count(record: Column) -> Column:
    """How many leaves a variant has; a list counts as its first element, an empty container as one."""
    return F.size(_shapes(record, "all"))


def observed(record: Column, names_deep: int = NAMES_DEEP, most: int = ELEMENTS) -> Column:
    """array<struct<path, kind, deeper>>: every field and list element of a record; ``deeper``: an object whose fields were
    not looked at. Here ``depth`` counts names; elements carry ``[]`` and no name."""
    def has_fields(node: Column) -> Column:
        return F.coalesce(F.size(_fields(node["value"])) > 0, F.lit(False))

    def opens(node: Column) -> Column:
        # a list of lists says that its elements are lists and no more
        return (has_fields(node) & (node["depth"] < names_deep)) | (~node["path"].endswith("[]") & F.coalesce(F.size(_elements(node["value"])) > 0, F.lit(False)))

    def children(node: Column) -> Column:
        fields = _fields(node["value"])
        named = F.transform(F.map_entries(fields), lambda e: _node(_below(node["path"], e["key"]), node["depth"] + 1, e["value"]))
        inside = F.transform(F.slice(_elements(node["value"]), 1, most), lambda x: _node(F.concat(node["path"], F.lit("[]")), node["depth"], x))
        return F.when(fields.isNotNull(), named).otherwise(inside)

    found = F.filter(_walked(record, opens, children, 2 * names_deep + 1, keep_opened=True), lambda n: n["path"] != "")
    return F.transform(found, lambda n: F.struct(n["path"].alias("path"), kind(n["value"]).alias("kind"), ((n["depth"] >= names_deep) & has_fields(n)).alias("deeper")))


def structure(rows: DataFrame, record: Column, names_deep: int = NAMES_DEEP, most: int = ELEMENTS) -> DataFrame:
    """(path, present, n_values, nulls, presence, types, element_types, source_type, field_type, truncated) of a collection, one aggregate
    whose parts add up. ``present``: records that hold the path; ``types`` and ``element_types``: how many values of each kind."""
    counts = census.counted(rows, record, names_deep, most).groupBy("path", "kind").agg(F.sum("n").alias("n"), F.max("truncated").alias("truncated"))
    counts = staged(counts, "paths")  # written, for the number of records is read from it besides, and would be counted by a second walk
    # what follows has a row for each path and kind, not for records
    element_of = F.when(F.col("path").endswith("[]"), F.substring("path", F.lit(1), F.length("path") - 2))
    by_path = counts.withColumn("of", F.coalesce(element_of, "path")).withColumn("side", F.when(element_of.isNotNull(), "element").otherwise("value"))
    total = F.max(F.when(F.col("kind") == "record", F.col("n")))
    histogram = lambda side: F.array_sort(F.collect_list(F.when((F.col("side") == side) & ~F.col("kind").isin("present", "record"), F.struct("kind", "n"))))
    fields = by_path.where("kind <> 'record'").groupBy("of").agg(
        F.sum(F.when((F.col("side") == "value") & (F.col("kind") == "present"), F.col("n"))).alias("present"), F.sum(F.when((F.col("side") == "value") & (F.col("kind") != "present"), F.col("n"))).alias("n_values"),
        F.coalesce(F.sum(F.when((F.col("side") == "value") & (F.col("kind") == "null"), F.col("n"))), F.lit(0)).alias("nulls"), histogram("value").alias("t"), histogram("element").alias("e"), F.max("truncated").alias("truncated"),
    )
    fields = fields.crossJoin(F.broadcast(by_path.agg(total.alias("records"))))  # one row
    said = lambda pairs: F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["kind"], x["n"].cast("string"))), ",")
    return fields.select(
        F.col("of").alias("path"), "present", "n_values", "nulls", F.round(F.col("present") / F.col("records"), 6).alias("presence"), said("t").alias("types"), said("e").alias("element_types"),
        source_type(F.col("t"), F.col("e")).alias("source_type"), field_type(F.col("t")).alias("field_type"), "truncated",
    )


def _kinds(pairs: Column) -> Column:
    return F.filter(F.transform(pairs, lambda x: x["kind"]), lambda k: k != "null")


def source_type(types: Column, elements: Column) -> Column:
    """The rendered type: one kind, ``mixed<...>``, ``array<...>`` by its elements, ``array<empty>``, or null."""
    def mixed(kinds: Column) -> Column:
        return F.when(F.size(kinds) > 1, F.concat(F.lit("mixed<"), F.array_join(kinds, "|"), F.lit(">"))).otherwise(F.get(kinds, 0))

    own, inner = _kinds(types), _kinds(elements)
    of = F.when(F.size(inner) > 0, mixed(inner)).when(F.size(elements) > 0, "null").otherwise("empty")
    return F.when(F.size(own) == 0, "null").when((F.size(own) == 1) & (F.get(own, 0) == "array"), F.concat(F.lit("array<"), of, F.lit(">"))).otherwise(mixed(own))


#: The common type of each kind.
COMMON = {"string": "string", "int": "integer", "long": "integer", "double": "decimal", "bool": "boolean", "object": "object", "array": "array"}


def field_type(types: Column) -> Column:
    """The type that is true of all values: integer and decimal widen to decimal; else unknown."""
    table = F.create_map(*(F.lit(x) for pair in COMMON.items() for x in pair))
    common = F.array_sort(F.array_distinct(F.transform(_kinds(types), lambda k: F.coalesce(F.try_element_at(table, k), F.lit("unknown")))))
    return F.when(F.size(common) == 1, F.get(common, 0)).when(common == F.array(F.lit("decimal"), F.lit("integer")), "decimal").otherwise("unknown")
