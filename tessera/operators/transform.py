"""Records to canonical records: validation, issues, duplicates, run summary, stopping early.

Every operator that depends on an order takes a total order column; windows are
partitioned by key, and runs are summed up by range, so nothing is sorted in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.prefix import sums_before

ERROR, WARNING = "error", "warning"


def issue(when: Column, code: str, field: str, severity: str = ERROR) -> Column:
    """An issue struct where ``when`` holds, else null."""
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))


def gathered(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda i: i.isNotNull())


def required(value: Column, field: str, present: Column | None = None) -> list[Column]:
    """A missing field and a null one give different codes."""
    if present is None:
        return [issue(value.isNull(), "NULL_NOT_ALLOWED", field)]
    return [issue(~present, "REQUIRED_FIELD_MISSING", field), issue(present & value.isNull(), "NULL_NOT_ALLOWED", field)]


def allowed(value: Column, field: str, values: Sequence[str]) -> Column:
    return issue(value.isNotNull() & ~value.isin(*values), "VALUE_NOT_ALLOWED", field)


def in_range(value: Column, field: str, low: float | None = None, high: float | None = None) -> list[Column]:
    out = []
    if low is not None:
        out.append(issue(value < low, "BELOW_MINIMUM", field))
    if high is not None:
        out.append(issue(value > high, "ABOVE_MAXIMUM", field))
    return out


def matching(value: Column, field: str, pattern: str | None = None, shortest: int | None = None, longest: int | None = None) -> list[Column]:
    out = []
    if shortest is not None:
        out.append(issue(F.length(value) < shortest, "TOO_SHORT", field))
    if longest is not None:
        out.append(issue(F.length(value) > longest, "TOO_LONG", field))
    if pattern is not None:
        out.append(issue(~value.rlike(f"^(?:{pattern})$"), "PATTERN_MISMATCH", field))
    return out


def referenced(records: DataFrame, column: str, known: DataFrame, key: str, flag: str = "reference_exists") -> DataFrame:
    """Adds whether the column's value is a key of ``known``; null where there is no value."""
    keys = known.select(F.col(key).alias("_key_")).distinct().withColumn("_known_", F.lit(True))
    joined = records.join(keys, records[column] == F.col("_key_"), "left")
    return joined.withColumn(flag, F.when(F.col(column).isNotNull(), F.coalesce("_known_", F.lit(False)))).drop("_key_", "_known_")


def blocking(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"] == ERROR)


def reasons(issues: Column) -> Column:
    """Distinct blocking codes in order of appearance."""
    return F.array_distinct(F.transform(F.filter(issues, lambda i: i["severity"] == ERROR), lambda i: i["code"]))


def issue_rows(records: DataFrame, key: str) -> DataFrame:
    """One row an issue, with an id that follows from what it says."""
    rows = records.select(key, F.explode("issues").alias("i")).select(key, "i.code", "i.field", "i.severity")
    return rows.withColumn("issue_id", F.concat(F.lit("iss."), F.substring(F.sha2(F.concat_ws("|", "code", F.col(key).cast("string"), "field"), 256), 1, 20)))


def duplicates(records: DataFrame, key: Sequence[Column], order: Sequence[str], policy: str) -> DataFrame:
    """Adds ``occurrence``, ``first_seen`` (the first one's order value) and ``outcome`` under REJECT, SKIP, WARN or ALLOW.

    A key with a null part is never a duplicate.
    """
    whole = F.lit(True)
    for k in key:
        whole = whole & k.isNotNull()
    joined = F.when(whole, F.concat_ws("\x1f", *[k.cast("string") for k in key])).otherwise(F.concat(F.lit("\x00"), *[F.col(o).cast("string") for o in order]))
    at = W.partitionBy(joined).orderBy(*order)
    out = records.withColumn("occurrence", F.row_number().over(at)).withColumn("first_seen", F.first(order[0]).over(at))
    later = {"REJECT": "rejected", "SKIP": "skipped", "WARN": "accepted_with_warning", "ALLOW": "accepted"}[policy]
    return out.withColumn("outcome", F.when(F.col("occurrence") > 1, later).otherwise("accepted"))


def run_summary(records: DataFrame, outcome: str = "outcome", max_failed: float = 0.5, min_transformed: float = 0.1) -> DataFrame:
    """One row: counts, ratios and the run's status; ratios use strict comparisons."""
    def n(kind: str) -> Column:
        return F.count_if(F.col(outcome) == kind)

    out = records.agg(F.count("*").alias("n_read"), n("accepted").alias("n_transformed"), n("rejected").alias("n_failed"), n("skipped").alias("n_skipped"))
    ratio = {c: F.when(F.col("n_read") > 0, F.round(F.col(f"n_{c}") / F.col("n_read"), 6)).otherwise(0.0) for c in ("failed", "transformed")}
    out = out.withColumns({f"{c}_ratio": r for c, r in ratio.items()})
    bad = (F.col("n_read") > 0) & ((F.col("failed_ratio") > max_failed) | (F.col("transformed_ratio") < min_transformed))
    return out.withColumn("status", F.when(bad, "FAILED").when(F.col("n_failed") > 0, "PARTIAL").otherwise("SUCCEEDED"))


def before_threshold(records: DataFrame, run: str, order: str, failed: Column, most: int) -> DataFrame:
    """The records of each run up to the one whose failure is the ``most``-th and one more."""
    return sums_before(records, [run], [order], {"failures_before": failed.cast("long")}).where(F.col("failures_before") <= most)


JSON_KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "decimal": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def typed(value: Column, field: str, expected: str) -> Column:
    """An issue where a JSON text holds a value of another type than ``expected``; none for missing values and nulls.

    Text that is no JSON holds a value of no type.
    """
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json(value)), "^[A-Z]+", 0)
    wrong = F.coalesce(~kind.isin("VOID", *JSON_KINDS[expected]), F.lit(True))
    return issue(value.isNotNull() & wrong, "DATATYPE_MISMATCH", field)


def nested(values: Mapping[str, Column]) -> Column:
    """A struct from columns by dotted paths; a path that is given twice, or both as a value and as an object, is refused."""
    tree: dict = {}
    for path, column in values.items():
        *above, leaf = path.split(".")
        at = tree
        for i, part in enumerate(above):
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ValueError(f"{'.'.join(above[: i + 1])} holds a value and cannot hold {path}")
        if leaf in at:
            raise ValueError(f"{path} is assigned twice")
        at[leaf] = column

    def struct_of(node: dict) -> Column:
        return F.struct(*[(struct_of(x) if isinstance(x, dict) else x).alias(name) for name, x in node.items()])

    return struct_of(tree)


def computed_order(sources: Mapping[str, Sequence[str]]) -> list[str]:
    """Computed fields in an order in which each comes after those it needs; a cycle is refused. Fields of the record
    itself, and a field's own former value, ask for no order."""
    needs = {target: [s for s in of if s in sources and s != target] for target, of in sources.items()}
    try:
        return [*TopologicalSorter(needs).static_order()]
    except CycleError as cycle:
        raise ValueError(f"computed fields need each other: {' -> '.join(reversed(cycle.args[1]))}") from None


def with_computed(records: DataFrame, fields: Mapping[str, tuple[Sequence[str], Callable[..., Column]]]) -> DataFrame:
    """Adds computed fields, each (sources, a function of their columns), in an order that their sources allow."""
    for target in computed_order({t: of for t, (of, _) in fields.items()}):
        of, made = fields[target]
        records = records.withColumn(target, made(*map(F.col, of)))
    return records
