"""Text functions as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and spellings that decide results.
NULL_WORDS = ("nan", "none", "null", "nat", "")
NOISE_TOKENS = ("tbl", "table", "the", "a", "an", "of", "erp", "col", "column", "fld", "field", "master", "mst", "dim", "fact", "stg", "staging", "tmp", "temp")
ABBREVIATIONS = {
    "cust": "customer", "custs": "customer", "clnt": "client", "inv": "invoice", "invc": "invoice", "no": "number", "num": "number", "nbr": "number",
    "amt": "amount", "qty": "quantity", "desc": "description", "addr": "address", "tel": "telephone", "ph": "phone", "dt": "date", "ts": "timestamp",
    "ref": "reference", "id": "id", "ident": "id", "po": "purchase_order", "sup": "supplier", "supp": "supplier", "vend": "vendor", "ccy": "currency",
    "curr": "currency", "stat": "status", "tot": "total",
}
SYNONYMS = {
    "mail": "email", "e": "email", "telephone": "phone", "mobile": "phone", "client": "customer", "buyer": "customer", "vendor": "supplier", "sum": "total",
    "value": "amount", "state": "status", "code": "id", "key": "id", "identifier": "id",
}
TYPE_PREFIXES = (
    ("VARBINARY", "binary"), ("BYTEA", "binary"), ("LONGBLOB", "binary"), ("MEDIUMBLOB", "binary"), ("TINYBLOB", "binary"), ("BLOB", "binary"), ("BINARY", "binary"), ("IMAGE", "binary"),
    ("JSONB", "object"), ("JSON", "object"), ("HSTORE", "object"), ("ARRAY", "array"),
    ("UNIQUEIDENTIFIER", "string"), ("UUID", "string"), ("XML", "string"), ("NVARCHAR", "string"), ("NCHAR", "string"), ("NTEXT", "string"), ("LONGTEXT", "string"), ("MEDIUMTEXT", "string"),
    ("TINYTEXT", "string"), ("VARCHAR", "string"), ("CHARACTER VARYING", "string"), ("CITEXT", "string"), ("TEXT", "string"), ("CHAR", "string"), ("ENUM", "string"), ("SET", "string"),
    ("INET", "string"), ("CIDR", "string"), ("MACADDR", "string"),
    ("SMALLMONEY", "decimal"), ("MONEY", "decimal"), ("NUMERIC", "decimal"), ("DECIMAL", "decimal"), ("DOUBLE", "decimal"), ("FLOAT", "decimal"), ("REAL", "decimal"),
    ("BIGINT", "integer"), ("SMALLINT", "integer"), ("TINYINT", "integer"), ("MEDIUMINT", "integer"), ("INTEGER", "integer"), ("INT", "integer"), ("SERIAL", "integer"),
    ("BOOLEAN", "boolean"), ("BOOL", "boolean"), ("BIT", "boolean"),
    ("SMALLDATETIME", "datetime"), ("DATETIMEOFFSET", "datetime"), ("DATETIME2", "datetime"), ("DATETIME", "datetime"), ("TIMESTAMP", "datetime"), ("DATE", "date"),
)


def null_if_marked(value: Column, markers: tuple[str, ...], fold_case: bool = True, empty_is_null: bool = False) -> Column:
    """Null where the text is one of the markers."""
    text = F.lower(value) if fold_case else value
    marked = text.isin([m.lower() if fold_case else m for m in markers])
    return F.when(~(marked | (F.lit(empty_is_null) & (value == ""))), value)


def text_or_null(value: Column) -> Column:
    """Trimmed text; words that stand for nothing become null."""
    text = F.btrim(value)
    return F.when(~F.lower(text).isin(*NULL_WORDS), text)


def normalized(value: Column, collapse: bool = True, trim: bool = True, case: str | None = None) -> Column:
    out = F.regexp_replace(value, r"\s+", " ") if collapse else value
    out = F.btrim(out) if trim else out
    return F.lower(out) if case == "lower" else F.upper(out) if case == "upper" else out


def identifier(value: Column) -> Column:
    """Lower case; white space and other characters than a-z, 0-9, _ . - become single underscores, none at the ends."""
    steps = ((r"\s+", "_"), (r"[^a-z0-9_.\-]", "_"), (r"_+", "_"), (r"^_+|_+$", ""))
    return reduce(lambda text, step: F.regexp_replace(text, *step), steps, F.lower(F.btrim(value)))


def humanized(name: Column) -> Column:
    """Words between dots and underscores with capital initials; capitals inside words stay."""
    words = F.filter(F.split(name, r"[._]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def split_tokens(name: Column) -> Column:
    """Words of a name: split at separators, camel case, other characters, and between two letters and a digit."""
    steps = ((r"[\s_\-./\\:]+", " "), (r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))
    low = F.lower(reduce(lambda text, step: F.regexp_replace(text, *step), steps, name))
    low = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", " "), r"(?<=[a-z]{2})(?=\d)|(?<=\d)(?=[a-z])", " ")
    return F.filter(F.split(low, " "), lambda w: w != "")


def _looked_up(table: dict[str, str], word: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), word), word)


def canonical_tokens(name: Column) -> Column:
    """Tokens with abbreviations expanded, synonyms folded and noise dropped unless nothing else is there."""
    words = F.flatten(F.transform(split_tokens(name), lambda w: F.split(_looked_up(ABBREVIATIONS, w), "_")))
    words = F.transform(words, lambda w: _looked_up(SYNONYMS, w))
    kept = F.filter(words, lambda w: ~w.isin(*NOISE_TOKENS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / union, 6))


def clipped(text: Column, limit: int, marker: str) -> Column:
    """At most ``limit`` characters, the last of which are the marker where something went."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(marker)), F.lit(marker))).otherwise(text)


def csv_kind(value: Column, null_markers: tuple[str, ...] = ()) -> Column:
    """What a delimited file's field looks like."""
    text = F.btrim(value)
    ladder = F.when(text == "", "empty")
    if null_markers:
        ladder = ladder.when(F.lower(text).isin(*null_markers), "null_marker")
    return (
        ladder.when(F.lower(text).isin("true", "false"), "boolean").when(text.rlike(r"^[+-]?(0|[1-9]\d*)$"), "integer").when(text.rlike(r"^[+-]?((\d+\.\d*|\.\d+)([eE][+-]?\d+)?|\d+[eE][+-]?\d+)$") & ~text.rlike(r"^[+-]?0\d"), "decimal")
        .when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"), "date").when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"), "datetime").otherwise("string")
    )


def common_type(raw: Column) -> Column:
    """The common type of a vendor's type name: that of the first prefix it has."""
    name = F.upper(F.btrim(raw))
    ladder = F.when(F.coalesce(name, F.lit("")) == "", "unknown")
    for prefix, kind in TYPE_PREFIXES:
        ladder = ladder.when(name.startswith(prefix), kind)
    return ladder.otherwise("unknown")
