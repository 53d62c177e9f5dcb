"""API descriptions (OpenAPI 3, Swagger 2) as lists of operations and fields. Local references only."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_METHODS = ("get", "put", "post", "delete", "patch", "head", "options")
_FORMATS = {"date": "date", "date-time": "datetime", "byte": "binary", "binary": "binary"}
_TYPES = {"string": "string", "integer": "integer", "number": "decimal", "boolean": "boolean", "object": "object", "array": "array"}
DEPTH = 12


def resolve(spec: dict, node: Any, seen: tuple[str, ...] = ()) -> Any:
    """The node a local reference points to; cycles and remote references give an empty schema."""
    while isinstance(node, dict) and "$ref" in node:
        ref = node["$ref"]
        if not ref.startswith("#/") or ref in seen:
            return {}
        seen = (*seen, ref)
        node = spec
        for part in ref[2:].split("/"):
            node = node.get(part.replace("~1", "/").replace("~0", "~"), {}) if isinstance(node, dict) else {}
    return node


def fields(spec: dict, schema: Any, path: str = "", seen: tuple[str, ...] = ()) -> list[tuple[str, str, bool]]:
    """(dotted path, common type, required) of a schema's leaves and branches; of several ``allOf`` parts the first wins."""
    if len(path.split(".")) > DEPTH:
        return []
    if isinstance(schema, dict) and "$ref" in schema:
        if schema["$ref"] in seen:
            return []
        seen = (*seen, schema["$ref"])
        schema = resolve(spec, schema)
    merged: dict = {}
    required: set[str] = set(schema.get("required", ()))
    for part in [schema, *(resolve(spec, p) for p in schema.get("allOf", ()))]:
        required |= set(part.get("required", ()))
        for name, child in part.get("properties", {}).items():
            merged.setdefault(name, child)
    out = []
    for name, child in merged.items():
        own = resolve(spec, child)
        kind = "variant" if "oneOf" in own or "anyOf" in own else _FORMATS.get(own.get("format", ""), _TYPES.get(own.get("type", "object" if "properties" in own else ""), "unknown"))
        here = f"{path}.{name}" if path else name
        out.append((here, kind, name in required))
        if kind == "object":
            out += fields(spec, child, here, seen)
        elif kind == "array":
            out += fields(spec, own.get("items", {}), here + "[]", seen)
    return out


def operations(spec: dict) -> list[tuple[str, str, str, str]]:
    """(method, path, parameter names, success schema's name); an operation's own parameters replace shared ones."""
    out = []
    for path, item in sorted(spec.get("paths", {}).items()):
        shared = {(p["name"], p["in"]): p for p in (resolve(spec, x) for x in item.get("parameters", ())) if "name" in p}
        for method in _METHODS:
            if method in item:
                own = {(p["name"], p["in"]): p for p in (resolve(spec, x) for x in item[method].get("parameters", ())) if "name" in p}
                ok = next((resolve(spec, r) for code, r in sorted(item[method].get("responses", {}).items()) if code.startswith("2")), {})
                schema = ok.get("schema") or next((c.get("schema", {}) for c in ok.get("content", {}).values()), {})
                ref = schema.get("$ref") or schema.get("items", {}).get("$ref", "")
                out.append((method.upper(), path, ",".join(sorted(n for n, _ in shared | own)), ref.rpartition("/")[2]))
    return out


def parse(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Operations and fields of a description in JSON."""
    spec = json.loads(text)
    if not ("openapi" in spec or "swagger" in spec):
        raise ValueError("this is no API description")
    models = spec.get("components", {}).get("schemas", {}) | spec.get("definitions", {})
    rows = [(entity, *f) for entity, schema in sorted(models.items()) for f in fields(spec, schema, seen=(f"#/components/schemas/{entity}", f"#/definitions/{entity}"))]
    return spark.createDataFrame(operations(spec), "method string, path string, parameters string, entity string"), spark.createDataFrame(rows, "entity string, field string, type string, required boolean")
