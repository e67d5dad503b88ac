"""OpenAPI documents in JSON or YAML: what they are, their operations, and what these refer to."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import path_key
from factloom.operators.ordering import join_hot
from factloom.runtime import stage

try:
    import yaml
except ImportError:  # YAML documents are then given as unreadable
    yaml = None

#: Methods of the OpenAPI standard (fixed values).
_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
_PARAMETER = "array<struct<name:string,`in`:string>>"
MAX_DEPTH = 32


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def _yaml(text: str) -> object:
    if yaml is None:
        return None
    try:
        return json.loads(json.dumps(yaml.safe_load(text), default=str))
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return None


def read(text: str | None) -> tuple[str, object]:
    """(status, value) of a document."""
    if not text:
        return "CONTRACT_SOURCE_UNAVAILABLE", None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        value = _yaml(text)
    if not isinstance(value, dict):
        return "INVALID_CONTRACT_JSON_YAML", None
    return ("DECLARED_OPENAPI" if isinstance(value.get("openapi"), str) or isinstance(value.get("swagger"), str) else "REGISTERED_REFERENCE_DOCUMENT"), value


def _at(value: object, pointer: str) -> object:
    for part in pointer.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _named(value: dict) -> dict:
    """The document with references among its parameters put in place, as far as they stay in it."""
    for item in (value.get("paths") or {}).values() if isinstance(value.get("paths"), dict) else ():
        for holder in (item, *item.values()) if isinstance(item, dict) else ():
            if isinstance(holder, dict) and isinstance(holder.get("parameters"), list):
                holder["parameters"] = [_at(value, p["$ref"][1:]) or p if isinstance(p, dict) and str(p.get("$ref", "")).startswith("#/") else p for p in holder["parameters"]]
    return value


def _references(file: str, value: object) -> Iterator[tuple[str, str | None]]:
    """(place, target) of each reference, for all places that hold it; (place, null) for the place itself."""
    todo: list[tuple[str, object]] = [("", value)]
    while todo:
        at, x = todo.pop()
        yield f"{file}#{at}", None
        for k, y in x.items() if isinstance(x, dict) else enumerate(x):
            if k == "$ref" and isinstance(y, str):
                target, _, pointer = y.partition("#")
                if "://" not in target:
                    target = posixpath.normpath(posixpath.join(posixpath.dirname(file), target)) if target else file
                    y = f"{target}#{pointer}"
                parts = at.split("/")
                for n in range(1, len(parts) + 1):
                    yield f"{file}#{'/'.join(parts[:n])}", y
            elif isinstance(y, (dict, list)):
                todo.append((f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}", y))


def documents(docs: DataFrame, file: str, text: str) -> DataFrame:
    """(file, status, body): each document with its JSON; documents that can't be read come out without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read(t) for t in b.column("text").to_pylist()]
            bodies = [None if v is None else json.dumps(_named(v)) for _, v in found]
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array([s for s, _ in found], pa.string()), pa.array(bodies, pa.string())], names=["file", "status", "body"])

    return docs.select(F.col(file).cast("string").alias("file"), F.col(text).cast("string").alias("text")).mapInArrow(run, "file string, status string, body string")


def operations(docs: DataFrame, file: str, text: str) -> DataFrame:
    """(file, method, path, path_key, operation_id, parameters): one row per operation.

    Parameters of the operation come before those of its path; of one name and place its own counts.
    Documents that can't be read give none; ``documents`` says which they are.
    """
    body = documents(docs, file, text).where("body is not null").withColumnRenamed("file", file)
    doc = F.from_json("body", "struct<paths:map<string,map<string,string>>>")
    rows = body.select(file, F.explode(doc["paths"]).alias("path", "item")).select(file, "path", F.from_json(F.element_at("item", "parameters"), _PARAMETER).alias("shared"), F.explode("item").alias("method", "op"))
    rows = rows.where(F.lower("method").isin(*_METHODS))
    op = F.from_json("op", f"struct<operationId:string,parameters:{_PARAMETER}>")
    own = F.coalesce(op["parameters"], F.from_json(F.lit("[]"), _PARAMETER))
    name = lambda p: F.concat_ws(":", p["in"], p["name"])
    rest = F.filter(F.coalesce("shared", F.from_json(F.lit("[]"), _PARAMETER)), lambda p: ~F.array_contains(F.transform(own, name), name(p)))
    return rows.select(file, F.upper("method").alias("method"), "path", path_key("path").alias("path_key"), op["operationId"].alias("operation_id"), F.transform(F.concat(own, rest), name).alias("parameters"))


def references(docs: DataFrame, file: str, text: str, depth: int = MAX_DEPTH) -> DataFrame:
    """(file, method, path, reference, status): what an operation refers to, at first or second hand, also in other documents.

    RESOLVED, MISSING (no such place in the documents), EXTERNAL (an address), or BEYOND_DEPTH.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted({r for f, t in zip(b.column("file").to_pylist(), b.column("text").to_pylist()) if f is not None and (v := read(t)[1]) is not None for r in _references(f, v)}, key=repr)
            cols = list(zip(*rows)) if rows else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["place", "target"])

    src = docs.select(F.col(file).cast("string").alias("file"), F.col(text).cast("string").alias("text"))
    held = stage(src.mapInArrow(run, "place string, target string").distinct(), "references")
    links, places = held.where("target is not null"), held.where("target is null").select(F.col("place").alias("reference"), F.lit(True).alias("there"))
    parts = F.split_part("place", F.lit("#/paths/"), F.lit(2))
    op = links.where(F.contains("place", F.lit("#/paths/")) & F.split_part(parts, F.lit("/"), F.lit(2)).isin(*_METHODS) & (F.split_part(parts, F.lit("/"), F.lit(3)) == ""))
    seen = front = stage(op.select(F.col("place").alias("op"), F.col("target").alias("reference")).distinct(), "reached")
    for n in range(depth + 1):
        step = front.join(links.withColumnRenamed("place", "reference"), "reference").select("op", F.col("target").alias("reference")).distinct()
        front = stage(step.join(seen, ["op", "reference"], "left_anti"), "reached")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front.withColumn("far", F.lit(n == depth)) if n == depth else front, allowMissingColumns=True)
    far = F.coalesce("far", F.lit(False)) if "far" in seen.columns else F.lit(False)
    out = join_hot(seen, places, ["reference"], "left", by=["op"])
    status = F.when(far, "BEYOND_DEPTH").when(F.contains("reference", F.lit("://")), "EXTERNAL").when(F.col("there"), "RESOLVED").otherwise("MISSING")
    at = F.split_part("op", F.lit("#/paths/"), F.lit(2))
    path = F.replace(F.replace(F.split_part(at, F.lit("/"), F.lit(1)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return out.select(F.split_part("op", F.lit("#/paths/"), F.lit(1)).alias(file), F.upper(F.split_part(at, F.lit("/"), F.lit(2))).alias("method"), path.alias("path"), "reference", status.alias("status"))
