"""Canonical JSON and what is read from it.  Recursion over values of unknown depth needs Python; it goes by Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

DEPTH, STRINGS = 64, 65_536
_DIGEST = re.compile(r"sha256:[0-9a-f]{64}\Z")
#: Keys that only say where in a source something was found (fixed values).
SOURCE_KEYS = frozenset(("file", "start", "end", "orderKey", "sourceProvenance"))


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is repeated")
    return out


def parse(text: str | None) -> tuple[bool, object]:
    """(readable, value); repeated keys and numbers that JSON lacks make a text unreadable."""

    def refuse(x: str) -> None:
        raise ValueError(x)

    try:
        return True, json.loads(text or "", object_pairs_hook=_unique, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False, None


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _each(series: pd.Series, f) -> pd.Series:
    out = []
    for t in series:
        ok, v = parse(t)
        out.append(f(v) if ok else None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Keys sorted at every level, arrays in order, no white space; null for what can't be read."""
    return _each(text, canonical)


@F.pandas_udf(StringType())
def canonical_digest(text: pd.Series) -> pd.Series:
    """``sha256:`` and the digest of the canonical form."""
    return _each(text, lambda v: "sha256:" + hashlib.sha256(canonical(v).encode("utf-8", "surrogatepass")).hexdigest())


def strings_in(value: object) -> list[str] | None:
    """Sorted distinct strings of a value that are no canonical digests; null for values deeper than DEPTH or with more than STRINGS of them."""
    out, todo = set(), [(value, 0)]
    while todo:
        v, depth = todo.pop()
        if depth > DEPTH or len(out) > STRINGS:
            return None
        if isinstance(v, str):
            if not _DIGEST.match(v):
                out.add(v)
        elif isinstance(v, dict):
            todo += [(x, depth + 1) for x in v.values()]
        elif isinstance(v, list):
            todo += [(x, depth + 1) for x in v]
    return sorted(out)


@F.pandas_udf(ArrayType(StringType()))
def json_strings(text: pd.Series) -> pd.Series:
    return _each(text, strings_in)


def without_source(value: object) -> object:
    if isinstance(value, dict):
        return {k: without_source(v) for k, v in value.items() if k not in SOURCE_KEYS}
    return [without_source(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def strip_source(text: pd.Series) -> pd.Series:
    """The canonical form without source positions at any level."""
    return _each(text, lambda v: canonical(without_source(v)))


#: What a term counts for by the key of the string that holds it; all other keys count 1 (fixed values).
WEIGHTS = {
    16: ("symbolIdentity", "compilerCallableId", "compilerClassId", "ownerIdentity"),
    8: ("path", "file", "fileId", "relativePath", "sourcePath"),
    6: ("name", "declarationKind"),
    0: ("sourceSet", "module", "provider", "schema"),
}
LEAF_DEPTH = 32


def string_leaves(value: object) -> list[dict[str, str | None]]:
    """Strings of a value with the key of the member that holds them, at most LEAF_DEPTH levels down."""
    out: list[dict[str, str | None]] = []
    level: list[tuple[str | None, object]] = [(None, value)]
    for _ in range(LEAF_DEPTH + 1):
        below: list[tuple[str | None, object]] = []
        for key, v in level:
            if isinstance(v, str):
                out.append({"key": key, "value": v})
            elif isinstance(v, dict):
                below += v.items()
            elif isinstance(v, list):
                below += [(key, x) for x in v]
        level = below
    return out


@F.pandas_udf(ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType())])))
def json_leaves(text: pd.Series) -> pd.Series:
    return _each(text, string_leaves)


def weighted_score(text: Column, terms: list[str]) -> Column:
    """How much a JSON payload has to do with terms: the sum of weight x terms held over its strings."""
    held = lambda leaf: sum((F.contains(F.lower(leaf["value"]), F.lit(t)).cast("long") for t in terms), F.lit(0).cast("long"))

    def weigh(leaf: Column) -> Column:
        out = F.lit(1)
        for w, keys in WEIGHTS.items():
            out = F.when(leaf["key"].isin(*keys), w).otherwise(out)
        return out

    return F.aggregate(F.coalesce(json_leaves(text), F.array().cast("array<struct<key:string,value:string>>")), F.lit(0).cast("long"), lambda acc, leaf: acc + weigh(leaf) * held(leaf))


def members(text: Column | str) -> Column:
    """Members of a JSON object as a map of text; null for other values."""
    return F.from_json(text, "map<string,string>")


def without_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def differing_keys(a: Column, b: Column) -> Column:
    """Sorted keys of two maps whose values differ, nulls and missing ones included."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.array_sort(F.filter(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)) | (F.array_contains(F.map_keys(a), k) != F.array_contains(F.map_keys(b), k))))
