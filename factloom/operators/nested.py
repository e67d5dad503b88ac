"""Nested JSON records to related flat tables, by shared inlining.

A first pass draws the schema graph: element types (member names, in one
spelling) and for each parent and child whether the child repeats or is an
object.  Types that are the root, repeat, are objects below several parents or
lie on a cycle of the graph get a table; all other types are inlined into the
table of their parent, as columns named by their path.  A second pass writes
the rows; each keeps its record, its number in the record, and table, number
and path of the row it hangs on.  Where two members of one object mean the same
column (``startByte`` and ``start_byte``), the second value stands in a column of
the same name with ``#2``, and so on.

Defined results: null keys and unreadable or non-object bodies give no row
(a body that is a JSON string of JSON counts as what it holds); of repeated
keys the row loaded last counts; nulls and empty arrays are absent members;
arrays in arrays count as one array; an empty table gives empty results;
further columns are ignored.  Only edges to objects and repeated members come to
the driver; should they be more than EDGE_LIMIT (as where keys are data), it is
decided where they stand: members of arrays, and objects inside an object of
their own type, are rows, and all others are inlined.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ordering import latest
from factloom.runtime import stage

ROOT = "root"
VALUE = "#value"
EDGE_LIMIT = 10_000
_names: dict[str, str] = {}


def _clean(s: str) -> str:
    return s.encode("utf-8", "replace").decode()


def type_name(name: str) -> str:
    """One spelling of a member name: camel case, singular."""
    if name not in _names:
        parts = [p for p in re.split(r"[_\-\s.]+", name) if p]
        out = "".join(p if i == 0 else p[:1].upper() + p[1:] for i, p in enumerate(parts))
        out = out[:1].lower() + out[1:]
        if len(out) > 3 and out.endswith("s") and not out.endswith(("ss", "us", "is")):
            out = out[:-1]
        if len(_names) > 100_000:
            _names.clear()
        _names[name] = _clean(out) or "member"
    return _names[name]


def read_record(body: str | None) -> dict | None:
    v: object = body
    for _ in range(3):
        if not isinstance(v, str):
            break
        try:
            v = json.loads(v)
        except (ValueError, RecursionError):
            return None
    return v if isinstance(v, dict) else None


def _items(v: object) -> Iterator[object]:
    """Members of arrays at any depth, nulls left out."""
    if isinstance(v, list):
        todo = [iter(v)]
        while todo:
            x = next(todo[-1], StopIteration)
            if x is StopIteration:
                todo.pop()
            elif isinstance(x, list):
                todo.append(iter(x))
            elif x is not None:
                yield x
    elif v is not None:
        yield v


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for body in b.column("body").to_pylist():
            v = read_record(body)
            todo = [(ROOT, v)] if v is not None else []
            while todo:
                t, x = todo.pop()
                for name, y in x.items():
                    c = type_name(name)
                    for z in _items(y):
                        seen[t, c, isinstance(y, list), isinstance(z, dict)] += 1
                        if isinstance(z, dict):
                            todo.append((c, z))
    rows = [(*k, n) for k, n in seen.items()]
    cols = list(zip(*rows)) if rows else [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()))], names=["parent", "child", "repeats", "object", "n"])


@dataclass
class Schema:
    """Which types have a table, and why."""

    tables: dict[str, str] = field(default_factory=lambda: {ROOT: "ROOT"})
    edges: list[tuple[str, str, bool, bool, int]] = field(default_factory=list)


def analyse(edges: list[tuple[str, str, bool, bool, int]]) -> Schema:
    kids: dict[str, set[str]] = defaultdict(set)
    parents: dict[str, set[str]] = defaultdict(set)
    repeats, objects = set(), set()
    for p, c, many, obj, _ in edges:
        kids[p].add(c)
        parents[c].add(p)
        if many:
            repeats.add(c)
        if obj:
            objects.add(c)

    def on_cycle(t: str) -> bool:
        todo, seen = list(kids[t]), set()
        while todo:
            x = todo.pop()
            if x == t:
                return True
            if x not in seen:
                seen.add(x)
                todo += kids.get(x, ())
        return False

    schema = Schema(edges=sorted(edges))
    for t in sorted(parents):
        if t in objects and on_cycle(t):
            schema.tables[t] = "RECURSIVE"
        elif t in repeats:
            schema.tables[t] = "REPEATED"
        elif t in objects and len(parents[t]) > 1:
            schema.tables[t] = "SHARED"
    return schema


#: ``name`` is the column id or the value of a row, once more for quick reading.
ROW_DDL = "record_id string, table_name string, row_no int, parent_table string, parent_row int, path string, ordinal int, name string, cols map<string,string>"
_MAP = pa.map_(pa.string(), pa.string())
_TYPES = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), _MAP)
_ROW_NAMES = ["record_id", "table_name", "row_no", "parent_table", "parent_row", "path", "ordinal", "name", "cols"]


def _text(v: object) -> str:
    return _clean(v) if isinstance(v, str) else json.dumps(v)


def _put(cols: dict[str, str], path: str, value: str) -> None:
    """Adds a column; other values of the same path are numbered."""
    name, n = path, 1
    while cols.setdefault(name, value) != value:
        n += 1
        name = f"{path}#{n}"


def flatten(record: dict, tables: set[str] | None) -> list[tuple]:
    """Rows (table, row, parent table, parent row, path, ordinal, columns) of one record.

    Without ``tables`` members of arrays and objects inside one of their own type are rows.
    """
    rows: list[tuple] = []
    counts: dict[tuple[int, str], int] = {}

    def new(t: str, parent: tuple[str | None, int | None], path: str) -> tuple[dict, int]:
        at = counts.get((parent[1], path), 0)
        counts[parent[1], path] = at + 1
        cols: dict[str, str] = {}
        rows.append((t, len(rows), *parent, path, at, cols))
        return cols, len(rows) - 1

    top, _ = new(ROOT, (None, None), "")
    todo: list[tuple] = [(record, ROOT, 0, top, "")]
    while todo:
        x, t, row, cols, prefix = todo.pop()
        later = []
        for name, y in x.items():
            c = type_name(name)
            path = prefix + c
            for z in _items(y):
                if c in tables if tables is not None else isinstance(y, list) or isinstance(z, dict) and (c == t or c in prefix.split(".")):
                    own, no = new(c, (t, row), path)
                    if isinstance(z, dict):
                        later.append((z, c, no, own, ""))
                    else:
                        own[VALUE] = _text(z)
                elif isinstance(z, dict):
                    later.append((z, t, row, cols, path + "."))
                else:
                    _put(cols, _clean(path), _text(z))
        todo += reversed(later)
    return rows


def _row_batches(tables: set[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in _TYPES]
            for key, body in zip(b.column("key").to_pylist(), b.column("body").to_pylist()):
                v = read_record(body)
                for t, no, pt, pr, path, at, cols in flatten(v, tables) if v is not None else ():
                    for col, x in zip(out, (key, _clean(t), no, None if pt is None else _clean(pt), pr, _clean(path), at, cols.get("id", cols.get(VALUE)), list(cols.items()))):
                        col.append(x)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], names=_ROW_NAMES)
                    out = [[] for _ in _TYPES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES)], names=_ROW_NAMES)

    return run


def _bodies(df: DataFrame, key: str, body: str, loaded: str) -> DataFrame:
    cols = df.select(F.col(key).cast("string").alias("key"), F.col(loaded).alias("loaded"), F.col(body).cast("string").alias("body"))
    return latest(cols, "key", "loaded").select("key", "body")


def schema_graph(df: DataFrame, body: str = "body") -> DataFrame:
    """(parent, child, repeats, object, n) over all bodies; repeated rows count again."""
    found = df.select(F.col(body).cast("string").alias("body")).mapInArrow(_edges, "parent string, child string, repeats boolean, object boolean, n long")
    return found.groupBy("parent", "child", "repeats", "object").agg(F.sum("n").alias("n"))


def schema_of(df: DataFrame, body: str = "body", limit: int = EDGE_LIMIT) -> Schema | None:
    """The schema by its edges to objects and repeated members; none if there are more than ``limit`` of these."""
    edges = schema_graph(df, body)
    branching = F.max((F.col("repeats") | F.col("object")).cast("int")).over(Window.partitionBy("child")) == 1
    edges = edges.withColumn("_b", branching).where("_b").drop("_b").limit(limit + 1).collect()
    return None if len(edges) > limit else analyse([tuple(e) for e in edges])


@dataclass
class Relations:
    """Rows of all tables (ROW_DDL), and the types that have one (none: decided where they stand)."""

    rows: DataFrame
    tables: set[str] | None


def relations(df: DataFrame, key: str, body: str = "body", loaded: str = "loaded_at", limit: int = EDGE_LIMIT) -> Relations:
    """All tables of the records, staged; ``table_of`` gives one of them with its columns."""
    schema = schema_of(df, body, limit)
    tables = None if schema is None else set(schema.tables)
    return Relations(stage(_bodies(df, key, body, loaded).mapInArrow(_row_batches(tables), ROW_DDL), "relations"), tables)


def table_of(found: Relations, name: str, columns: list[str]) -> DataFrame:
    """One table: key (record_id, row_no), foreign key (parent_table, parent_row), ordinal and its columns as text.

    A type that is inlined comes out of the rows that hold it, whose number it has, and hangs on them.
    """
    keys = ["record_id", "row_no", "parent_table", "parent_row", "path", "ordinal"]
    own = found.rows.where(F.col("table_name") == name).select(*keys, *[F.element_at("cols", c).alias(c) for c in columns])
    if found.tables is None or name in found.tables:
        return own
    end = rf"^(?:.*\.)?{name}"
    rows = found.rows.withColumn("_at", F.explode(F.array_distinct(F.transform(F.filter(F.map_keys("cols"), lambda k: k.rlike(end + r"(\.|#|$)")), lambda k: F.regexp_extract(k, end, 0)))))
    held = [F.coalesce(F.element_at("cols", F.concat("_at", F.lit("." + c))), *([F.element_at("cols", F.col("_at"))] if c == VALUE else [])).alias(c) for c in columns]
    return own.unionByName(rows.select("record_id", "row_no", F.col("table_name").alias("parent_table"), F.col("row_no").alias("parent_row"), F.col("_at").alias("path"), F.lit(0).alias("ordinal"), *held))


def _digits(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*\d+(\.0+)?\s*$"), F.regexp_replace(F.regexp_extract(c, r"^\s*(\d+)", 1), r"^0+(?=\d)", ""))


#: What the types of the documentation records that others refer to are in a link (fixed values).
LINKS = {"fragment": "FRAGMENT", "sourceId": "SOURCE", "dependencyId": "DEPENDENCY"}


def _members(found: Relations) -> DataFrame:
    """(record_id, kind, name, up_row, up): each fragment, source id and dependency id, in a row of its own or inlined;
    ``up_row`` is the row that holds the fragment it stands in and ``up`` the column of its id there."""
    above = F.when(F.contains("path", F.lit(".")), F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)).otherwise("")
    up = F.when(above != "", F.concat(above, F.lit(".id"))).otherwise("id")
    inside = F.when(above != "", above.rlike(r"(^|\.)fragment$")).otherwise(F.col("parent_table") == "fragment")
    own = found.rows.where(F.col("table_name").isin(*LINKS)).select("record_id", F.col("table_name").alias("kind"), "name", F.when(inside, F.col("parent_row")).alias("up_row"), F.when(inside, up).alias("up"))
    inlined = [k for k in LINKS if found.tables is None or k not in found.tables]
    if not inlined:
        return own
    # a type without a table: columns of the row that holds it
    end = rf"^((?:.*\.)?)({'|'.join(inlined)})(\.id)?(#\d+)?$"
    rows = found.rows.withColumn("_k", F.explode(_keys(end)))
    at = F.regexp_extract("_k", end, 1)
    above = F.regexp_replace(at, r"\.$", "")
    inside = F.when(above != "", above.rlike(r"(^|\.)fragment$")).otherwise(F.col("table_name") == "fragment")
    return own.unionByName(rows.select("record_id", F.regexp_extract("_k", end, 2).alias("kind"), F.element_at("cols", F.col("_k")).alias("name"), F.when(inside, F.col("row_no")).alias("up_row"), F.when(inside, F.concat(at, F.lit("id"))).alias("up")))


def _keys(pattern: str) -> Column:
    return F.filter(F.map_keys("cols"), lambda k: k.rlike(pattern))


def _spots(found: Relations) -> DataFrame:
    """(record_id, name, start) of the sources of records."""
    pick = lambda pattern: F.explode(F.transform(_keys(pattern), lambda k: F.element_at("cols", k))).alias("start")
    own = found.rows.where(F.col("table_name") == "source").select("record_id", "name", pick(r"^occurrence\.startByte(#\d+)?$"))
    if found.tables is not None and "source" in found.tables:
        return own
    held = found.rows.withColumn("_k", F.explode(_keys(r"(^|\.)source\.id(#\d+)?$")))
    at = F.regexp_extract("_k", r"^(.*)id(#\d+)?$", 1)
    starts = F.filter(F.map_keys("cols"), lambda k: k.startswith(F.concat(at, F.lit("occurrence.startByte"))))
    return own.unionByName(held.select("record_id", F.element_at("cols", F.col("_k")).alias("name"), F.explode(F.transform(starts, lambda k: F.element_at("cols", k))).alias("start")))


def links(found: Relations) -> DataFrame:
    """(record_id, parent_id, link, child_id) of the documentation records: nested fragments, their source
    and dependency ids, and the start bytes of sources; distinct rows."""
    kind = F.create_map(*[F.lit(x) for kv in LINKS.items() for x in kv])
    hung = _members(found).select("record_id", F.element_at(kind, F.col("kind")).alias("link"), "name", "up_row", "up")
    holds = found.tables is not None and set(LINKS) <= found.tables  # then only fragments hold what is linked, by their own id
    holder = found.rows.where(F.col("table_name") == "fragment") if holds else found.rows
    holder = holder.select(F.col("record_id").alias("h_record"), F.col("row_no").alias("up_row"), *([F.col("name").alias("up_name")] if holds else ["cols"]))
    inner = hung.where("up_row is not null").join(holder, (F.col("record_id") == F.col("h_record")) & (hung["up_row"] == holder["up_row"]))
    inner = inner.select("record_id", (F.col("up_name") if holds else F.element_at("cols", F.col("up"))).alias("parent_id"), "link", F.col("name").alias("child_id"))
    outer = hung.where("up_row is null and link = 'FRAGMENT'").select("record_id", F.col("record_id").alias("parent_id"), "link", F.col("name").alias("child_id"))
    spots = _spots(found).select("record_id", F.col("name").alias("parent_id"), F.lit("OCCURRENCE").alias("link"), _digits(F.col("start")).alias("child_id"))
    return inner.unionByName(outer).unionByName(spots).where("parent_id is not null and child_id is not null").distinct()
