"""Tables and columns that SQL text declares.  Text is cut into tokens and never executed; what can't be read is a gap row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\w+|[^\s\w]", re.S)
_TABLE_RULES = ("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT", "EXCLUDE", "LIKE")


def tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith(("--", "/*"))]


def _name(ts: list[str], at: int) -> tuple[str, int]:
    parts = []
    while at < len(ts):
        parts.append(ts[at].strip('"'))
        if at + 1 < len(ts) and ts[at + 1] == ".":
            at += 2
            continue
        return ".".join(parts), at + 1
    return ".".join(parts), at


def read(sql: str) -> list[tuple[str, str, str | None, str | None]]:
    """(kind, table, column, type) of TABLE, COLUMN, ADD_COLUMN, CONSTRAINT, USE and GAP rows, in order."""
    ts = tokens(sql)
    up = [t.upper() for t in ts]
    out: list[tuple[str, str, str | None, str | None]] = []
    i = 0
    while i < len(ts):
        if up[i] == "CREATE" and "TABLE" in up[i + 1 : i + 5]:
            at = up.index("TABLE", i) + 1
            if up[at : at + 3] == ["IF", "NOT", "EXISTS"]:
                at += 3
            table, at = _name(ts, at)
            out.append(("TABLE", table, None, None))
            if at < len(ts) and ts[at] == "(":
                depth, start, at = 1, at + 1, at + 1
                while at < len(ts) and depth:
                    depth += {"(": 1, ")": -1}.get(ts[at], 0)
                    if (ts[at] == "," and depth == 1) or not depth:
                        item = ts[start:at]
                        if item and item[0].upper() in _TABLE_RULES:
                            out.append(("CONSTRAINT", table, None, " ".join(item[:2]).upper()))
                        elif len(item) > 1:
                            out.append(("COLUMN", table, item[0].strip('"'), item[1].upper()))
                        start = at + 1
                    at += 1
                if depth:
                    out.append(("GAP", table, None, "UNCLOSED_LIST"))
            i = at
        elif up[i : i + 2] == ["ALTER", "TABLE"]:
            table, at = _name(ts, i + 2)
            if up[at : at + 2] == ["ADD", "COLUMN"] and at + 3 < len(ts):
                out.append(("ADD_COLUMN", table, ts[at + 2].strip('"'), up[at + 3]))
                at += 4
            else:
                out.append(("GAP", table, None, "ALTER_NOT_READ"))
            i = at
        elif up[i] in ("FROM", "JOIN", "INTO", "UPDATE") and i + 1 < len(ts) and re.match(r"[\w\"]", ts[i + 1]):
            table, i = _name(ts, i + 1)
            out.append(("USE", table, None, None))
        else:
            i += 1
    return out


def statements(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, table_name, column_name, type) of the declarations of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, n, *r) for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()) for n, r in enumerate(read(t))]
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), *[pa.string()] * 4))], names=["k", "pos", "kind", "table_name", "column_name", "type"])

    rows = texts.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return rows.mapInArrow(run, "k string, pos long, kind string, table_name string, column_name string, type string").withColumnRenamed("k", key)
