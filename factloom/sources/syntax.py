"""Declarations and calls in source text of several languages, by its lexical form only.

What a compiler would have to resolve is left open: calls carry the name that
is written, never a target.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DECLARES = {
    "java": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)+(?:class|interface|enum|record)?\s*[\w<>\[\], ]*?\b(\w+)\s*[({]",
    "kt": r"^\s*(?:(?:public|private|internal|protected|override|suspend|inline|data|sealed)\s+)*(?:fun|class|interface|object)\s+(?:<[^>]*>\s*)?(\w+)",
    "py": r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)",
    "ts": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|enum|type|const)\s+(\w+)",
    "rs": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|mod)\s+(\w+)",
    "cs": r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|async)\s+)+[\w<>\[\], ]*?\b(\w+)\s*[({]",
    "sql": r"^\s*(?:CREATE\s+(?:TABLE|VIEW|FUNCTION)\s+(?:IF\s+NOT\s+EXISTS\s+)?)(\w+)",
}
_DECL = {k: re.compile(v, re.M) for k, v in _DECLARES.items()}
_DECL["js"] = _DECL["ts"]
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_NO_CALL = frozenset("if for while switch catch return def class function fn with when assert raise throw new require in not and or elif".split())


def facts(file: str, text: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of DECLARATION, CALL and BOUNDARY facts."""
    ext = file.rsplit(".", 1)[-1].lower()
    if ext not in _DECL:
        return [("BOUNDARY", "LANGUAGE_NOT_READ", 1)]
    starts = [m.end() for m in re.finditer("\n", text)]
    import bisect

    line = lambda at: bisect.bisect_right(starts, at) + 1
    declared = {m.start(1): m.group(1) for m in _DECL[ext].finditer(text)}
    out = [("DECLARATION", n, line(at)) for at, n in declared.items()]
    out += [("CALL", m.group(1), line(m.start(1))) for m in _CALL.finditer(text) if m.start(1) not in declared and m.group(1) not in _NO_CALL]
    return out


def symbols(texts: DataFrame, key: str, file: str, text: str) -> DataFrame:
    """(key, kind, name, line) of the facts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *r) for k, f, t in zip(*(b.column(c).to_pylist() for c in ("k", "f", "t"))) for r in facts(f, t)]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["k", "kind", "name", "line"])

    rows = texts.select(F.col(key).cast("string").alias("k"), F.col(file).alias("f"), F.col(text).alias("t")).where("f is not null and t is not null")
    return rows.mapInArrow(run, "k string, kind string, name string, line long").withColumnRenamed("k", key)
