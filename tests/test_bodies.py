from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import dataflow as D
from factloom.operators import lattice
from factloom.operators import ledger as L
from factloom.operators import matching as M
from factloom.operators import windows as W
from factloom.sources import entries as E


def test_windows():
    text = "\n".join(f"line {i}" + (" needle" if i == 90 else "") for i in range(1, 101))
    w = lambda ranges, terms=(), **kw: W.windows(text, list(terms), ranges, whole=10, **kw)
    assert W.windows(text, [], []) == [(1, 100)]
    assert w([(50, 52)]) == [(42, 76)] and w([(20, 21), (30, 30)]) == [(12, 54)] and w([], ["needle"]) == [(82, 100)] and w([(500, 501)]) == [(1, 25)]
    assert w([(10, 10)], ["needle"]) == [(2, 34), (90, 90)] and w([(5, 5), (45, 45)], most=1) == [(1, 29)] and w([(5, 5), (60, 60)], budget=300) == [(1, 29)]
    assert W.windows("a\nb\n", [], []) == [(1, 2)] and W.windows("", [], [(1, 1)]) == [] and W.windows("a\nb\n", [], [(2, 2)], whole=1) == [(1, 2)]
    assert W.Lines("a\n\nb\n").size(1, 3) == 4 and len(W.Lines("\n")) == 1 and W.Lines("é\nb").size(1, 1) == 2
    assert w([(5, 5), (60, 60)], budget=len("\n".join(text.split("\n")[:29]))) == [(1, 29)] and w([(40, 60)], budget=3) == [(32, 84)]
    assert w([(10, 10)], ["needle", "line"], budget=10**6) == [(2, 34), (90, 90)]
    assert W.anchors("a\nb a\nc", ["a", "b", "c", "z"]) == [(2, ["a", "b"]), (3, ["c"])] and W.anchors("", ["a"]) == []


def test_windows_of_tables(spark):
    df = spark.createDataFrame([("k", "a\nNeedle\nb", [(2, 2)]), ("n", None, None), (None, "x", None), ("e", "", None)], "id string, text string, ranges array<struct<first:long,last:long>>")
    assert [tuple(r) for r in W.source_windows(df, "id", "text", "ranges", ["needle"]).where("id = 'k'").collect()] == [("k", 1, 3, "a\nNeedle\nb")]
    assert [tuple(r) for r in W.term_anchors(df, "id", "text", ["Needle"]).collect()] == [("k", 2, ["needle"])]


def test_arguments(spark):
    calls = spark.createDataFrame([("c1", "f", ["x", "y", "z"]), ("c2", "f", []), ("c3", "gone", ["x"])], "call string, target string, arguments array<string>")
    formals = spark.createDataFrame([("f", 0, "p"), ("f", 1, "q")], "target string, slot int, formal string")
    got = {(r["call"], r["slot"]): r["status"] for r in D.bind_arguments(calls, formals).collect()}
    assert got == {("c1", 0): "BOUND", ("c1", 1): "BOUND", ("c1", 2): "EXTRA_ARGUMENT", ("c2", 0): "MISSING_ARGUMENT", ("c2", 1): "MISSING_ARGUMENT", ("c3", 0): "TARGET_UNKNOWN"}


def test_calls_are_inlined():
    unknown = ("UNKNOWN", [], [])
    functions = {
        "main": {"nodes": {"n": ("NULL", [], []), "c": unknown, "result": ("COPY", ["c"], [])}, "parameters": [], "calls": {"c": ("same", ["n"])}},
        "same": {"nodes": {"p": ("INPUT", [], []), "result": ("COPY", ["p"], [])}, "parameters": ["p"], "calls": {}},
        "loop": {"nodes": {"c": unknown, "result": ("COPY", ["c"], [])}, "parameters": [], "calls": {"c": ("loop", [])}},
    }
    state, ok = lattice.solve(D.inline_calls(functions, "main"), "result")
    assert ok and state["result"] == lattice.NULL
    assert lattice.solve(D.inline_calls(functions, "loop"), "result")[0]["result"] == lattice.TOP
    assert lattice.solve(D.inline_calls(functions, "main", contexts=0), "result")[0]["result"] == lattice.TOP


def test_joined_paths(spark):
    rows = [("g", "p1", "x", "d1"), ("g", "p2", "x", "d1"), ("g", "p1", "y", "d2"), ("g", "p2", "z", "d3"), ("g", "p1", "z", "d4")]
    df = spark.createDataFrame(rows, "k string, path string, storage string, definition string").withColumn("guards", F.array("path"))
    assert {r["storage"]: r["kind"] for r in D.join_paths(df, ["k"]).collect()} == {"x": "SAME", "y": "CHOICE", "z": "CHOICE"}


def test_outline():
    df = pd.DataFrame([("o", "a", 0, 100), ("o", "b", 10, 40), ("o", "c", 10, 20), ("o", "d", 50, 60), ("o", "e", 200, 210)], columns=["owner", "id", "first", "last"])
    got = {r.id: (r.parent, r.depth, r.ordinal) for r in D.outline(df).itertuples()}
    assert got == {"a": (None, 0, 0), "b": ("a", 1, 0), "c": ("b", 2, 0), "d": ("a", 1, 1), "e": (None, 0, 1)}


def test_journal(spark):
    rnd = random.Random(3)

    def replay(records):
        here, problem = None, None
        for op, m in records:
            bad = ("ADDS_EXISTING_PACK" if here is not None else None) if op == "ADD" else "REMOVES_MISSING_PACK" if here is None else "REMOVES_DIFFERENT_PACK" if here != m else None
            if bad:
                return "CORRUPT", bad
            here = m if op == "ADD" else None
        return "PRESENT" if here else "ABSENT", None

    packs = {str(i): [(rnd.choice(["ADD", "REMOVE"]), rnd.choice("ab")) for _ in range(rnd.randint(1, 4))] for i in range(80)}
    df = spark.createDataFrame([(p, n, *r) for p, rs in packs.items() for n, r in enumerate(rs)], "pack string, seq int, op string, manifest string")
    assert {r["pack"]: (r["state"], r["problem"]) for r in L.replay(df, "pack", "seq").collect()} == {p: replay(rs) for p, rs in packs.items()}


def test_ledgers_and_packages(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "x")], "n int, a string, b string")
    kept = L.hashed(rows, ["n", "a", "b"])
    assert L.broken_hashes(kept, ["n", "a", "b"]).count() == 0 and L.broken_hashes(kept.withColumn("a", F.lit("z")), ["n", "a", "b"]).count() == 2
    folder = str(tmp_path / "pack")
    L.export_package(rows, folder, "n")
    assert L.import_package(spark, folder, "n").count() == 2
    rows.where("n = 1").write.mode("append").partitionBy("n").parquet(f"{folder}/parts")
    with pytest.raises(Exception, match="differs from its manifest"):
        L.import_package(spark, folder, "n").collect()
    with pytest.raises(Exception, match="differs from its digest"):
        L.verified_scopes(spark.createDataFrame([("s", "c", "sha256:0")], "s string, c string, d string"), "s", "c", "d").collect()


def test_entry_points(spark):
    rows = [
        ("A", None, "RestController", None, None), ("A", None, "RequestMapping", "/api/*", None), ("A", "get", "GetMapping", "x", None), ("A", "any", "RequestMapping", "/y", None), ("A", "put", "RequestMapping", "${p}", "put"),
        ("B", "get", "GetMapping", "x", None), ("A", "hear", "KafkaListener", "topic", None), ("A", "tick", "Scheduled", "${cron}", None),
    ]
    df = spark.createDataFrame(rows, "class string, member string, name string, path string, http_method string")
    assert {(r["member"], r["http_method"], r["path"], r["gap"]) for r in E.jvm_routes(df).collect()} == {("get", "GET", "/api/x", None), ("any", None, "/api/y", "HTTP_METHOD_UNSPECIFIED"), ("put", "PUT", None, "PATH_NOT_STATIC")}
    assert {(r["kind"], r["subject"], r["gap"]) for r in E.listeners(df).collect()} == {("KAFKA_LISTENER", "topic", None), ("SCHEDULE", None, "VALUE_NOT_STATIC")}
    meta = spark.createDataFrame([("RestController", "Controller"), ("Controller", "RestController")], "name string, base string")
    assert E.composed(df, meta).where("name = 'Controller'").count() == 1
    clr = spark.createDataFrame([("HomeController", None, "ApiController", None, None), ("HomeController", None, "Route", "api/[controller]", None), ("HomeController", "Get", "HttpGet", "[action]/{id}", None), ("HomeController", "Put", "HttpPut", "~/root", None), ("HomeController", "Bad", "HttpPost", "[what]", None)], df.schema)
    assert {(r["member"], r["path"], r["gap"]) for r in E.clr_routes(clr).collect()} == {("Get", "/api/Home/Get/{id}", None), ("Put", "/root", None), ("Bad", None, "TEMPLATE_NOT_STATIC")}


def test_selectors(spark):
    ends = spark.createDataFrame([("e1", True, "a"), ("e2", False, "a"), ("e3", True, "z"), ("e4", True, "b"), ("e5", True, "c"), ("e6", True, "d")], "endpoint string, selected boolean, k string")
    obs = spark.createDataFrame([("a", True, False), ("b", True, True), ("c", False, False), ("d", True, False), ("d", True, False)], "k string, has_source boolean, syntax boolean")
    assert {r["endpoint"]: r["status"] for r in M.selector_status(ends, obs, ["k"]).collect()} == {"e1": "RESOLVED", "e2": "INCOMPLETE", "e3": "MISSING", "e4": "SOURCE_MATCH", "e5": "SOURCE_UNAVAILABLE", "e6": "AMBIGUOUS"}
