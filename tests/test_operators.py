"""Operators against plain versions on small inputs."""

from __future__ import annotations

import json
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from factloom.functions import json as J
from factloom.functions import text as T
from factloom.operators import aggregates as A
from factloom.operators import diffs as D
from factloom.operators import graph as G
from factloom.operators import lattice as L
from factloom.operators import ordering as O
from factloom.operators import paging as P
from factloom.operators import postings as X
from factloom.operators import validation as V
from factloom.sources import ddl, openapi, render, syntax


def value(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).collect()[0]["x"]


def test_terms(spark):
    got = value(spark, T.normal_terms("v"), v=["HTTPServer2Go é ж x_1", "a", None, "b" * 300, "日本"])
    assert got == sorted({"httpserver2go", "é", "ж", "x_1", "b" * 43, "日本"})
    assert value(spark, T.identifier_parts("v"), v=["HTTPServer2Go snake_case ABc"]) == ["bc", "case", "go", "http", "server2", "snake"]
    assert value(spark, T.query_alias("v"), v="no_such") == "nosuch" and value(spark, T.query_alias("v"), v="plain") is None


def test_paths(spark):
    key = lambda p: value(spark, T.path_key("p"), p=p)
    assert key("/a/{id}/b") == "/a/{}/b" and key("a/b") is None and key("/a/*") is None and key("/{a-b}") is None and key("/") == "/" and key("/{}") is None
    join = lambda a, b: value(spark, T.join_path("a", "b"), a=a, b=b)
    assert join("", "") == "" and join("a/", "/b") == "/a/b" and join("/a/*", "b") == "/a/b" and join("/a/*", "") is None and join("${x}", "b") is None and join("", "b") == "/b" and join("a", "") == "/a"
    tmpl = lambda a, b: value(spark, T.join_template("a", "b"), a=a, b=b)
    assert tmpl("api", "~/x/") == "x" and tmpl("/api/", "get") == "api/get" and tmpl("api", None) == "api" and tmpl(None, "x") == "x" and tmpl(None, None) is None and tmpl("api", "") == "api"
    fill = lambda t, area: value(spark, T.fill_template("t", F.lit("Home$1"), F.lit("Get"), "area"), t=t, area=area)
    assert fill("[Area]/[controller]/[[x]]/[ACTION]", "a") == "/a/Home$1/[x]/Get" and fill("[area]", None) is None and fill("[what]", "a") is None and fill("x]", "a") is None


def test_bytes(spark):
    for text in ("aé日𝄞b", "abc", "𝄞𝄞"):
        raw = text.encode()
        for n in range(4, 12):
            want = raw[:n].decode(errors="ignore")
            assert value(spark, T.byte_prefix("t", n), t=text) == want
    assert value(spark, T.line_at("t", "o"), t="a\nb\nc", o=2) == 2 and value(spark, T.line_at("t", "o"), t="a\nb", o=99) == 2 and value(spark, T.line_at("t", "o"), t="a", o=-1) == 1
    assert value(spark, T.find_bytes("t", F.lit("b")), t="éb") == 2 and value(spark, T.find_bytes("t", F.lit("z")), t="éb") is None


def test_links_and_descriptors(spark):
    link = lambda p, rev, s, e: value(spark, T.permalink(F.lit(p), F.lit("https://h.org/a/b/"), F.lit(rev), F.lit("x/y.py"), "s", "e"), s=s, e=e)
    assert link("github", "a" * 40, 1, 2) == f"https://h.org/a/b/blob/{'a' * 40}/x/y.py#L1-L2" and link("gitlab", "a" * 64, 3, 3).endswith("#L3-3") and link("github", "main", 1, 2) is None and link("github", "a" * 40, 0, 2) is None and link("other", "a" * 40, 1, 2) is None
    assert value(spark, T.web_base("u"), u="https://u@h.org/a") is None and value(spark, T.web_base("u"), u="http://h.org/a") is None
    assert value(spark, T.descriptor_parameters("d"), d="(I[Ljava/lang/String;[[J)V") == ["int", "java.lang.String[]", "long[][]"] and value(spark, T.descriptor_parameters("d"), d="(IQ)V") == []
    assert value(spark, T.step_class("k", "t"), k="CALL", t="A#saveAll(int)") == "W" and value(spark, T.step_class("k", "t"), k="LOOP", t="x") == "D" and value(spark, T.access_class("k"), k="island") == "R"


def test_json(spark):
    assert value(spark, J.canonical_json("j"), j='{"b":[2,{"z":1,"a":null}],"a":"é"}') == '{"a":"é","b":[2,{"a":null,"z":1}]}' and value(spark, J.canonical_json("j"), j='{"a":1,"a":2}') is None
    body = {"symbolIdentity": "Queue.Report", "x": ["report queue"], "schema": "queue", "path": "/queue"}
    assert value(spark, J.weighted_score(F.col("j"), ["queue", "report"]), j=json.dumps(body)) == 32 + 2 + 0 + 8
    assert J.strings_in({"a": ["x", {"b": "sha256:" + "0" * 64}], "c": "y"}) == ["x", "y"] and J.without_source({"file": 1, "a": [{"start": 2, "k": 3}]}) == {"a": [{"k": 3}]}


def test_fair_turns():
    assert X.fair([["a", "b", "c"], ["a", "d"], []], 3) == ["a", "b", "d"] and X.fair([], 5) == [] and X.fair([["a"], ["a"]], 5) == ["a"]


def test_numbers_within_keys(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(500)]
    got = O.number_within(spark.createDataFrame(rows, "k string, i int").repartition(6), ["k"], ["i"]).collect()
    want = {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, []).append(i)
    assert {(r["k"], r["i"]): r["seq"] for r in got} == {(k, i): n for k, v in want.items() for n, i in enumerate(v)}


def test_staged_tables_are_released(spark):
    from factloom import runtime

    runtime.release(spark)
    kept = runtime.stage(spark.range(3).toDF("a"))
    assert kept.count() == 3 and runtime.release(spark) == 1 and runtime.release(spark) == 0


def test_first_per_key(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("aaab"), i) for i in range(300)]
    got = {(r["k"], r["i"]): r["place"] for r in O.first_per_key(spark.createDataFrame(rows, "k string, i int"), ["k"], ["i"], 7, "place", salt=4).collect()}
    want = {(k, i): n + 1 for k in "ab" for n, i in enumerate(sorted(i for x, i in rows if x == k)[:7])}
    assert got == want


def test_meet_in_order(spark):
    def fold(vs):
        cov, scopes, bounds = vs[0][0], set(vs[0][1]), set(vs[0][2])
        for c, s, b in vs[1:]:
            if cov == "COMPLETE" and c == "COMPLETE" and scopes == set(s):
                continue
            if "UNKNOWN" in (cov, c):
                cov, scopes, bounds = "UNKNOWN", set(), set()
                continue
            if cov == c == "COMPLETE":
                bounds.add("SCOPE_MISMATCH")
            cov, scopes, bounds = "PARTIAL", scopes | set(s), bounds | set(b)
        return cov, sorted(scopes), sorted(bounds)

    rnd = random.Random(4)
    groups = {k: [rnd.choice([("COMPLETE", ["a"], []), ("COMPLETE", ["b"], []), ("PARTIAL", ["c"], ["x"]), ("PARTIAL", ["a"], []), *([("UNKNOWN", [], [])] * (k % 5 == 0))]) for _ in range(rnd.randint(1, 4))] for k in range(60)}
    rows = [(k, n, "SUPPORTED", c, s, b, "VERIFIED", []) for k, vs in groups.items() for n, (c, s, b) in enumerate(vs)]
    df = spark.createDataFrame(rows, "k int, seq int, support string, coverage string, scopes array<string>, boundaries array<string>, certainty string, checks array<string>")
    got = {r["k"]: (r["coverage"], list(r["scopes"]), list(r["boundaries"])) for r in A.meet(df, "k", "seq").collect()}
    assert got == {k: fold(vs) for k, vs in groups.items()}


def test_pages(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 60, 5, 6, 3, 1])], "g string, o int, s int")
    one = [(r["o"], r["state"]) for r in P.page(df, "g", "o", "s", item_bytes=50, page_bytes=12).orderBy("o").collect()]
    assert one == [(0, "SENT"), (1, "OMITTED"), (2, "SENT")]
    assert [r["page"] for r in P.pages(df, "g", "o", "s", item_bytes=50, page_bytes=12).orderBy("o").collect()] == [0, 0, 0, 1, 1, 1]
    assert sorted(r["o"] for r in P.skip_fit(df, "g", ["o"], "s", 12).collect()) == [0, 2, 5]
    parts = P.byte_ranges(spark.createDataFrame([("k", "aé日𝄞" * 5), ("e", "")], "k string, t string"), "k", "t", 8).orderBy("part").collect()
    raw = ("aé日𝄞" * 5).encode()
    assert "".join(raw[r["start_byte"] : r["end_byte"]].decode() for r in parts) == raw.decode() and max(r["end_byte"] - r["start_byte"] for r in parts) <= 8


def test_hunks():
    rnd = random.Random(8)
    for _ in range(60):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        end = rnd.choice(["", "\n", "\r\n"])
        old, new = "\n".join(a), "\r\n".join(b) + end
        for cells in (10**6, 0):
            got, how = D.line_hunks(old, new, cells)
            a2, b2 = re.findall("[^\n]*\n|[^\n]+", old), re.findall("[^\n]*\n|[^\n]+", new)
            out, at = [], 0
            for ol, on, nl, nn in got:
                out += a2[at : ol - 1] + b2[nl - 1 : nl - 1 + nn]
                at = ol - 1 + on
            assert out + a2[at:] == b2 and how == ("LINES" if cells else "COARSE_REPLACEMENT")
    assert D.line_hunks("a\r\nb\r\n", "a\nb\n") == ([(1, 2, 1, 2)], "LINES") and D.line_hunks("a\u2028b", "a\u2028c") == ([(1, 1, 1, 1)], "LINES")
    assert D.line_hunks("x\n" * 9 + "a\n", "x\n" * 9) == ([(10, 1, 10, 0)], "LINES") and D.line_hunks(None, "a") == ([(1, 0, 1, 1)], "LINES")
    many = "".join(f"{i}\n" for i in range(200))
    assert D.line_hunks(many, many.replace("5\n", "x\n"), hunks=3) == ([(6, 191, 6, 191)], "COARSE_REPLACEMENT")
    assert D.line_hunks("\n" * 300_000, "\n" * 300_001) == ([(1, 300_000, 1, 300_001)], "COARSE_REPLACEMENT")


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "x"), ("q", None)], "source string, target string")
    assert {r["node"]: r["depth"] for r in G.bfs(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r["node"]: r["component"] for r in G.components_mutual(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "x": "x", "q": "q"}
    assert {r["node"]: r["level"] for r in G.topological_levels(edges).collect()} == {"a": None, "b": None, "c": None, "d": None, "e": None, "x": None, "q": 0}
    masks = G.outcome_masks(edges, spark.createDataFrame([("d", 0), ("e", 2)], "node string, bit int"))
    assert {r["node"]: r["mask"] for r in masks.collect()} == {"a": 5, "b": 5, "c": 5, "d": 5, "e": 4}
    back = G.back_edges(pd.DataFrame({"graph": "g", "source": list("abc"), "target": list("bca"), "ordinal": range(3)}))
    assert back.values.tolist() == [["g", "c", "a", 2]]


def test_local_order():
    nodes = pd.DataFrame({"node": range(5), "role": ["ENTRY", "STEP", "STEP", "STEP", "DEAD"]})
    edges = pd.DataFrame([(0, 1, "F"), (0, 2, "F"), (1, 3, "F"), (2, 3, "F"), (3, 4, "F")], columns=["source", "target", "kind"])
    assert G.local_order(nodes, edges, 1, 3) == (True, False, None) and G.local_order(nodes, edges, 0, 3) == (True, True, None) and G.local_order(nodes, edges, 3, 1)[:2] == (False, False) and G.local_order(nodes, edges, 1, 4)[2]


def test_nullness():
    eq = {"in": ("INPUT", [], []), "n": ("NULL", [], []), "v": ("NON_NULL", [], []), "j": ("JOIN", ["n", "v"], []), "c": ("COALESCE", ["n", "v"], []), "k": ("COPY", ["j"], []), "l1": ("COPY", ["l2"], []), "l2": ("COPY", ["l1"], []), "cc": ("COALESCE", ["v", "in"], [])}
    got = {t: L.solve(eq, t)[0].get(t) for t in eq}
    assert got == {"in": 3, "n": 1, "v": 2, "j": 3, "c": 2, "k": 3, "l1": 3, "l2": 3, "cc": 2}
    assert L.solve(eq, "k", transfers=1) == (dict.fromkeys(["k", "j", "n", "v"], 3), False) and L.solve(eq, "gone") == ({}, True)


def test_branches(spark):
    def check(kinds):
        stack = []
        for k in kinds:
            if k == "IF":
                stack.append(False)
            elif k == "ELSE":
                if not stack or stack[-1]:
                    return "ELSE_WITHOUT_OPEN_IF_OR_DUPLICATE_ELSE"
                stack[-1] = True
            elif k == "END":
                if not stack:
                    return "END_WITHOUT_OPEN_IF"
                stack.pop()
        return "IF_WITHOUT_END" if stack else None

    rnd = random.Random(6)
    lists = {str(n): [rnd.choice(["IF", "ELSE", "END", "X"]) for _ in range(rnd.randint(0, 7))] for n in range(120)}
    df = spark.createDataFrame([(o, i, k, "c") for o, ks in lists.items() for i, k in enumerate(ks)], "owner string, ordinal int, kind string, text string")
    assert {r["owner"]: r["problem"] for r in V.branches(df, "owner").collect()} == {o: p for o, ks in lists.items() if (p := check(ks))}


def test_versions(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, v string")
    u = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 1)], "k int, v string, n int")
    gone = spark.createDataFrame([(3,), (1,)], "k int")
    assert sorted((r["k"], r["v"] or "") for r in D.merge(t, u, gone, ["k"], "n").collect()) == [(1, "y"), (2, ""), (4, "d"), (9, "z")]
    d = D.snapshot_diff(t, spark.createDataFrame([(2, None), (3, "C"), (5, "e")], "k int, v string"), ["k"], "v")
    assert {r["k"]: r["status"] for r in d.collect()} == {1: "DELETED", 2: "UNCHANGED", 3: "MODIFIED", 4: "DELETED", 5: "ADDED"}
    removed = D.remove_exact(t.select("k"), spark.createDataFrame([(1,)], "k int"), ["k"])
    assert sorted(r["k"] for r in removed.collect()) == [2, 3, 4]
    import pytest

    with pytest.raises(Exception, match="not there"):
        D.remove_exact(t.select("k"), spark.createDataFrame([(77,)], "k int"), ["k"]).collect()


def test_ddl():
    rows = ddl.read('CREATE TABLE IF NOT EXISTS a.b (id BIGINT, "N x" TEXT DEFAULT \'a,b\', PRIMARY KEY (id)); -- no\nALTER TABLE t ADD COLUMN c INT; SELECT 1 FROM x JOIN y ON 1=1; CREATE TABLE z (q INT')
    assert rows == [("TABLE", "a.b", None, None), ("COLUMN", "a.b", "id", "BIGINT"), ("COLUMN", "a.b", "N x", "TEXT"), ("CONSTRAINT", "a.b", None, "PRIMARY KEY"), ("ADD_COLUMN", "t", "c", "INT"), ("USE", "x", None, None), ("USE", "y", None, None), ("TABLE", "z", None, None), ("GAP", "z", None, "UNCLOSED_LIST")]


def test_openapi(spark):
    doc = {"paths": {"/a/{id}": {"parameters": [{"name": "id", "in": "path"}, {"name": "q", "in": "query"}], "get": {"operationId": "g", "parameters": [{"name": "q", "in": "query"}]}, "x-own": {}}}}
    rows = openapi.operations(spark.createDataFrame([("f", json.dumps(doc)), ("bad", "{"), ("none", None)], "file string, text string"), "file", "text").collect()
    assert [(r["method"], r["path_key"], r["operation_id"], list(r["parameters"])) for r in rows] == [("GET", "/a/{}", "g", ["query:q", "path:id"])]


def test_trees_and_diagrams(spark):
    steps = [("END", ""), ("IF", "a\n b"), ("ACTION", "x"), ("ELSE", ""), ("RETURN", "1"), ("END", ""), ("GAP", "why")]
    df = spark.createDataFrame([("o", i, k, t) for i, (k, t) in enumerate(steps)], "owner string, ordinal int, kind string, label string")
    assert render.flow_tree(df, "owner").collect()[0]["tree"].split("\n") == ["[D] if (a b) then", "  x", "else", "  return 1", "... (not established: why)"]
    nodes = spark.createDataFrame([("a", "<A>")], "id string, label string")
    edges = spark.createDataFrame([("a", "a", "l", "UNKNOWN")], "source string, target string, label string, authority string")
    assert [r["line"] for r in render.mermaid(nodes, edges).orderBy("line_no").collect()] == ["flowchart LR", '  a["&lt;A&gt;"]', '  a -.->|"l"| a']


def test_syntax():
    assert syntax.facts("x.py", "def f(a):\n    return g(a)\n") == [("DECLARATION", "f", 1), ("CALL", "g", 2)] and syntax.facts("x.bin", "") == [("BOUNDARY", "LANGUAGE_NOT_READ", 1)]


def test_files(spark, tmp_path):
    from factloom.sources import files

    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"one")
    (tmp_path / "in" / "sub" / "b.md").write_bytes(b"two")
    rows = files.scan(spark, str(tmp_path / "in"))
    assert {(r["path"], r["size"]) for r in rows.select("path", "size").collect()} == {("a.txt", 3), ("sub/b.md", 3)}
    files.materialize(rows, str(tmp_path / "out"))
    assert (tmp_path / "out" / "sub" / "b.md").read_bytes() == b"two"
    assert {r["path"] for r in files.scan(spark, str(tmp_path / "in"), glob="*.md").collect()} == {"sub/b.md"}
    t = spark.createDataFrame([("k", "abab ééab")], "id string, t string")
    assert [(r["byte_start"], r["byte_end"]) for r in files.locate(t, "id", "t", "ab", 5).orderBy("byte_start").collect()] == [(0, 2), (2, 4), (9, 11)] and files.locate(t, "id", "t", "ab", 2).count() == 0


def test_joins_of_hot_keys(spark):
    from factloom.operators.ordering import join_counted, join_hot

    many = spark.range(300).selectExpr("cast(if(id % 3 = 0, 7, id) as string) as k", "id as v", "id % 2 as w")
    few = many.groupBy("k").count().where("k <> '8'").withColumnRenamed("count", "n").withColumn("x", F.concat("k", F.lit("!")))
    want = sorted(tuple(r) for r in many.join(few, "k").select("k", "v", "x", "n").collect())
    for least in (1, 50, 10_000):
        got = join_counted(many, few, ["k"], "n", by=["v"], least=least).select("k", "v", "x", "n")
        assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in join_hot(many, few, ["k"]).select("k", "v", "x", "n").collect()) == want
    assert join_hot(many, few, ["k"], "left").count() == 300 and join_hot(many, few, ["k"], "left_anti").count() == 1
    assert join_counted(many, few.where("false"), ["k"], "n").count() == 0


def test_pages_over_blocks(spark):
    from factloom.operators import paging as G

    rnd = random.Random(4)
    rows = [(g, i, rnd.choice([0, 1, 3, 8, 20, 90])) for g, n in (("a", 83), ("b", 1), (None, 9), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, s int")

    def plain(sizes, limit=5, item=50, room=30):
        page, taken, used, out = 0, 0, 0, []
        for s in sizes:
            if taken == limit or (s <= item and used + s > room and taken):
                page, taken, used = page + 1, 0, 0
            taken += 1
            used += s if s <= item else 0
            out.append((page, "SENT" if s <= item else "OMITTED"))
        return out

    want = sorted((str(g), o, *x) for g in {r[0] for r in rows} for (_, o, _), x in zip([r for r in rows if r[0] == g], plain([r[2] for r in rows if r[0] == g])))
    for block in (5, 7, 4096):
        assert sorted((str(r["g"]), *tuple(r)[1:]) for r in G.pages(df, "g", "o", "s", 5, 50, 30, block).collect()) == want


def test_skip_fit_over_rounds(spark):
    from factloom.operators import paging as G

    rnd = random.Random(6)
    rows = [(g, i, rnd.choice([None, 0, 1, 3, 8, 20, 90])) for g, n in (("a", 83), ("b", 1), (None, 9), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, s int")
    want = []
    for g in {r[0] for r in rows}:
        room = 60
        for r in rows:
            if r[0] == g and r[2] is not None and r[2] <= room:
                room -= r[2]
                want.append(r)
    for at_once in (1, 3, 8192):
        assert sorted(map(repr, map(tuple, G.skip_fit(df, "g", ["o"], "s", 60, at_once).collect()))) == sorted(map(repr, want))
    assert G.skip_fit(df.where("false"), "g", ["o"], "s", 60).count() == 0 and G.pages(df.where("false"), "g", "o", "s").count() == 0


def test_contracts_in_json_and_yaml(spark):
    from factloom.sources import openapi as O

    docs = [
        ("a/o.yaml", "openapi: 3.0.3\npaths:\n  /x/{id}:\n    parameters: [{$ref: '#/components/parameters/id'}]\n    post:\n      requestBody: {$ref: '#/components/schemas/A'}\n    get: {}\ncomponents:\n  parameters: {id: {name: id, in: path}}\n  schemas:\n    A: {properties: {b: {$ref: '../b.json#/B'}}}\n"),
        ("b.json", '{"B": {"deep": [{"$ref": "#/C"}, {"$ref": "a/o.yaml#/components/schemas/A"}]}, "C": {"$ref": "#/none"}}'),
        ("list", "[1]"), ("bad", "{"), ("none", None), (None, "openapi: 3\n"),
    ]
    df = spark.createDataFrame(docs, "file string, text string")
    assert {r["file"]: r["status"] for r in O.documents(df, "file", "text").collect() if r["file"]} == {"a/o.yaml": "DECLARED_OPENAPI", "b.json": "REGISTERED_REFERENCE_DOCUMENT", "list": "INVALID_CONTRACT_JSON_YAML", "bad": "INVALID_CONTRACT_JSON_YAML", "none": "CONTRACT_SOURCE_UNAVAILABLE"}
    assert sorted((r["method"], r["path_key"], r["parameters"]) for r in O.operations(df, "file", "text").collect()) == [("GET", "/x/{}", ["path:id"]), ("POST", "/x/{}", ["path:id"])]
    got = {(r["method"], r["reference"], r["status"]) for r in O.references(df, "file", "text").collect()}
    want = {("a/o.yaml#/components/schemas/A", "RESOLVED"), ("b.json#/B", "RESOLVED"), ("b.json#/C", "RESOLVED"), ("b.json#/none", "MISSING")}
    assert got == {("POST", *x) for x in want}
    assert {r["status"] for r in O.references(df, "file", "text", depth=0).collect()} == {"RESOLVED", "BEYOND_DEPTH"}
    assert O.references(df.where("false"), "file", "text").count() == 0


def test_a_written_index_is_pruned(spark, tmp_path):
    from factloom.operators import postings as P

    facts = spark.createDataFrame([("l", f"f{i}", [f"term{i % 40} other", "queue"]) for i in range(200)], "lane string, fact_key string, texts array<string>")
    index = P.postings(facts)
    P.write_index(index, f"file://{tmp_path}/index")
    read = P.read_index(spark, f"file://{tmp_path}/index")
    asked = P.term_table(spark, ["term7", "queue", "gone"])
    found = P.lookup(read, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert "PushedFilters: [" in plan and "In(term" in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, P.lookup(index, asked).collect())) and found.count() == 205
    assert [r["term"] for r in P.unmatched(read, asked).collect()] == ["gone"]
    assert P.left_out(facts, limit=6).where("payload = 0").count() == 200


def test_rounds_delete_their_predecessors(spark):
    import os

    from factloom import runtime

    one = runtime.stage(spark.range(3).toDF("i"), "one")
    two = runtime.restage(one.selectExpr("i + 1 as i"), one, "two")
    assert not os.path.exists(one.staged_path.removeprefix("file://")) and [r["i"] for r in two.orderBy("i").collect()] == [1, 2, 3]
    assert runtime.restage(two.select("i").where("i > 1"), two.select("i"), "three").count() == 2 and os.path.exists(two.staged_path.removeprefix("file://"))
