from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import hierarchy as H
from factloom.plans import catalog
from tests.conftest import DATA

DDL = "id string, parent string, loaded int, v int, up string, kind string, size int"


def build(spark, rows):
    df = spark.createDataFrame([(a, b, n, 7, "x", "y", 9) for n, (a, b) in enumerate(rows)], DDL)
    links = H.link(H.nodes(df, "K", "id", "parent", "loaded"))
    rings = H.separate(links)
    return rings, H.decompose(links, rings)


def plain(rows):
    """Cycles, depths, paths and sizes by walking."""
    par = {}
    for a, b in rows:
        if a:
            par[a] = b or None
    par = {a: b if b in par else None for a, b in par.items()}
    ring = {}
    for v in par:
        x, path = v, []
        while x is not None and x not in path:
            path.append(x)
            x = par[x]
        if x is not None:
            for y in path[path.index(x) :]:
                ring[y] = min(path[path.index(x) :])
    cut = {a: None if a in ring else b for a, b in par.items()}
    out = {}
    for v in cut:
        x, path = v, []
        while x is not None:
            path.append(x)
            x = cut[x]
        out[v] = path[::-1]
    return ring, out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_rings(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:03d}" for i in range(90)]
    rows = [(n, rnd.choice([None, "", "lost", *names[: i + 1], rnd.choice(names)])) for i, n in enumerate(names)]
    rows += [rows[3], rows[5], (None, "n001")]
    rings, full = build(spark, rows)
    ring, paths = plain(rows)
    assert {r["id"]: r["cycle_key"] for r in rings.collect()} == ring
    got = {r["node_id"]: r for r in H.report(full).collect()}
    assert {n: r["path"].split("/") for n, r in got.items()} == paths
    below = {n: sum(n in p for p in paths.values()) - 1 for n in paths}
    assert {n: r["n_descendants"] for n, r in got.items()} == below
    assert {n: r["depth"] for n, r in got.items()} == {n: len(p) - 1 for n, p in paths.items()}
    for n, r in got.items():  # descendants are one interval of places in the tree
        inside = {m for m, q in got.items() if q["root_id"] == r["root_id"] and r["tree_pos"] < q["tree_pos"] <= r["tree_pos"] + r["n_descendants"]}
        assert inside == {m for m, p in paths.items() if n in p and m != n}


def test_paths_and_descendants_over_blocks(spark):
    rows = [("r", None), *((f"c{i}", f"c{i - 1}" if i else "r") for i in range(30)), *((f"s{i}", f"c{i % 3}") for i in range(20)), ("x", "y"), ("y", "x"), ("z", "x")]
    _, full = build(spark, rows)
    ring, paths = plain(rows)
    ids = {r["v"]: r["id"] for r in full.collect()}
    for block in (1, 3, 1000):
        assert {ids[r["v"]]: r["path"].split("/") for r in H.paths(full, block).collect()} == paths
        got = sorted(tuple(r)[1:] for r in H.descendants(full, F.col("id") != "c4", block).collect())
        assert got == sorted((a, n, len(p) - 1 - i) for n, p in paths.items() for i, a in enumerate(p[:-1]) if a != "c4")


def test_hot_parents_are_spread(spark, monkeypatch):
    rows = [("hub", None), *((f"s{i}", "hub") for i in range(60)), *((f"t{i}", "s3") for i in range(40)), *((f"q{i}", f"q{(i + 1) % 5}") for i in range(5))]
    monkeypatch.setattr(H, "HOT_LEAST", 2)
    rings, full = build(spark, rows)
    ring, paths = plain(rows)
    assert {r["id"]: r["cycle_key"] for r in rings.collect()} == ring
    assert {r["node_id"]: r["path"].split("/") for r in H.report(full).collect()} == paths


def test_long_chain_and_wide_star(spark):
    rows = [("c0", None), *((f"c{i}", f"c{i - 1}") for i in range(1, 300)), *((f"s{i}", "c0") for i in range(300))]
    rings, full = build(spark, rows)
    assert rings.count() == 0
    got = {r["id"]: (r["depth"], r["size"]) for r in full.select("id", "depth", "size").collect()}
    assert got["c299"] == (299, 1) and got["c0"] == (0, 600) and got["s7"] == (1, 1)
    assert max(len(r["segments"]) for r in full.select("segments").collect()) <= 2


def test_spelling_of_parents(spark):
    rows = [("abc", None), ("d1", " \tPublication:ABC "), ("d2", "context:abc"), ("d3", "ABC"), ("self", "SELF")]
    rings, full = build(spark, rows)
    assert [(r["id"], r["cycle_key"]) for r in rings.collect()] == [("self", "self")]
    assert {r["id"]: r["depth"] for r in full.collect()} == {"abc": 0, "d1": 1, "d2": 1, "d3": 1, "self": 0}


def test_empty(spark):
    rings, full = build(spark, [])
    assert rings.count() == 0 and H.report(full).count() == 0


def test_every_record_gets_its_descendants(spark):
    queries = catalog.queries()
    below = {(r["record_kind"], r["node_id"]): r["n_descendants"] for r in queries["p3_hierarchy"](spark, DATA).collect()}
    got = queries["p3_all_descendants"](spark, DATA).collect()
    assert Counter((r["record_kind"], r["node_id"]) for r in got) == Counter({n: k for n, k in below.items() if k})
    assert len(got) == len({(r["record_kind"], r["node_id"], r["descendant_id"]) for r in got})
