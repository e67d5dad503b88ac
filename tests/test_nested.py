from __future__ import annotations

import json

import pytest

from factloom.operators import nested as N

DDL = "record_id string, body string, loaded_at int, row_no int, name string, key string"


def table(spark, bodies):
    return spark.createDataFrame([(k, b if b is None or isinstance(b, str) else json.dumps(b), n, 1, "n", "k") for n, (k, b) in enumerate(bodies)], DDL)


FULL = {
    "kind": "F", "record": {"fragment": {"id": "f1", "sourceIds": ["s1", ["s2", None, [{"id": "s3", "role": "x"}]]], "dependency_ids": "d1", "fragments": [{"id": "f2", "text": "é", "fragments": {"id": "f3", "source_ids": None, "dependencyIds": []}}]}},
    "source": [{"id": "s1", "occurrence": {"startByte": "0012", "endByte": 20}}, {"id": "s2", "occurrence": None}, {"id": "s3", "occurrence": {"start_byte": 7.0}}],
}
LINKS = {
    ("r", "r", "FRAGMENT", "f1"), ("r", "f1", "FRAGMENT", "f2"), ("r", "f2", "FRAGMENT", "f3"), ("r", "f1", "SOURCE", "s1"), ("r", "f1", "SOURCE", "s2"), ("r", "f1", "SOURCE", "s3"),
    ("r", "f1", "DEPENDENCY", "d1"), ("r", "s1", "OCCURRENCE", "12"), ("r", "s3", "OCCURRENCE", "7"),
}


def links(spark, bodies, **kw):
    return {tuple(x) for x in N.links(N.relations(table(spark, bodies), "record_id", **kw)).collect()}


def test_links_of_a_record(spark):
    assert links(spark, [("r", FULL), ("many", {"record": {"fragment": [{"id": "g"}]}, "source": {"id": "q"}})]) == LINKS | {("many", "many", "FRAGMENT", "g")}


@pytest.mark.parametrize("limit", [1, 10_000])
def test_links_without_tables(spark, limit):
    """Types that never repeat are inlined, and with a schema too large to analyse nothing is; the links are the same."""
    one = {"record": {"fragment": {"id": "f", "sourceIds": "s", "dependencyIds": {"id": "d"}, "note": {"fragment": {"id": "no"}}}}, "source": {"id": "s", "occurrence": {"startByte": 3}}}
    assert links(spark, [("r", one)], limit=limit) >= {("r", "r", "FRAGMENT", "f"), ("r", "f", "SOURCE", "s"), ("r", "f", "DEPENDENCY", "d"), ("r", "s", "OCCURRENCE", "3")}
    plain = {"record": {"fragment": {"id": "f", "sourceIds": "s"}}, "source": {"id": "s"}}
    assert links(spark, [("r", plain)], limit=limit) == {("r", "r", "FRAGMENT", "f"), ("r", "f", "SOURCE", "s")}
    assert links(spark, [("r", FULL), ("q", FULL)], limit=limit) == LINKS | {("q", "q" if b == "r" else b, c, d) for _, b, c, d in LINKS}


def test_inlined_types_come_out_as_tables(spark):
    found = N.relations(table(spark, [("r", {"record": {"fragment": {"id": "f", "text": "x"}}}), ("q", {"record": {"fragment": {"id": "g"}}})]), "record_id")
    assert found.tables == {"root"}
    rows = N.table_of(found, "fragment", ["id", "text"])
    assert sorted((r["record_id"], r["parent_table"], r["path"], r["id"], r["text"]) for r in rows.collect()) == [("q", "root", "record.fragment", "g", None), ("r", "root", "record.fragment", "f", "x")]


def test_no_value_of_two_spellings_is_lost(spark):
    body = {"source": [{"id": "s", "occurrence": {"startByte": 1, "start_byte": 2, "endByte": 5, "end_byte": 5}}] * 2}
    assert links(spark, [("r", body)]) == {("r", "s", "OCCURRENCE", "1"), ("r", "s", "OCCURRENCE", "2")}
    assert N.flatten({"a_b": 1, "aB": 2, "a-b": 1, "ab": 3, "a b": 4}, {"root"})[0][-1] == {"aB": "1", "aB#2": "2", "ab": "3", "aB#3": "4"}


def test_unreadable_repeated_and_double_encoded(spark):
    text = json.dumps(FULL)
    cut = [("a", None), ("b", text[:50]), ("c", "[1, 2]"), ("d", "7"), (None, text), ("r", FULL), ("r", FULL), ("r", json.dumps(text))]
    assert links(spark, cut) == LINKS


def test_schema_decides_on_tables(spark):
    s = N.schema_of(table(spark, [("r", FULL), ("q", {"record": {"fragment": [{"id": "g"}]}})]))
    assert s.tables == {"root": "ROOT", "fragment": "RECURSIVE", "sourceId": "REPEATED", "source": "REPEATED"} and N.schema_of(table(spark, [("r", FULL)]), limit=2) is None
    wide = N.analyse([("root", "a", False, True, 1), ("root", "b", False, True, 1), ("a", "shared", False, True, 1), ("b", "shared", False, True, 1), ("a", "name", False, False, 1), ("b", "name", False, False, 1)])
    assert wide.tables == {"root": "ROOT", "shared": "SHARED"}


def test_rows_keep_parent_and_order(spark):
    rows = N.flatten({"x": [{"y": 1, "z": {"w": 2}}, {"y": 3}]}, {"root", "x"})
    assert rows == [("root", 0, None, None, "", 0, {}), ("x", 1, "root", 0, "x", 0, {"y": "1", "z.w": "2"}), ("x", 2, "root", 0, "x", 1, {"y": "3"})]


def test_deep_records(spark):
    deep = {"id": "f0"}
    for i in range(1, 300):
        deep = {"id": f"f{i}", "fragments": [deep]}
    got = links(spark, [("r", {"record": {"fragment": deep}})])
    assert len(got) == 300 and ("r", "f1", "FRAGMENT", "f0") in got


def test_odd_text(spark):
    odd = '{"record": {"fragment": {"id": "a\\ud800", "\\ud801s": [1], "big": ' + "9" * 400 + ', "sourceIds": "\\u0000"}}}'
    assert {x[3] for x in links(spark, [("r", odd)])} == {"a?", "\x00"}


def test_empty(spark):
    assert links(spark, []) == set()
