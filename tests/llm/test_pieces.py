from __future__ import annotations

import random
import re

from factloom.llm import pieces as P

DDL = "id string, text string, piece int, cut string, startByte int"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1, "x", 2) for a, b in rows], DDL)


def check(b, limit, overlap):
    parts = P.split(b, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(b) and all(0 < e - s <= limit for s, e, _ in parts)
    for (s, e, kind), (s2, e2, _) in zip(parts, parts[1:]):
        assert s < s2 <= e < e2 and e - s2 <= overlap
        natural = b[e - 1 : e] in (b" ", b"\t", b"\r", b"\n") or b[e : e + 1] in (b" ", b"\t", b"\r", b"\n")
        assert (kind == "forced") != natural or kind != "forced"
        assert not (b[e - 1 : e] == b"\r" and b[e : e + 1] == b"\n")
    for s, e, _ in parts:
        b[s:e].decode()
    longest = max((len(x) for x in re.split(rb"[ \t\r\n]", b)), default=0)
    assert any(k == "forced" for *_, k in parts) == (longest > limit)


def test_random_texts():
    rnd = random.Random(4)
    for _ in range(300):
        t = "".join(rnd.choice(["a" * rnd.randint(1, 70), " ", "\n", "\r\n", "\n\n", "é日𝄞" * rnd.randint(1, 9), ". ", "\t"]) for _ in range(rnd.randint(5, 60)))
        b = t.encode()
        for limit, overlap in ((64, 8), (50, 0), (40, 39)):
            if len(b) > limit:
                check(b, limit, overlap)


def test_strong_boundaries_win():
    b = ("word " * 900 + "\n\n" + "word " * 900).encode()
    assert P.split(b)[0][1:] == (4502, "blank") and P.split(b)[1][0] >= 4502 - 256


def test_table(spark):
    big = "line of words here\n" * 600
    rows = [("a", big), ("a", big), ("b", "é" * 5000), ("c", "short"), ("d", None), (None, big), ("e", "")]
    got = P.split_oversized(frame(spark, rows)).orderBy("source_id", "piece").collect()
    assert {r["source_id"] for r in got} == {"a", "b"} and len([r for r in got if r["source_id"] == "a"]) == 2
    for r in got:
        raw = (big if r["source_id"] == "a" else "é" * 5000).encode()
        assert raw[r["startByte"] : r["endByte"]].decode() == r["text"]
    assert [r["nextCursor"] is None for r in got] == [False, True, False, True]
    assert int(got[0]["nextCursor"].split(":")[1]) == got[1]["startByte"]
    assert {tuple(r) for r in P.boundary_kind(frame(spark, rows)).collect()} == {("a", "natural"), ("b", "forced")}
    assert P.split_oversized(frame(spark, [])).count() == 0 and P.boundary_kind(frame(spark, [])).count() == 0
    edge = [("x", "a" * 8192 + " "), ("y", "a" * 8193 + " "), ("z", "a" * 8000 + "\n" + "b" * 8000)]
    assert {tuple(r) for r in P.boundary_kind(frame(spark, edge)).collect()} == {("x", "natural"), ("y", "forced"), ("z", "natural")}
