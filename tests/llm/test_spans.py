from __future__ import annotations

import random

import pytest

from factloom.llm import spans as S

DDL = "id string, text string, h long, k1 int, marks string, s int, wh int"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1, 2, "m", 3, 4) for a, b in rows], DDL)


def plain(rows, least):
    texts = {i: t for i, t in rows if i is not None and t is not None}
    owners = {}
    for i, t in texts.items():
        for p in range(len(t) - least + 1):
            owners.setdefault(t[p : p + least], set()).add(i)
    out = set()
    for i, t in texts.items():
        hit = [False] * len(t)
        for p in range(len(t) - least + 1):
            if len(owners[t[p : p + least]]) > 1:
                hit[p : p + least] = [True] * least
        p = 0
        while p < len(t):
            if hit[p]:
                e = p
                while e < len(t) and hit[e]:
                    e += 1
                out.add((i, p, e))
                p = e
            else:
                p += 1
    return out


def run(spark, rows, least, limit=S.PAIR_LIMIT, bits=64):
    return {tuple(r) for r in S.shared_spans(frame(spark, rows), min_chars=least, pair_limit=limit, hash_bits=bits).collect()}


@pytest.mark.parametrize("limit, bits", [(1, 64), (3, 64), (1000, 64), (1, 2), (2, 7)])
def test_random_texts(spark, limit, bits):
    rnd = random.Random(limit)
    stock = ["".join(rnd.choice("ab é𝄞") for _ in range(60)) for _ in range(6)]
    rows = []
    for n in range(40):
        t = "".join(rnd.choice([rnd.choice(stock)[rnd.randint(0, 30) :], "".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 40)))]) for _ in range(rnd.randint(0, 5)))
        rows.append((f"d{n}", t))
    rows += [rows[0], rows[1], (None, stock[0]), ("null", None), ("empty", ""), ("run1", "x" * 90), ("run2", "x" * 33), ("own", "pq" * 50)]
    assert run(spark, rows, 20, limit, bits) == plain(rows, 20)


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    rnd = random.Random(9)
    a = "".join(rnd.choice("abcdefgh") for _ in range(5000))
    b = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    rows = [("a", a), ("b", b[:700] + a[1000:4000] + b[700:])]
    monkeypatch.setattr(S, "CHUNK", 400)
    p = S.code_points(a)
    whole = set(S.winnow(S.gram_hashes(p, 46), 55).tolist())
    parts = set()
    for group, points in S._segments([a], 46 + 55 - 2):
        grams, at = S.gram_hashes(points, 46), 0
        for _, start, n in group:
            parts |= {x + start for x in S.winnow(grams[at : at + n - 45], 55).tolist()}
            at += n
    assert whole == parts
    assert run(spark, rows, 100) == plain(rows, 100)


def test_hot_stretch_in_a_third_of_all_rows(spark):
    rnd = random.Random(3)
    head = "".join(rnd.choice("abcdefghij ") for _ in range(260))
    rows = [(f"h{n}", "".join(rnd.choice("klmno") for _ in range(rnd.randint(0, 90))) + head[rnd.choice([0, 0, 40]) :] + "".join(rnd.choice("pqrst") for _ in range(50))) for n in range(60)]
    rows += [(f"r{n}", "".join(rnd.choice("uvwxyz") for _ in range(300))) for n in range(120)]
    assert run(spark, rows, 200) == plain(rows, 200)


def test_empty_and_summary(spark):
    assert run(spark, [], 200) == set()
    t = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    got = S.shared_summary(frame(spark, [("a", t + "!" * 100), ("b", t), ("b", t)])).orderBy("source_id").collect()
    assert [(r["source_id"], r["n_chars"], r["shared_chars"], r["runs"], r["shared_share"]) for r in got] == [("a", 400, 300, 1, 0.75), ("b", 300, 300, 1, 1.0)]
