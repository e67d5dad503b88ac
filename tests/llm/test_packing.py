from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from factloom.llm import packing as P


def expand(ranges):
    load, seen = {}, {}
    for s, first, n, container, per in ranges:
        for i in range(n):
            load[container + i // per] = load.get(container + i // per, 0) + s
            seen.setdefault(s, []).append(first + i)
    return load, seen


def best_fit_decreasing(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_full(seed):
    rnd = random.Random(seed)
    hist = {}
    for _ in range(rnd.choice([3, 200, 4000])):
        s = min(100, max(1, int(rnd.lognormvariate(3, 1))))
        hist[s] = hist.get(s, 0) + 1
    ranges, total = P.plan(hist, 100, groups=[1, 8, 16, 40, 64, 64][seed])
    load, seen = expand(ranges)
    assert {s: sorted(v) for s, v in seen.items()} == {s: list(range(n)) for s, n in hist.items()}
    assert set(load) == set(range(total)) and max(load.values()) <= 100
    if seed > 1:
        assert total <= best_fit_decreasing([s for s, n in hist.items() for _ in range(n)], 100) * 1.02 + 2


def test_knapsack_is_the_best():
    rnd = random.Random(1)
    for _ in range(30):
        sizes, values = np.array(rnd.sample(range(2, 15), 3)), np.array([rnd.random() for _ in range(3)])
        got, n = P.knapsack(sizes, values, 30)
        best = max(sum(a * v for a, v in zip(c, values)) for c in itertools.product(range(16), repeat=3) if sum(a * s for a, s in zip(c, sizes)) <= 30)
        assert got == pytest.approx(best) and (n * values).sum() == pytest.approx(best) and (n * sizes).sum() <= 30


def test_odd_histograms():
    assert P.plan({}, 10) == ([], 0) and P.plan({10: 3}, 10)[1] == 3 and P.plan({6: 5}, 10)[1] == 5 and P.plan({1: 25}, 10)[1] == 3 and P.plan({5: 4, 0: 9}, 10)[1] == 2


def test_table(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.choice([0, 1, 5, 40, 300]))), "x", 3) for i in range(120)] + [(500, None, "x", 1), (501, "   ", "x", 2), (None, "alpha", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string, number int")
    got = P.pack(df, capacity=64, groups=(8,)).collect()
    enc = P.encoder(P.TOKENIZER)
    for i, t, *_ in rows:
        if i is None:
            continue
        n = len(enc.encode_ordinary(t)) if t else 0
        mine = sorted((r["part"], r["start_token"], r["n_tokens"]) for r in got if r["doc_id"] == i)
        assert mine == [(p, p * 64, min(64, n - p * 64)) for p in range(max(1, -(-n // 64)))]
    load = {}
    for r in got:
        assert (r["container_id"] is None) == (r["n_tokens"] == 0)
        if r["n_tokens"]:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
    assert max(load.values()) <= 64 and len(load) <= best_fit_decreasing([r["n_tokens"] for r in got if r["n_tokens"]], 64) + 2
    assert P.pack(df.where("false"), capacity=64).count() == 0
    same = spark.createDataFrame([(7, "alpha beta")] * 3, "doc_id long, text string")
    assert P.pack(same, capacity=64).count() == 3


def test_ranges_by_join_are_the_same(spark, monkeypatch):
    sizes = spark.createDataFrame([(i, i % 23) for i in range(400)], "id long, n_tokens long")
    a = {tuple(r) for r in P.pack_sizes(sizes, 20, (4, 2)).collect()}
    monkeypatch.setattr(P, "PLAN_LIMIT", 0)
    assert {tuple(r) for r in P.pack_sizes(sizes, 20, (4, 2)).collect()} == a
