from __future__ import annotations

import random
import time

import numpy as np

from factloom.llm import leaks as L

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("tor", "vex", "zan", "pel") for c in ("a", "im", "ow", "et")]
INSTRUCTION = "Answer the question using nothing but the passage below and say so when it is silent."


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def setup():
    rnd = random.Random(7)
    passages = {i: " ".join(sentence(rnd, 14) for _ in range(3)) for i in range(8)}
    items = [(i, (INSTRUCTION + " " if i % 2 else "") + p + " Why would anyone open it?", "suite") for i, p in passages.items()]
    return rnd, passages, items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in docs], "doc_id long, text string, lang string, item_id int, words int")
    q = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]) for r in L.leaks(d, q, **kw).collect()}


def test_leaks_and_near_misses(spark):
    rnd, p, items = setup()
    words = lambda i: p[i].split()
    noise = lambda: sentence(rnd, 30)
    swapped = words(1)
    for k in range(4, len(swapped), 6):
        swapped[k] = "changed"
    parts = p[3].split(". ")
    docs = [
        (1, noise() + " " + p[0] + " " + noise()),  # whole
        (2, noise() + " ".join(swapped) + noise()),  # words replaced
        (3, noise() + "\n> **" + "_ _".join(w.upper() for w in words(2)[5:25]) + "**\n" + noise()),  # a part, as markup in capitals
        (4, noise() + ". ".join(reversed(parts)) + noise()),  # reordered sentences
        (5, noise() + " ".join(words(4)[3:12]) + noise()),  # a quote of nine words
        (6, INSTRUCTION + " " + noise()),  # only the instruction
        (7, " and then ".join(words(5)[::5]) + noise()),  # the same words, not in a row
        (8, "Why would anyone open it? " + noise()),
        (9, None), (10, ""), (11, p[6] + p[7]), (12, " ".join(words(6)[:20]) * 3), (None, p[0]),
        (13, "".join(c + "​" if c == "a" else c for c in p[0])),
    ]
    want = {(1, 0), (2, 1), (3, 2), (4, 3), (11, 6), (11, 7), (12, 6), (13, 0)}
    assert run(spark, docs, items) == want
    assert run(spark, docs + docs[:2], [*items, items[0], (None, p[0], ""), (50, None, ""), (51, "Why?", "")], block_items=3) == want


def test_tiling_is_greedy_and_whole():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randint(0, 3) for _ in range(rnd.randint(0, 14))] for _ in range(2))
        tiles = L.tile(a, b, least=2, start=5)
        used_a, used_b = set(), set()
        for i, j, n in tiles:
            assert a[i : i + n] == b[j : j + n] and n >= 2 and not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
            used_a |= set(range(i, i + n))
            used_b |= set(range(j, j + n))
        for i in range(len(a) - 1):  # nothing of two words is left to match
            for j in range(len(b) - 1):
                assert a[i : i + 2] != b[j : j + 2] or used_a & {i, i + 1} or used_b & {j, j + 1}
        if tiles:
            longest = max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, 15) if i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n]), default=0)
            assert max(n for *_, n in tiles) == longest


def test_words_in_order():
    assert L.in_order([(0, 0, 4), (7, 4, 4)]) == 4 and L.in_order([(0, 0, 4), (4, 8, 4)]) == 8 and L.in_order([(0, 0, 4), (4, 9, 4)]) == 4
    assert L.words_of("A<b class='x'>b</b>\\nC_d É") == ["a", "b", "c", "d", "é"]
    assert L.in_order([(0, 0, 5), (6, 6, 5), (20, 11, 3)]) == 10 and L.in_order([(6, 0, 5), (0, 6, 5)]) == 5 and L.in_order([]) == 0


def test_empty(spark):
    _, p, items = setup()
    assert run(spark, [], items) == set() and run(spark, [(1, p[0])], []) == set()


def test_rolling_hashes_are_those_of_the_runs():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 3, 400)
    for s in range(1, 40):
        h = L.rolled(x, s)
        seen = {}
        assert len(h) == 400 - s + 1
        for i, v in enumerate(h.tolist()):
            assert seen.setdefault(v, tuple(x[i : i + s])) == tuple(x[i : i + s])
        assert len(seen) == len({tuple(x[i : i + s]) for i in range(len(h))})


def test_repeated_words_take_no_time():
    began = time.process_time()
    assert sum(n for _, _, n in L.tile([1] * 100, [1] * 200_000)) == 100
    assert L.in_order([(3 * k, 3 * k, 3) for k in range(100_000)]) == 300_000
    assert time.process_time() - began < 10
    assert L.words_of("a <" + "b" * 5000 + "> c") == ["a", "c"]
