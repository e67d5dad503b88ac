from __future__ import annotations

import datetime
import itertools
import json
import random

import pytest

from factloom.operators import drift as D

DDL = "manifest_id string, repository string, written_at timestamp, loaded_at timestamp, body string, key string, seq int, block int"
START = datetime.datetime(2030, 1, 1)


def table(spark, histories):
    rows = []
    for repo, bodies in histories.items():
        for i, b in enumerate(bodies):
            at = START + datetime.timedelta(hours=i)
            rows.append((f"{repo}-{i:04d}", repo, at, at, b if isinstance(b, str) or b is None else json.dumps(b), "k", 1, 2))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows + rows[:3], DDL)


def found(spark, histories, **kw):
    return sorted(tuple(r) for r in D.changes(table(spark, histories), **kw).collect())


def test_kinds_of_change(spark):
    base = {"id": "a" * 64, "n": 1, "lang": "en"}
    bodies = [dict(base, n=i) for i in range(4)]
    bodies += [dict(base, n=str(i)) for i in range(4, 8)]  # retyped at 4
    bodies += [{"id": "b" * 64, "n": str(i), "language": "en"} for i in range(8, 12)]  # renamed at 8
    bodies += [{"id": "b" * 64, "n": str(i), "language": "en", "tags": ["x"]} for i in range(12, 15)]  # added at 12
    bodies += [{"id": "b" * 64, "n": str(i), "tags": ["x"]} for i in range(15, 18)]  # removed at 15
    assert found(spark, {"r": bodies}) == [("r-0004", "RETYPED", "n", "n"), ("r-0008", "RENAMED", "lang", "language"), ("r-0012", "ADDED", "", "tags"), ("r-0015", "REMOVED", "language", "")]


def test_what_is_no_change(spark):
    b = {"id": "x", "a": 1}
    bodies = [b, b, {"id": "x"}, b, dict(b, stray=1), b, {"id": None, "a": None}, b, '{"id": "x", "a"', None, "[1]", b, {"id": 5, "a": 1}, b]
    assert found(spark, {"r": bodies, "one": [b], "two": [{"a": 1}, {"b": [2]}]}) == []


def test_blocks_do_not_matter(spark):
    rnd = random.Random(5)
    histories = {}
    for r in range(3):
        state, bodies = {"a": 1, "b": "x", "c": None}, []
        for _ in range(150):
            if rnd.random() < 0.06:
                f = rnd.choice("abcd")
                state = {k: v for k, v in state.items() if k != f} if f in state and rnd.random() < 0.5 else dict(state, **{f: rnd.choice([1, "x", True, [1], {"q": 1}, None])})
            bodies.append({k: None if rnd.random() < 0.1 else v for k, v in state.items() if rnd.random() > 0.03})
        histories[f"r{r}"] = bodies
    assert found(spark, histories, block=7) == found(spark, histories, block=48) == found(spark, histories, block=4096) != []


def plain(bodies, sample=D.SAMPLE):
    """Changes of one history, by looking at it as a whole: (row, kind, before, after)."""
    out, gone, come, cut = [], {}, {}, {}
    for f in sorted({f for b in bodies for f in b}):
        runs = [(there, [i for i, _ in g]) for there, g in itertools.groupby(enumerate(bodies), lambda x: f in x[1])]
        absent = {i for there, g in runs if not there and len(g) > 1 for i in g}
        cut[f] = absent
        last = None
        for there, g in runs:
            if len(g) > 1:
                if last is not None and there != last:
                    (come if there else gone).setdefault(g[0], []).append(f)
                last = there
        told = [(i, None if i in absent else D.kind_of(b[f])) for i, b in enumerate(bodies) if i in absent or b.get(f) is not None]
        last = None
        for kind, g in itertools.groupby(told, lambda x: x[1]):
            g = list(g)
            if len(g) > 1:
                if kind is not None and last not in (None, kind):
                    out.append((g[0][0], "RETYPED", f, f))
                last = kind
    near = lambda f, rows: [(D.kind_of(bodies[i][f]), D.sketch(bodies[i][f])) for i in itertools.takewhile(lambda i: i not in cut[f], rows) if f in bodies[i]]
    for i in sorted(set(gone) | set(come)):
        olds = [(f, near(f, range(i - 1, -1, -1))[:sample][::-1]) for f in gone.get(i, [])]
        out += [(i, *c) for c in D.match(olds, [(f, near(f, range(i, len(bodies)))[:sample]) for f in come.get(i, [])])]
    return out


def random_history(rnd, n, nulls, lost, change):
    state, bodies = {"a": 1, "b": "x", "c": None}, []
    for _ in range(n):
        if rnd.random() < change:
            f, g = rnd.choice("abcde"), rnd.choice("abcde")
            if f in state and g not in state and rnd.random() < 0.5:
                state[g] = state.pop(f)
            else:
                state = {k: v for k, v in state.items() if k != f} if f in state and rnd.random() < 0.5 else dict(state, **{f: rnd.choice([1, "x", True, [1], {"q": 1}, None])})
        bodies.append({k: None if rnd.random() < nulls else v for k, v in state.items() if rnd.random() > lost})
    return bodies


def folded(bodies, size):
    fold = D.Fold(D.SAMPLE)
    rows = [json.loads(json.dumps(b)) for b in bodies]
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        fold.add(*D.summarise(part, [str(at + i) for i in range(len(part))], D.SAMPLE))
    fold.end()
    return sorted((int(k), *c) for k, *c in fold.out if c[0] != "FIELD")


@pytest.mark.parametrize("seed", range(150))
def test_fold_is_the_plain_result_for_every_block(seed):
    rnd = random.Random(seed)
    bodies = random_history(rnd, rnd.choice([1, 2, 5, 40, 90]), rnd.choice([0, 0.1, 0.6]), rnd.choice([0, 0.05, 0.4]), rnd.choice([0.02, 0.1, 0.4]))
    want = sorted(plain(bodies))
    for size in (1, 2, 3, 5, 16, 1024):
        assert folded(bodies, size) == want, size


def test_long_nulls_across_an_edge(spark):
    bodies = [{"f": "x"}] * 44 + [{"f": 1}] + [{"f": None}] * 31 + [{"f": 2}] * 124
    assert found(spark, {"m": bodies}, block=48) == found(spark, {"m": bodies}, block=1024) == [("m-0044", "RETYPED", "f", "f")]


def test_what_comes_back_is_a_new_field(spark):
    bodies = [{"a": 1, "z": 1}] * 3 + [{"z": 1}] * 60 + [{"a": "x", "z": 1}] * 3
    want = [("r-0003", "REMOVED", "a", ""), ("r-0063", "ADDED", "", "a")]
    assert found(spark, {"r": bodies}, block=48) == want == found(spark, {"r": bodies})


def test_a_kind_is_remembered_over_long_gaps(spark):
    bodies = [{"a": 1}] * 3 + [{"a": None}] * 200 + [{"a": "x"}] * 3
    assert found(spark, {"r": bodies}, block=48) == [("r-0203", "RETYPED", "a", "a")]


def test_assignment_is_the_best_one():
    rnd = random.Random(3)
    for rows, cols in itertools.product(range(1, 5), repeat=2):
        w = [[rnd.choice([0, 0, 1, 3, 7]) * 1.0 for _ in range(cols)] for _ in range(rows)]
        picked = D.assign(w)
        assert len({j for j in picked if j >= 0}) == sum(j >= 0 for j in picked)
        got = sum(w[i][j] for i, j in enumerate(picked) if j >= 0)
        best = max(sum(w[i][j] for i, j in enumerate(p) if j < cols) for p in itertools.permutations(range(max(rows, cols)), rows))
        assert got == pytest.approx(best)


def test_unified_table(spark):
    bodies = [{"id": "i", "lang": "en", "released": True}] * 3 + [{"id": "i", "docLang": "en", "released": "false", "x": [1]}] * 3 + ["{"]
    rows = {r["manifest_id"]: r for r in D.unify(table(spark, {"r": bodies}), ["id", "lang", "released"]).collect()}
    assert rows["r-0004"]["lang"] == "en" and rows["r-0004"]["released"] == "false" and json.loads(rows["r-0004"]["rest"]) == {"x": "[1]"}
    assert not rows["r-0006"]["readable"] and rows["r-0006"]["id"] is None and len(rows) == 7


def test_no_value_is_lost_where_histories_differ(spark):
    one = [{"a": "v", "z": 1}] * 3 + [{"c": "v", "z": 1}] * 3
    two = [{"b": "w", "z": 1}] * 3 + [{"c": "w", "z": 1}] * 3
    three = [{"a": "p", "b": "q", "z": 1}] * 3
    four = [{"a": "p", "c": "r"}] * 2 + [{"a": "p", "c": None}] * 2
    five = [{"b": "only"}]
    got = {r["manifest_id"]: (r["c"], json.loads(r["rest"] or "{}")) for r in D.unify(table(spark, {"1": one, "2": two, "3": three, "4": four, "5": five}), ["c", "z"], block=2).collect()}
    assert got["1-0000"] == ("v", {}) and got["2-0000"] == ("w", {}) and got["2-0004"] == ("w", {})
    assert got["3-0001"] == (None, {"a": "p", "b": "q"})  # two fields with the same claim
    assert got["4-0000"] == ("r", {"a": "p"}) and got["5-0000"] == ("only", {})


def test_long_values_are_sketched_whole():
    long = "word " * 200
    assert D.sketch(long + "1") != D.sketch(long + "x-1") and len(D.sketch(long)[0]) < 200
    many = {f"k-{'x' * i}": i for i in range(3, 400)}
    assert len(D.sketch(many)) <= D.SKETCH and D.sketch(list("a1-b2")) == D.sketch(list("2b-1a"))


def test_odd_values(spark):
    b = {"id": "\ud800", "\udc00": 1, "n": 10**400, "f": 1.5}
    c = dict(b, n=1e300, g=[{}, [], None, 10**400])
    assert found(spark, {"r": [b, b, c, c]}) == [("r-0002", "ADDED", "", "g")]


def test_empty(spark):
    assert found(spark, {}) == [] and D.unify(table(spark, {}), ["id"]).count() == 0
