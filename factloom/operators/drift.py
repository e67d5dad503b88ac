"""Schemas that drift between the documents of a history.

1. The bodies are range partitioned by history and order and cut into blocks of
   consecutive bodies.  A block is profiled into one row: for each field where
   it is there and where not, the runs of its JSON kinds, and sketches of the
   values next to where it comes and goes.
2. The blocks of a history are folded in order.  The fold joins runs across
   block edges, so where the edges lie has no influence on the result, and
   holds one state per field that is there, never bodies.
3. A state lasts if two readable bodies in succession show it; for kinds nulls
   and single absences are passed over, and what was lastingly absent comes
   back as a new field.  Fields that lastingly go and fields that lastingly
   come at one body are matched as a bipartite graph weighted by likeness of
   sketches and names; matched ones are renames.
4. ``unify`` puts matched fields into one column, history by history.

A sketch covers a whole value: the form of a string (by digest beyond FORM
characters) and, for arrays and objects, the SKETCH least hashes of all distinct
element or member forms.  Likeness compares the ``sample`` values on either side
of a change.

Defined results: null keys, unreadable and non-object bodies are left out of
the history; of repeated keys the row loaded last counts; nulls count as
present but tell no kind; the first body is no change; an empty table gives
empty results; further columns are ignored.
"""

from __future__ import annotations

import json
import pickle
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ordering import join_hot, latest
from factloom.runtime import stage

BLOCK, BLOCK_CHARS, SAMPLE = 1024, 1 << 24, 8
FORM, SKETCH = 128, 16
ALIKE = 0.55


def kind_of(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", dict: "object", list: "array"}[type(v)]


_HEX, _RUN = re.compile(r"[0-9a-f]{12,}"), re.compile(r"[^\W\d_]+|\d+")


def shape_of(s: str) -> str:
    """The form of a string: runs of hex digits, letters and digits by kind and coarse length."""
    out, at = [], 0
    for m in _HEX.finditer(s):
        out += [s[at : m.start()], f"\x00{len(m.group())}\x01"]
        at = m.end()
    out.append(s[at:])
    run = lambda m: "9" if m.group()[0].isdigit() else f"a{len(m.group())}" if len(m.group()) < 4 else "a+"
    form = "".join(x if x[:1] == "\x00" else _RUN.sub(run, x) for x in out)
    return form if len(form) <= FORM else f"{form[:FORM]}#{zlib.crc32(form.encode('utf-8', 'surrogatepass')):08x}"


def _least(tokens: set[str]) -> list[str]:
    """The SKETCH tokens of least hash, a uniform sample of all distinct ones."""
    if len(tokens) <= SKETCH:
        return sorted(tokens)
    return sorted(sorted(tokens, key=lambda t: (zlib.crc32(t.encode("utf-8", "surrogatepass")), t))[:SKETCH])


def sketch(v: object) -> list[str]:
    """Distinct tokens that say what a value looks like."""
    if isinstance(v, bool) or v is None:
        return []
    if isinstance(v, (int, float)):
        return [repr(float(max(-(10**300), min(10**300, v)))), "int" if isinstance(v, int) else "float"]
    if isinstance(v, str):
        return ["s:" + shape_of(v)]
    if isinstance(v, list):
        return _least({"e:" + (shape_of(x) if isinstance(x, str) else kind_of(x)) for x in v})
    return _least({f"m:{shape_of(k)}={shape_of(x) if isinstance(x, str) else kind_of(x)}" for k, x in v.items()})


def _refuse(x: str) -> None:
    raise ValueError(x)


def read_object(body: str | None) -> dict | None:
    try:
        v = json.loads(body or "", parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def likeness(old: list[tuple[str, list[str]]], new: list[tuple[str, list[str]]]) -> float:
    """Likeness of two samples of (kind, sketch); ``old`` ends where ``new`` begins."""
    old, new = [x for x in old if x[0] != "null"], [x for x in new if x[0] != "null"]
    if not old or not new or old[-1][0] != new[0][0]:
        return 0.0
    kind = new[0][0]
    old, new = [s for k, s in old if k == kind], [s for k, s in new if k == kind]
    if kind == "boolean":
        return 0.8
    if kind == "number":
        a, b = float(old[-1][0]), float(new[0][0])
        whole = len({s[1] for s in old + new}) == 1
        return 0.5 * whole + 0.5 * max(0.0, 1 - abs(a - b) / (1 + max(abs(a), abs(b))))
    p, q = Counter(t for s in old for t in s), Counter(t for s in new for t in s)
    if not p or not q:
        return 0.6 if not p and not q else 0.3
    n, m = sum(p.values()), sum(q.values())
    return sum(min(p[t] / n, q[t] / m) for t in p)


def name_likeness(a: str, b: str) -> float:
    norm = lambda s: re.sub(r"[\W_]+", "", s).lower()
    return SequenceMatcher(None, norm(a), norm(b)).ratio()


def assign(weights: list[list[float]]) -> list[int]:
    """Maximum weight bipartite matching: for each row its column, or -1 (shortest augmenting paths with potentials)."""
    rows, cols = len(weights), len(weights[0]) if weights else 0
    n = max(rows, cols)
    cost = [[-(weights[i][j] if i < rows and j < cols else 0.0) for j in range(n)] for i in range(n)]
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, seen = [float("inf")] * (n + 1), [False] * (n + 1)
        while owner[j0]:
            seen[j0], best, j1 = True, float("inf"), 0
            for j in range(1, n + 1):
                if not seen[j]:
                    c = cost[owner[j0] - 1][j - 1] - u[owner[j0]] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < best:
                        best, j1 = least[j], j
            for j in range(n + 1):
                if seen[j]:
                    u[owner[j]] += best
                    v[j] -= best
                else:
                    least[j] -= best
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [-1] * rows
    for j in range(1, n + 1):
        i = owner[j] - 1
        if i < rows and j - 1 < cols and weights[i][j - 1] > 0:
            out[i] = j - 1
    return out


# Blocks: what stands in a block, field by field

#: (row, key) where something begins.
_At = tuple[int, str]


def _kind_runs(shown: list[tuple[int, str]], keys: list[str]) -> list[list]:
    """[kind, length, where] of the runs of kinds of (row, kind); a single other kind within a lasting one is passed over."""
    out: list[list] = []
    for i, k in shown:
        if k == "null":
            continue
        if out and out[-1][0] == k:
            out[-1][1] += 1
        elif len(out) > 1 and out[-1][1] == 1 and out[-2][0] == k and out[-2][1] > 1:
            out.pop()
            out[-1][1] += 1
        else:
            out.append([k, 1, (i, keys[i])])
    return out


def field_runs(shown: list[tuple[int, str]], n: int) -> list[tuple[bool, int, int, list[tuple[int, str]]]]:
    """(there, first row, rows, what it shows) of the runs of a field in ``n`` rows.

    A single absence within a lasting presence is passed over, and a single presence between lasting absences: in
    whatever the neighbouring blocks hold, neither can be or bring about a change.
    """
    raw: list[tuple[bool, int, int, list[tuple[int, str]]]] = []
    at = 0
    for i, k in shown:
        if i > at or not raw:
            if i > at:
                raw.append((False, at, i - at, []))
            raw.append((True, i, 1, [(i, k)]))
        else:
            raw[-1][3].append((i, k))
            raw[-1] = (True, raw[-1][1], raw[-1][2] + 1, raw[-1][3])
        at = i + 1
    if at < n:
        raw.append((False, at, n - at, []))
    out: list[tuple[bool, int, int, list[tuple[int, str]]]] = []
    for r in raw:
        out.append(r)
        while len(out) > 2 and out[-2][2] == 1 and out[-3][2] > 1 and (out[-1][0] or out[-1][2] > 1):
            left, _, right = out[-3:]
            out[-3:] = [(left[0], left[1], left[2] + right[2], left[3] + right[3])]
    return out


def summarise(bodies: list[dict], keys: list[str], sample: int) -> tuple:
    """(rows, first key, {field: runs}); a run is (there, rows, where, kind runs, first sketches, last sketches)."""
    shown: dict[str, list[tuple[int, str]]] = {}
    for i, b in enumerate(bodies):
        for f, x in b.items():
            shown.setdefault(f, []).append((i, kind_of(x)))
    out = {}
    for f, rows in shown.items():
        runs = []
        for there, at, n, seen in field_runs(rows, len(bodies)):
            values = lambda part: [(k, sketch(bodies[i][f])) for i, k in part]  # noqa: B023, E731
            runs.append((there, n, (at, keys[at]), _kind_runs(seen, keys), values(seen[:sample]), values(seen[-sample:]) if len(seen) > sample else None))
        if runs[0][0] or len(runs) > 1:
            out[f] = runs
    return len(bodies), keys[0], out


SUMMARY = pa.schema([("history", pa.string()), ("at", pa.timestamp("us", "UTC")), ("key", pa.string()), ("summary", pa.binary())])


def _summary_batches(block: int, sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bodies, keys, chars = None, [], [], 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal bodies, keys, chars
            if bodies:
                out.append((*first, pickle.dumps(summarise(bodies, keys, sample))))
            bodies, keys, chars = [], [], 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SUMMARY.types)], schema=SUMMARY)

        for b in batches:
            for h, at, key, body in zip(b.column("history").to_pylist(), b.column("at"), b.column("key").to_pylist(), b.column("body").to_pylist()):
                v = read_object(body)
                if v is None:
                    continue
                if bodies and (h != first[0] or len(bodies) >= block or chars >= BLOCK_CHARS):
                    close()
                    if len(out) >= 64:
                        yield batch()
                if not bodies:
                    first = h, at.as_py(), key
                bodies.append(v)
                keys.append(key)
                chars += len(body)
        close()
        yield batch()

    return run


# The fold over the blocks of a history

ABSENT = "ABSENT"


class _Values:
    """The first values of a field since it came; open until there are enough of them or the field has gone."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, list[str]]] = []
        self.open = True


class _Field:
    """What a history has shown of a field so far."""

    def __init__(self, sample: int):
        self.sample = sample
        self.lasting: bool | None = None  # the last lasting presence
        self.there: bool | None = None  # the run that goes on: its state, length and begin
        self.n, self.at, self.counted = 0, (0, ""), False
        self.kind_lasting: str | None = None
        self.kind: str | None = None
        self.kind_n, self.kind_at, self.kind_counted = 0, (0, ""), False
        self.recent: deque = deque(maxlen=sample)
        self.before: list = []
        self.since: _Values | None = None
        self.open: list[_Values] = []

    def enter(self, there: bool, n: int, at: _At) -> None:
        if self.there == there:
            self.n += n
        else:
            self.there, self.n, self.at, self.counted = there, n, at, False

    def settles(self) -> bool:
        """Whether the run has just become a lasting one."""
        now = self.n > 1 and not self.counted
        self.counted |= now
        return now


class Fold:
    """Changes of one history, block by block: rows (key, change, field before, field after)."""

    def __init__(self, sample: int):
        self.sample, self.seq = sample, 0
        self.fields: dict[str, _Field] = {}
        self.gone: dict[_At, list[tuple[str, list]]] = {}
        self.come: dict[_At, list[tuple[str, _Values]]] = {}
        self.first: _At = (0, "")
        self.out: list[tuple[str, str, str, str]] = []

    def add(self, n: int, key: str, shown: dict[str, list]) -> None:
        base = self.seq
        if not base:
            self.first = (0, key)
        for f in [f for f in self.fields if f not in shown]:
            self._absent(f, n, (base, key))
        for f, runs in shown.items():
            if f not in self.fields:
                self.fields[f] = _Field(self.sample)
                self.out.append(("", "FIELD", f, ""))
                if base:
                    self._absent(f, base, self.first)
            for there, rows, (at, own), kinds, first, last in runs:
                if there:
                    self._present(f, rows, (base + at, own), base, kinds, first, first if last is None else last)
                else:
                    self._absent(f, rows, (base + at, own))
        # what is lastingly absent is as good as never seen
        for f in [f for f, x in self.fields.items() if x.lasting is False and x.there is False]:
            del self.fields[f]
        self.seq = base + n
        self._flush(self.seq - 1)

    def _absent(self, f: str, n: int, at: _At) -> None:
        x = self.fields.setdefault(f, _Field(self.sample))
        if x.there is not False:
            x.before = list(x.recent)
        x.enter(False, n, at)
        if x.settles():
            if x.lasting:
                self.gone.setdefault(x.at, []).append((f, x.before))
            x.lasting, x.kind_lasting, x.kind = False, ABSENT, None
            x.recent.clear()
            for v in x.open:
                v.open = False
            x.open, x.since = [], None

    def _present(self, f: str, n: int, at: _At, base: int, kinds: list, first: list, last: list) -> None:
        x = self.fields[f]
        if x.there is not True:
            x.since = _Values()
        x.enter(True, n, at)
        for v in [*x.open, *([x.since] if x.since and x.since not in x.open else [])]:
            v.rows += first[: self.sample - len(v.rows)]
            v.open = len(v.rows) < self.sample
        x.open = [v for v in x.open if v.open]
        x.recent.extend(last)
        if x.settles():
            if x.lasting is False:
                self.come.setdefault(x.at, []).append((f, x.since))
                if x.since.open:
                    x.open.append(x.since)
            x.lasting = True
        for kind, m, (i, key) in kinds:
            if x.kind == kind:
                x.kind_n += m
            else:
                x.kind, x.kind_n, x.kind_at, x.kind_counted = kind, m, (base + i, key), False
            if x.kind_n > 1 and not x.kind_counted:
                x.kind_counted = True
                if x.kind_lasting not in (None, ABSENT, kind):
                    self.out.append((x.kind_at[1], "RETYPED", f, f))
                x.kind_lasting = kind

    def _flush(self, upto: int) -> None:
        """Writes what was settled before row ``upto`` and waits for no more values."""
        for at in sorted({a for a in (*self.gone, *self.come) if a[0] < upto}):
            olds, news = self.gone.get(at, []), self.come.get(at, [])
            if olds and any(v.open for _, v in news):
                continue
            self.gone.pop(at, None)
            self.come.pop(at, None)
            self.out += [(at[1], *c) for c in match(sorted(olds), sorted([(f, v.rows) for f, v in news]))]

    def end(self) -> None:
        for x in self.fields.values():
            for v in x.open:
                v.open = False
        self._flush(self.seq + 1)


def match(olds: list[tuple[str, list]], news: list[tuple[str, list]]) -> list[tuple[str, str, str]]:
    """Renames, removals and additions of fields (name, values) that go and come at one body."""
    out, taken_old, taken_new = [], set(), set()
    if olds and news:
        content = [[likeness(a, b) for _, b in news] for _, a in olds]
        weights = [[0.8 * c + 0.2 * name_likeness(x, y) if c >= ALIKE else 0.0 for c, (y, _) in zip(row, news)] for row, (x, _) in zip(content, olds)]
        for i, j in enumerate(assign(weights)):
            if j >= 0:
                out.append(("RENAMED", olds[i][0], news[j][0]))
                taken_old.add(i)
                taken_new.add(j)
    out += [("REMOVED", f, "") for i, (f, _) in enumerate(olds) if i not in taken_old]
    return out + [("ADDED", "", f) for j, (f, _) in enumerate(news) if j not in taken_new]


EVENT_DDL = "history string, key string, change_kind string, field_before string, field_after string"


def _clean(s: str) -> str:
    return s.encode("utf-8", "replace").decode()


def _fold_batches(sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history, fold = None, None

        def batch() -> pa.RecordBatch:
            rows = [(history, *map(_clean, r)) for r in fold.out] if fold else []
            if fold:
                fold.out = []
            cols = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["history", "key", "change_kind", "field_before", "field_after"])

        for b in batches:
            for h, summary in zip(b.column("history").to_pylist(), b.column("summary")):
                if fold is None or h != history:
                    if fold:
                        fold.end()
                        yield batch()
                    history, fold = h, Fold(sample)
                fold.add(*pickle.loads(summary.as_py()))
                if len(fold.out) > 10_000:
                    yield batch()
        if fold:
            fold.end()
        yield batch()

    return run


def _bodies(df: DataFrame, key: str, history: str, order: str, loaded: str, body: str) -> DataFrame:
    """(key, history, at, body), one row per key; staged, as range partitioning reads it twice."""
    cols = df.select(F.col(key).cast("string").alias("key"), F.col(history).cast("string").alias("history"), F.col(order).cast("timestamp").alias("at"), F.col(loaded).alias("loaded"), F.col(body).cast("string").alias("body"))
    return stage(latest(cols, "key", "loaded").select("key", "history", "at", "body"), "bodies")


def _events(rows: DataFrame, block: int, sample: int) -> DataFrame:
    """EVENT_DDL: the changes of each history, and each of its fields (FIELD)."""
    order = ["history", "at", "key"]
    laid = rows.where("history is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    summaries = laid.select("history", "at", "key", "body").mapInArrow(_summary_batches(block, sample), "history string, at timestamp, key string, summary binary")
    return summaries.repartition("history").sortWithinPartitions(*order).mapInArrow(_fold_batches(sample), EVENT_DDL)


def changes(df: DataFrame, key: str = "manifest_id", history: str = "repository", order: str = "written_at", loaded: str = "loaded_at", body: str = "body", block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(key, change_kind, field_before, field_after): each lasting change of a history, at the first body that shows it.

    The result is the same for every ``block``.
    """
    if block < 1 or sample < 1:
        raise ValueError("a block has at least one row, and a sample one value")
    events = _events(_bodies(df, key, history, order, loaded, body), block, sample)
    return events.where("change_kind <> 'FIELD'").select(F.col("key").alias(key), "change_kind", "field_before", "field_after")


def columns_of(pairs: list[tuple[str, str]], columns: list[str]) -> list[tuple[str, str]]:
    """(field, column) of the fields that renames join to one of the columns, the first of them in their order; columns keep their own."""
    lead: dict[str, str] = {}

    def top(x: str) -> str:
        while lead.get(x, x) != x:
            x = lead[x]
        return x

    for a, b in sorted(pairs):
        a, b = top(a), top(b)
        if a != b:
            lead[max(a, b)] = min(a, b)
    owner: dict[str, str] = {}
    for c in columns:
        owner.setdefault(top(c), c)
    own = set(columns)
    return sorted((f, owner[top(f)]) for f in {x for p in pairs for x in p} if f not in own and top(f) in owner)


def _column_batches(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, *c) for h, pairs in zip(b.column("history").to_pylist(), b.column("pairs").to_pylist()) for c in columns_of([(p["b"], p["a"]) for p in pairs], columns)]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["history", "field", "column"])

    return run


def place(body: dict, names: dict[str, tuple[str, bool]], columns: list[str]) -> tuple[dict, dict]:
    """(values by column, other values by field).  ``names``: column of a field, and whether this history itself says so.

    A column takes the field of its own name, else the one this history renamed, else one renamed elsewhere; where
    several fields have the same claim to a column, and for whatever finds its column taken, the value stays under its own name.
    """
    claims: dict[str, dict[int, list[str]]] = {}
    for f, x in body.items():
        c, rank = (f, 0) if f in columns else (names[f][0], 1 if names[f][1] else 2) if f in names else (None, 3)
        if c is not None and (x is not None or rank == 0):
            claims.setdefault(c, {}).setdefault(rank, []).append(f)
    taken: dict[str, object] = {}
    used = set()
    for c, ranks in claims.items():
        for rank in sorted(ranks):
            if len(ranks[rank]) > 1:
                break
            f = ranks[rank][0]
            if body[f] is not None or len(ranks) == 1:
                taken[c] = body[f]
                used.add(f)
                break
    return taken, {f: x for f, x in body.items() if f not in used and not (f in columns and x is None)}


def _unify_batches(columns: list[str]):
    def text(v: object) -> str | None:
        return None if v is None else _clean(v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in columns]
            rest, ok = [], []
            for body, names in zip(b.column("body").to_pylist(), b.column("names").to_pylist()):
                v = read_object(body)
                ok.append(v is not None)
                taken, other = place(v or {}, {n["field"]: (n["column"], n["own"]) for n in names or ()}, columns)
                for c, col in zip(columns, rows):
                    col.append(text(taken.get(c)))
                rest.append(_clean(json.dumps({f: text(x) for f, x in other.items()}, sort_keys=True, ensure_ascii=False)) if other else None)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("history"), b.column("at"), pa.array(ok, pa.bool_()), *[pa.array(r, pa.string()) for r in rows], pa.array(rest, pa.string())], names=["key", "history", "at", "readable", *[f"c{i}" for i in range(len(columns))], "rest"])

    return run


def unify(df: DataFrame, columns: list[str], key: str = "manifest_id", history: str = "repository", order: str = "written_at", loaded: str = "loaded_at", body: str = "body", block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """All bodies as one table: key, history, order, ``readable``, each of ``columns`` as text, and ``rest`` (JSON of other fields).

    A field goes into the column that the renames of its own history join it to, or else into the one that most other
    histories do; no value is lost (see ``place``).
    """
    rows = _bodies(df, key, history, order, loaded, body)
    events = stage(_events(rows, block, sample), "drift")
    pairs = events.where("change_kind = 'RENAMED'").groupBy("history").agg(F.collect_set(F.struct(F.col("field_before").alias("b"), F.col("field_after").alias("a"))).alias("pairs"))
    own = stage(pairs.mapInArrow(_column_batches(columns), "history string, field string, column string"), "columns")
    votes = own.groupBy("field", "column").agg(F.count("*").alias("n"))
    most = Window.partitionBy("field").orderBy(F.desc("n"), "column")
    votes = votes.withColumn("_n", F.row_number().over(most)).where("_n = 1").select("field", "column")
    shown = events.where("change_kind = 'FIELD'").select("history", F.col("field_before").alias("field")).distinct()
    elsewhere = join_hot(shown.join(own.select("history", "field"), ["history", "field"], "left_anti"), votes, ["field"]).select("history", "field", "column", F.lit(False).alias("own"))
    names = own.withColumn("own", F.lit(True)).unionByName(elsewhere).groupBy("history").agg(F.collect_list(F.struct("field", "column", "own")).alias("names"))
    ddl = "key string, history string, at timestamp, readable boolean, " + ", ".join(f"c{i} string" for i in range(len(columns))) + ", rest string"
    out = join_hot(rows, names, ["history"], "left", by=["key"]).select("key", "history", "at", "body", "names").mapInArrow(_unify_batches(columns), ddl)
    return out.select(F.col("key").alias(key), F.col("history").alias(history), F.col("at").alias(order), "readable", *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "rest")
