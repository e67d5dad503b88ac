"""Filling containers of fixed capacity with texts measured in tokens.

Sizes are whole numbers up to the capacity, so the texts are planned through
the histogram of their sizes, which has at most ``capacity`` rows whatever the
table holds.  Large sizes are rounded up within groups of equal cardinality
(linear grouping); configurations of these few sizes are optimised as a linear
program by column generation; its whole parts give slots that actual texts
take in order of size; what is left of the large texts and all small ones go,
largest first, where they fit best.  The plan is a list of ranges (size, first
number, how many, first container, how many to a container); a text finds its
container by its number among the texts of its size.

Defined results: only a text above the capacity is divided, into full parts and
a rest; null and empty texts have no tokens and a null container; null ids are
ignored; repeated rows are packed once each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.ordering import number_within
from factloom.runtime import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Numbers of groups that are tried; the plan with the fewest containers is taken.
GROUPS = (16, 64)
CAPACITY, LARGE_SHARE = 2048, 8
PLAN_LIMIT, CHUNK = 500_000, 1 << 16
_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of every row with an id."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_tokens long")


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The fullest use of ``capacity`` by value, with any number of each size."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    for c in range(int(s[0]), capacity + 1):
        k = int(np.searchsorted(s, c, "right"))
        gain = best[c - s[:k]] + v[:k]
        j = int(gain.argmax())
        best[c], pick[c] = (gain[j], j) if gain[j] > best[c - 1] else (best[c - 1], -1)
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[order[pick[c]]] += 1
            c -= int(s[pick[c]])
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """(number of each size, how many containers): whole parts of the best linear mixture that meets the demand."""
    n = len(sizes)
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag((capacity // s).astype(float))
    inverse = np.linalg.inv(basis)
    for step in range(rounds):
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        price = inverse.sum(0)
        value, column = knapsack(s, price, capacity)
        if value <= 1 + 1e-7:
            break
        u, x = inverse @ column, inverse @ d
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        basis[:, r] = column
        inverse[r] /= u[r]
        for i in range(n):
            if i != r:
                inverse[i] -= u[i] * inverse[r]
    x = np.linalg.solve(basis, d)
    whole = np.floor(np.maximum(x, 0) + 1e-6).astype(int)
    left = np.array(demand) - basis.astype(int) @ whole
    for r in np.argsort(-x):  # rounding may not overdraw a size
        while whole[r] and (left < 0).any() and (basis[left < 0, r] > 0).any():
            whole[r] -= 1
            left += basis[:, r].astype(int)
    return [(basis[:, r].astype(int), int(whole[r])) for r in range(n) if whole[r] > 0]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, large_share: int = LARGE_SHARE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (size, first number, how many, first container, how many to a container), and the number of containers."""
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    taken: dict[int, int] = defaultdict(int)
    ranges: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    levels: list[int] = []
    total = 0

    def put(s: int, n: int, container: int, per: int) -> None:
        ranges.append((s, taken[s], n, container, per))
        taken[s] += n
        left[s] -= n

    def offer(room: int, container: int, count: int) -> None:
        if room > 0 and count > 0:
            if not free[room]:
                bisect.insort(levels, room)
            free[room].append((container, count))

    if left.get(capacity):
        n = left[capacity]
        put(capacity, n, 0, 1)
        total = n
    large = [(s, left[s]) for s in sorted(left, reverse=True) if s > capacity // large_share and left[s]]
    count = sum(n for _, n in large)
    if count:
        quota = -(-count // groups)
        pools: list[list[list[int]]] = []
        room = 0
        for s, n in large:
            while n:
                if not room:
                    if not pools or pools[-1][0][0] != s:  # else the next group would round to the same size
                        pools.append([])
                    room = quota
                m = min(n, room)
                if pools[-1] and pools[-1][-1][0] == s:
                    pools[-1][-1][1] += m
                else:
                    pools[-1].append([s, m])
                n, room = n - m, room - m
        sizes = [p[0][0] for p in pools]
        for pattern, many in configurations(sizes, [sum(m for _, m in p) for p in pools], capacity):
            edges, slots = {0, many}, []
            for g in np.repeat(np.arange(len(sizes)), pattern):
                at, parts = 0, []
                while at < many:
                    s, m = pools[g][0]
                    m = min(m, many - at)
                    put(s, m, total + at, 1)
                    parts.append((at, s))
                    at += m
                    edges.add(at)
                    pools[g][0][1] -= m
                    if not pools[g][0][1]:
                        pools[g].pop(0)
                slots.append(parts)
            cuts = sorted(edges)
            for a, b in zip(cuts, cuts[1:]):
                used = sum(p[bisect.bisect_right(p, (a, capacity + 1)) - 1][1] for p in slots)
                offer(capacity - used, total + a, b - a)
            total += many
    for s in sorted(left, reverse=True):
        while left[s]:
            i = bisect.bisect_left(levels, s)
            if i == len(levels):
                per = min(capacity // s, left[s])
                m = left[s] // per
                put(s, m * per, total, per)
                offer(capacity - per * s, total, m)
                total += m
                continue
            room = levels[i]
            container, m = free[room].pop()
            if not free[room]:
                levels.pop(i)
            k = min(room // s, left[s] // m)
            if k:
                put(s, k * m, container, k)
                offer(room - k * s, container, m)
            else:
                n = left[s]
                put(s, n, container, 1)
                offer(room - s, container, n)
                offer(room, container + n, m - n)
    return ranges, total


def _placer(ranges: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(ranges), dtype=np.int64).reshape(-1, 5)
    key = table[:, 0] * (1 << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, number = b.column("size").to_numpy(), b.column("number").to_numpy()
            at = np.searchsorted(key, size * (1 << 44) + number, "right") - 1
            container = table[at, 3] + (number - table[at, 1]) // table[at, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "part", "start", "size")), pa.array(container)], names=["id", "part", "start", "size", "container"])

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """(id, part, start_token, n_tokens, container_id): every text, or each part of one above the capacity, with its container."""
    counts = token_counts(df, id_col, text_col, tokenizer)
    return pack_sizes(counts, capacity, groups).withColumnRenamed("id", id_col)


def pack_sizes(counts: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """As ``pack`` for rows (id, n_tokens)."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int")
    parts = counts.withColumn("part", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("part").cast("long") * capacity)
    parts = parts.select("id", "part", "start", F.least(F.col("n_tokens") - F.col("start"), F.lit(capacity)).cast("long").alias("size"))
    items = stage(number_within(parts, ["size"], ["id", "part"], "number"), "sizes")
    histogram = {r["size"]: r["n"] for r in items.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    ranges, _ = min((plan(histogram, capacity, g) for g in groups), key=lambda p: p[1])
    some = items.where("size > 0")
    if len(ranges) <= PLAN_LIMIT:
        placed = some.mapInArrow(_placer(ranges), f"id {items.schema['id'].dataType.simpleString()}, part int, start long, size long, container long")
    else:
        # a larger plan is a table; numbers are cut into chunks, so a size of any number of texts meets it in many tasks
        cols = np.array(ranges, dtype=np.int64).reshape(-1, 5).T
        rows = items.sparkSession.createDataFrame(pa.table(dict(zip(("size", "first", "many", "base", "per"), cols))))
        rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("first") + F.col("many") - 1) / CHUNK))))
        placed = some.withColumn("chunk", F.floor(F.col("number") / CHUNK)).join(rows, ["size", "chunk"]).where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("many")))
        placed = placed.select("id", "part", "start", "size", (F.col("base") + F.floor((F.col("number") - F.col("first")) / F.col("per"))).alias("container"))
    none = items.where("size = 0").select("id", "part", "start", "size", F.lit(None).cast("long").alias("container"))
    return placed.unionByName(none).select("id", "part", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, texts and parts, tokens, the least number of containers that could do, and the share filled."""
    per = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("parts"))
    total = per.agg(F.count("*").alias("containers"), F.sum("parts").alias("parts"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.select("containers", "parts", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("filled"))
