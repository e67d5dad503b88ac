"""Windows of source text around declarations and terms, worked off text by text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHOLE_BYTES, WINDOWS, BYTES, BEFORE, AFTER, ANCHORS = 8192, 4, 24_576, 8, 24, 4


class Lines:
    """Lines of a text as byte ranges without their line feeds; what follows the last line feed is a line if there is anything."""

    def __init__(self, text: str):
        self.text = text.split("\n")
        if len(self.text) > 1 and not self.text[-1]:
            self.text.pop()
        self.start = [0, *accumulate(len(x.encode("utf-8", "surrogatepass")) + 1 for x in self.text)]

    def __len__(self) -> int:
        return len(self.text)

    def size(self, first: int, last: int) -> int:
        """Bytes of the lines from ``first`` to ``last`` with the line feeds between them."""
        return self.start[last] - self.start[first - 1] - 1

    def cut(self, first: int, last: int) -> str:
        return "\n".join(self.text[first - 1 : last])


def _support(line: str, terms: tuple[str, ...]) -> tuple[int, int]:
    """(terms in a line, occurrences)"""
    n = [line.count(t) for t in terms]
    return sum(map(bool, n)), sum(n)


def _joined(kept: list[tuple[int, int]], new: tuple[int, int]) -> list[tuple[int, int]]:
    """Intervals in order with one more, which is joined to the last one where they touch."""
    if kept and new[0] <= kept[-1][1] + 1:
        return [*kept[:-1], (kept[-1][0], max(kept[-1][1], new[1]))]
    return [*kept, new]


def windows(text: str, terms: list[str], ranges: list[tuple[int, int]], whole: int = WHOLE_BYTES, most: int = WINDOWS, budget: int = BYTES) -> list[tuple[int, int]]:
    """(first line, last line) of at most ``most`` windows within a budget of bytes; none for an empty text.

    A small text is one window.  Else declarations (first line, last line) are widened and joined where they touch, as
    many in their order as go; without declarations the best line for the terms stands for one.  Then lines outside
    are added that serve their terms better than any line inside, the best first.
    """
    lines = Lines(text)
    if not text:
        return []
    if lines.start[-1] - (not text.endswith("\n")) <= whole:
        return [(1, len(lines))]
    low = [x.lower() for x in lines.text]
    asked = tuple(t.lower() for t in terms if t)
    spots = [(a, max(a, b)) for a, b in ranges if 1 <= a <= len(lines)]
    if not spots:
        best = max(range(len(lines)), key=lambda i: (_support(low[i], asked), -i)) + 1
        spots = [(best, best)]
    wide = sorted((max(1, a - BEFORE), min(len(lines), b + AFTER)) for a, b in spots)
    steps = list(accumulate(wide, _joined, initial=[]))[1:]
    used = lambda kept: sum(lines.size(*w) for w in kept)
    # a single window may be larger than the budget, as long as nothing is joined to it
    out = list(takewhile(lambda kept: len(kept) <= most and (kept == [wide[0]] or used(kept) <= budget), steps))[-1]
    if not ranges or not asked:
        return out
    held = [low[i - 1] for a, b in out for i in range(a, b + 1)]
    served = [(_support(x, asked), i) for i, x in enumerate(low, 1) if not any(a <= i <= b for a, b in out)]
    left = budget - used(out)
    for (n, _), i in sorted(served, key=lambda s: (-s[0][0], -s[0][1], s[1])):
        own = tuple(t for t in asked if t in low[i - 1])
        if not n or len(out) == most:
            break
        if _support(low[i - 1], own) <= max(_support(x, own) for x in held):
            continue
        left -= lines.size(i, i)
        if left < 0:
            break
        held.append(low[i - 1])
        out = sorted([*out, (i, i)])
    return out


def anchors(text: str, terms: list[str], most: int = ANCHORS) -> list[tuple[int, list[str]]]:
    """(line, terms it covers first): lines that cover all terms with few lines, at most ``most``."""
    low = [x.lower() for x in Lines(text).text]
    hits = {i: {t: x.count(t) for t in terms if t in x} for i, x in enumerate(low, 1)}
    open_ = {t for h in hits.values() for t in h}
    out: list[tuple[int, list[str]]] = []
    while open_ and len(out) < most:
        line = max(hits, key=lambda i: (len(open_ & set(hits[i])), sum(n for t, n in hits[i].items() if t in open_), -i))
        out.append((line, sorted(open_ & set(hits[line]))))
        open_ -= set(hits[line])
    return out


def source_windows(texts: DataFrame, key: str, text: str, ranges: str, terms: list[str]) -> DataFrame:
    """(key, first_line, last_line, text) per window; ``ranges``: array of (first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t, r in zip(*(b.column(c).to_pylist() for c in ("k", "t", "r"))):
                lines = Lines(t)
                rows += [(k, a, e, lines.cut(a, e)) for a, e in windows(t, terms, [(x["first"], x["last"]) for x in r or []])]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["k", "first_line", "last_line", "text"])

    src = texts.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(ranges).alias("r")).where("k is not null and t is not null")
    return src.mapInArrow(run, "k string, first_line long, last_line long, text string").withColumnRenamed("k", key)


def term_anchors(texts: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, line, terms) per anchor; only texts that hold a term go to Python."""
    asked = sorted({t.lower() for t in terms if t})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *a) for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()) for a in anchors(t, asked)]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.list_(pa.string())))], names=["k", "line", "terms"])

    src = texts.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    holds = F.lit(False)
    for t in asked:
        holds = holds | F.contains(F.lower("t"), F.lit(t))
    return src.where(holds).mapInArrow(run, "k string, line long, terms array<string>").withColumnRenamed("k", key)


