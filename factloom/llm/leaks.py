"""Evaluation passages inside training texts, by greedy string tiling.

The passages (without an opening that several items share, and without the
closing question) are cut into words and taken in blocks of a bounded number
of items, several blocks to a scan of the documents.  Words of a document are compared by number; documents that share
enough three-word seeds with an item are tiled: the longest common runs of
words are marked first, none overlapping, found by running Karp-Rabin: hashes of
all unmarked runs of one length roll over both sides, equal ones are compared
and extended, and the length shrinks.  An item has leaked if tiles in order, with a few
foreign words between them, hold ``min_words`` of its words, or if tiles of six
words or more cover half of the passage in any order.

Defined results: null ids and null texts are ignored on both sides; empty texts
and items without a passage match nothing; repeated rows give one pair; an
empty table on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.ordering import number_within
from factloom.runtime import stage

SEED, BLOCK_ITEMS, SCAN_BLOCKS, MIN_WORDS, LONG_TILE, COVER = 3, 4096, 4, 15, 6, 0.5
#: Words of the passage that may be replaced between two tiles, and foreign words (as of markup) in the document.
GAP, FOREIGN = 2, 4
SHARED_GRAM, SHARED_BY = 5, 3
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_ESCAPE = re.compile(r"\\[nrt]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def words_of(text: str) -> list[str]:
    """Words of letters and digits, without letter case, tags, escaped line ends and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.casefold())


def passage_of(text: str) -> str:
    """The text without the question that closes it."""
    body = text.rstrip()
    if not body.endswith("?"):
        return body
    cut = max(body.rfind(". "), body.rfind(".\n"), body.rfind("! "), body.rfind("!\n"), body.rfind("\n\n"))
    return body[: cut + 1] if cut > 0 else body


def prepare_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words): the words of each item's own passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([words_of(passage_of(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["item_id", "words"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    rows = stage(rows.mapInArrow(cut, "item_id long, words array<string>"), "items")
    n = SHARED_GRAM
    grams = F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.array().cast("array<string>"))
    at = rows.select("item_id", F.size("words").alias("n"), F.posexplode(grams).alias("pos", "gram"))
    shared = at.groupBy("gram").agg(F.count_distinct("item_id").alias("by")).where(F.col("by") >= SHARED_BY).select("gram", F.lit(True).alias("shared"))
    # the opening ends before the first five words that are the item's own
    own = at.join(shared, "gram", "left").where("shared is null").groupBy("item_id").agg(F.min("pos").alias("own"))
    opened = at.join(shared, "gram").where("pos = 0").select("item_id").distinct().withColumn("opens", F.lit(True))
    out = rows.join(own, "item_id", "left").join(opened, "item_id", "left")
    skip = F.when(F.col("opens"), F.when(F.col("own").isNull(), F.size("words")).otherwise(F.col("own") + n - 1)).otherwise(0)
    return stage(out.select("item_id", F.slice("words", skip + 1, F.greatest(F.size("words") - skip, F.lit(0))).alias("words")), "passages")


_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Words as spread 64-bit numbers."""
    h = x.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def rolled(x: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of each ``s`` consecutive values, from those of half the length."""
    done, h, power = 1, _mixed(x), _BASE
    for bit in bin(s)[3:]:
        h = h[: len(h) - done] * np.uint64(power) + h[done:]
        done, power = 2 * done, power * power & _MASK
        if bit == "1":
            h = h[: len(h) - 1] * np.uint64(_BASE) + _mixed(x[done:])
            done, power = done + 1, power * _BASE & _MASK
    return h


def _free(used: np.ndarray, s: int) -> np.ndarray:
    """Where ``s`` unmarked values in succession begin."""
    marked = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(marked[s:] == marked[: len(marked) - s])


def tile(a: np.ndarray | list[int], b: np.ndarray | list[int], least: int = SEED, start: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences: (start in a, start in b, length), longest first, none overlapping."""
    a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    used_a, used_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    if min(len(a), len(b)) < least:
        return tiles
    s = max(least, min(start, len(a), len(b)))
    while True:
        at_a, at_b = _free(used_a, s), _free(used_b, s)
        ha, hb = rolled(a, s)[at_a], rolled(b, s)[at_b]
        order = np.argsort(ha, kind="stable")
        ha, at_a = ha[order], at_a[order]
        lo, n = np.searchsorted(ha, hb), np.searchsorted(ha, hb, "right")
        n -= lo
        j = np.repeat(at_b, n)
        i = at_a[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(j))] if len(j) else j
        # only where a match begins; it is extended word by word
        inner = (i > 0) & (j > 0)
        inner[inner] = (a[i[inner] - 1] == b[j[inner] - 1]) & ~used_a[i[inner] - 1] & ~used_b[j[inner] - 1]
        found: list[tuple[int, int, int]] = []
        for p, q in zip(i[~inner].tolist(), j[~inner].tolist()):
            reach = min(len(a) - p, len(b) - q)
            stops = (a[p : p + reach] != b[q : q + reach]) | used_a[p : p + reach] | used_b[q : q + reach]
            size = int(stops.argmax()) if stops.any() else reach
            if size >= s:
                found.append((size, p, q))
        longest = max((f[0] for f in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for size, p, q in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if used_a[p : p + size].any() or used_b[q : q + size].any():
                again = True
                continue
            used_a[p : p + size] = used_b[q : q + size] = True
            tiles.append((p, q, size))
        if again:
            continue
        if s == least:
            return tiles
        s = max(least, s // 2)


def in_order(tiles: list[tuple[int, int, int]], gap: int = GAP, foreign: int = FOREIGN) -> int:
    """The most words of tiles that follow each other on both sides, with at most ``gap`` words between
    in the passage (a) and ``foreign`` in the document (b)."""
    best = 0
    rows = sorted(tiles, key=lambda t: t[1])
    score: list[int] = []
    for k, (i, j, n) in enumerate(rows):
        top, m = 0, k - 1
        while m >= 0 and j - rows[m][1] - rows[m][2] <= foreign:  # tiles don't overlap, so those before end still earlier
            if 0 <= i - rows[m][0] - rows[m][2] <= gap:
                top = max(top, score[m])
            m -= 1
        score.append(top + n)
        best = max(best, score[-1])
    return best


class Block:
    """Seeds of a bounded number of items, for lookup."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = [(i, w) for i, w in items if len(w) >= SEED]
        vocabulary: dict[str, int] = {}
        self.coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], dtype=np.int64) for _, ws in self.items]
        self.vocabulary = vocabulary
        self.base = np.int64(len(vocabulary) + 1)
        pairs = [np.stack([self.seeds(c), np.full(len(c) - SEED + 1, k)]) for k, c in enumerate(self.coded)]
        both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
        self.keys, self.first = np.unique(both[0], return_index=True)
        self.last = np.append(self.first[1:], both.shape[1])
        self.owner = both[1]

    def seeds(self, c: np.ndarray) -> np.ndarray:
        return (c[:-2] * self.base + c[1:-1]) * self.base + c[2:]

    def matches(self, words: list[str], min_words: int) -> Iterator[tuple[int, int, float]]:
        """(item, words in order, share of the passage covered by long tiles) of each item that leaked."""
        get = self.vocabulary.get
        c = np.array([get(w, 0) for w in words], dtype=np.int64)
        if len(c) < SEED or not len(self.keys):
            return
        at = np.flatnonzero((c[:-2] > 0) & (c[1:-1] > 0) & (c[2:] > 0))
        key = (c[at] * self.base + c[at + 1]) * self.base + c[at + 2]
        k = np.searchsorted(self.keys, key)
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == key
        at, k = at[hit], k[hit]
        # tiles of ``SEED`` words and more that hold n words hold n / SEED seeds at least
        need = max(1, min(-(-min_words // SEED), LONG_TILE - SEED + 1))
        if len(at) < need:
            return
        spots: dict[int, list[int]] = defaultdict(list)
        for p, f, l in zip(at.tolist(), self.first[k].tolist(), self.last[k].tolist()):
            for o in self.owner[f:l].tolist():
                spots[o].append(p)
        for o, where in spots.items():
            if len(where) < need:
                continue
            passage = self.coded[o]
            near = np.zeros(len(c), dtype=bool)
            for p in where:
                near[max(0, p - FOREIGN) : p + SEED + FOREIGN] = True
            # words far from all seeds of the item can't be in a tile; stops stay in their place
            keep = np.flatnonzero(near)
            stop = np.full(FOREIGN + 1, -1, dtype=np.int64)
            part = np.concatenate([x for run in np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1) for x in (c[run], stop)])
            tiles = tile(passage, part)
            order = in_order(tiles)
            cover = sum(n for _, _, n in tiles if n >= LONG_TILE) / len(passage)
            if order >= min_words or (cover >= COVER and len(passage) >= min_words):
                yield self.items[o][0], order, cover


def _scan(blocks: list[Block], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for id_, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                words = words_of(text.as_py())
                for block in blocks:
                    out += [(id_, *m) for m in block.matches(words, min_words)]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "words_in_order", "long_tile_share"])

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, words_in_order, long_tile_share) of each document and item that leaked into it.

    The items are the query set: they are numbered and sent to the executors in blocks of ``block_items``, of which
    SCAN_BLOCKS share one scan of the documents, where each text is cut into words once.
    """
    passages = prepare_items(items, item_col, item_text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    total = passages.count()
    if total > block_items:
        passages = stage(number_within(passages.withColumn("one", F.lit(1)), ["one"], ["item_id"], "no"), "numbered")
    ddl = "doc_id long, item_id long, words_in_order long, long_tile_share double"
    out = docs.sparkSession.createDataFrame([], ddl)
    step = block_items * SCAN_BLOCKS
    for first in range(0, total, step):
        blocks = []
        for lo in range(first, min(first + step, total), block_items):
            mine = passages.where(F.col("no").between(lo, lo + block_items - 1)) if total > block_items else passages
            blocks.append(Block([(r["item_id"], list(r["words"])) for r in mine.collect()]))  # at most ``block_items`` rows
        found = rows.mapInArrow(_scan(blocks, min_words), ddl)
        out = found if total <= step else out.unionByName(stage(found, "leaks"))
    return out.groupBy("doc_id", "item_id").agg(F.max("words_in_order").alias("words_in_order"), F.max("long_tile_share").alias("long_tile_share"))
