"""Cutting oversized texts at natural boundaries by recursive bisection.

A stretch longer than the limit minus the overlap is cut at the strongest
boundary near its middle (blank line, line end, sentence end, white space) and
both halves are treated alike; a stretch without any boundary stays whole while
it fits the limit and is else cut in the middle of its characters (``forced``).
Then each piece but the first is begun up to ``overlap`` bytes earlier, at a
boundary if there is one, as far as the limit allows.

Defined results: null ids, null texts and texts within the limit give no piece;
repeated rows of one id give one set of pieces (of the least text, should an id
have several); an empty table gives an empty result; further columns are
ignored.  Offsets are bytes of the UTF-8 text; no piece ends inside a character
or between CR and LF, unless the limit is below four bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 8192, 256
CURSOR = "source-part-v1:{}:{}"
KINDS = ("blank", "line", "sentence", "space")
_LINE = re.compile(rb"\r\n|\n|\r")
_BLANK = re.compile(rb"(?:\r\n|\n|\r)[ \t]*(?=(\r\n|\n|\r))")
_SENTENCE = re.compile(rb"(?:[.!?;:]|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[\"')\]]*(?=[ \t\r\n])")


def boundaries(b: bytes) -> list[np.ndarray]:
    """Sorted cut positions of each kind of KINDS; a position is where the next piece would begin."""
    a = np.frombuffer(b, dtype=np.uint8)
    lines = np.array([m.end() for m in _LINE.finditer(b)], dtype=np.int64)
    blanks = np.array([m.end(1) for m in _BLANK.finditer(b)], dtype=np.int64)
    ends = np.array([m.end() for m in _SENTENCE.finditer(b)], dtype=np.int64)
    white = (a == 32) | (a == 9) | (a == 10) | (a == 13)
    at = np.flatnonzero(white[1:] | white[:-1]) + 1
    if len(at):
        at = at[~((a[at - 1] == 13) & (a[at] == 10))]
    return [blanks, lines, ends, at]


def _nearest(p: np.ndarray, lo: int, hi: int, mid: int) -> int | None:
    """The position of ``p`` strictly between lo and hi that is next to mid."""
    i, j = np.searchsorted(p, lo, "right"), np.searchsorted(p, hi, "left")
    if i >= j:
        return None
    k = i + int(np.searchsorted(p[i:j], mid))
    best = [int(p[x]) for x in (k - 1, k) if i <= x < j]
    return min(best, key=lambda v: (abs(v - mid), v))


def _char_start(b: bytes, at: int, floor: int) -> int:
    x = at
    while x > floor and (b[x] & 0xC0 == 0x80 or (b[x] == 10 and b[x - 1] == 13)):
        x -= 1
    return x if x > floor else at


def split(b: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut at its end) of a text longer than ``limit``."""
    kinds = boundaries(b)
    core = max(1, limit - overlap)
    cuts: list[tuple[int, str]] = []
    stack = [(0, len(b))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= core:
            continue
        mid, reach = (lo + hi) // 2, (hi - lo) // 4
        found = None
        for kind, p in zip(KINDS, kinds):
            c = _nearest(p, max(lo, mid - reach), min(hi, mid + reach), mid)
            if c is not None:
                found = c, kind
                break
        if found is None and (c := _nearest(kinds[3], lo, hi, mid)) is not None:
            found = c, "space"
        if found is None:
            if hi - lo <= limit:
                continue
            found = _char_start(b, mid, lo), "forced"
        cuts.append(found)
        stack += [(lo, found[0]), (found[0], hi)]
    cuts.sort()
    edges = [(0, ""), *cuts, (len(b), "end")]
    out = []
    earlier = 0
    for (s, _), (e, kind) in zip(edges, edges[1:]):
        core = s
        if s:
            least = min(s, max(earlier + 1, s - overlap, e - limit))
            i = int(np.searchsorted(kinds[3], least))
            if i < len(kinds[3]) and kinds[3][i] < s:
                s = int(kinds[3][i])
            else:
                while least < s and (b[least] & 0xC0 == 0x80 or (b[least] == 10 and least and b[least - 1] == 13)):
                    least += 1
                s = least
        out.append((s, e, kind))
        earlier = core
    return out


DDL = "source_id string, piece int, startByte long, endByte long, text string, nextCursor string, cut string"


def _piece_batches(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                b = text.encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(b).hexdigest()
                parts = split(b, limit, overlap)
                for n, (s, e, kind) in enumerate(parts):
                    after = CURSOR.format(parts[n + 1][0], digest) if n + 1 < len(parts) else None
                    for c, v in zip(cols, (id_, n, s, e, b[s:e].decode("utf-8", "surrogatepass") if with_text else None, after, kind)):
                        c.append(v)
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["source_id", "piece", "startByte", "endByte", "text", "nextCursor", "cut"])

    return run


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """One row per piece of each text above ``limit`` bytes; rows of DDL.

    Without ``with_text`` only the cuts come out, once per row of the input, and nothing is shuffled.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and the limit")
    big = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.octet_length("text") > limit))
    if with_text:
        big = big.groupBy("id").agg(F.min("text").alias("text"))
    return big.mapInArrow(_piece_batches(limit, overlap, with_text), DDL)


def boundary_kind(df: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(source_id, boundary): ``forced`` if a piece had to be cut where no boundary was, else ``natural``."""
    cuts = split_oversized(df, id_col, text_col, limit, overlap, with_text=False)
    return cuts.groupBy("source_id").agg(F.when(F.max(F.col("cut") == "forced"), "forced").otherwise("natural").alias("boundary"))
