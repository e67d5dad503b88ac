"""Long verbatim spans shared between records, by winnowed seeds and extension.

1. Every text is cut into overlapping K-grams; in each window of W K-grams the
   least hash is kept as an anchor (winnowing).  With K + W - 1 = ``min_chars``
   each stretch of ``min_chars`` characters holds an anchor picked from its own
   content alone, so both copies of a shared stretch pick the same one.
2. Anchors whose hash stands under two ids are joined back to their texts and
   carry the characters around them, ``min_chars`` - K to either side: that is
   all an extension of one anchor has to see, as longer matches are chains of
   anchors.
3. Anchors with few occurrences are extended pair by pair.  For the others
   (an anchor may stand in a third of all rows) equal surroundings are first
   collapsed; the ``min_chars`` windows around the anchor find the surroundings
   to extend against by hash, one for each class of equal windows, and all
   characters of a run of such windows are then compared with that one's.
   Should texts of one class differ, it is divided by text.  This gives the same
   positions as pairs do.
4. The stretches of an id are merged to longest runs.

Defined results: null ids and null texts are ignored; texts below ``min_chars``
never share; repeated rows of one id count as one text; an empty table gives an
empty result; further columns are ignored.  Positions are Unicode code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ordering import join_counted
from factloom.runtime import stage

PAIR_LIMIT = 32
CHUNK = 1 << 20
SEEN_LIMIT = 200_000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(base), dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = out[0], out[1]
    return _powers[size]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive values, by prefix sums mod 2**64."""
    n = len(points)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    power, inverse = _tables(n + 1)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    h = (prefix[k:] - prefix[:-k]) * inverse[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the leftmost least of some window of ``w`` hashes."""
    m = len(h)
    if m < w:
        return np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(view.argmin(1) + np.arange(m - w + 1))


def _segments(texts: list[str], reach: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Groups of texts of about CHUNK characters; longer texts in parts that overlap by ``reach``."""
    rows, parts, total = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - reach), CHUNK):
            piece = t[at : at + CHUNK + reach]
            rows.append((i, at, len(piece)))
            parts.append(piece)
            total += len(piece)
            if total >= CHUNK:
                yield rows, code_points("".join(parts))
                rows, parts, total = [], [], 0
    if rows:
        yield rows, code_points("".join(parts))


def _anchor_batches(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            hs: list[list[np.ndarray]] = [[] for _ in texts]
            ps: list[list[np.ndarray]] = [[] for _ in texts]
            for rows, points in _segments(texts, k + w - 2):
                grams, at = gram_hashes(points, k), 0
                for i, start, n in rows:
                    if n >= k + w - 1:
                        own = grams[at : at + n - k + 1]
                        p = winnow(own, w)
                        hs[i].append(own[p])
                        ps[i].append(p + start)
                    at += n
            keep = [i for i, x in enumerate(ps) if x]
            if not keep:
                continue
            merged_p, merged_h = [], []
            for i in keep:
                p, first = np.unique(np.concatenate(ps[i]), return_index=True)
                merged_p.append(p)
                merged_h.append(np.concatenate(hs[i])[first])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in merged_p])]).astype(np.int32)
            idx = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("k1").take(idx),
                    b.column("k2").take(idx),
                    pa.ListArray.from_arrays(offsets, np.concatenate(merged_h).view(np.int64)),
                    pa.ListArray.from_arrays(offsets, np.concatenate(merged_p).astype(np.int64)),
                ],
                names=["k1", "k2", "h", "pos"],
            )

    return run


def _context_batches(k: int, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for b in batches:
            out: list[list] = [[] for _ in CONTEXT]
            size = 0
            for id_, k1, text, marks in zip(b.column("id").to_pylist(), b.column("k1").to_pylist(), b.column("text").to_pylist(), b.column("marks").to_pylist()):
                for m in marks:
                    p = m["pos"]
                    s = max(0, p - side)
                    ctx, cid = text[s : p + k + side], 0
                    if m["hot"]:
                        # the surroundings of a frequent anchor are sent along once from each task
                        cid = int.from_bytes(hashlib.blake2b(ctx.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                        key = (m["h"], p - s, cid)
                        if key in seen:
                            ctx = None
                        else:
                            if len(seen) >= SEEN_LIMIT:
                                seen.clear()
                            seen.add(key)
                    for col, v in zip(out, (m["h"], m["hot"], id_, k1, s, p - s, cid, ctx)):
                        col.append(v)
                    size += len(ctx or "") + 64
                if size > 4_000_000:
                    yield _contexts(out)
                    out, size = [[] for _ in CONTEXT], 0
            if out[0]:
                yield _contexts(out)

    return run


CONTEXT = pa.schema([("h", pa.int64()), ("hot", pa.bool_()), ("id", pa.string()), ("k1", pa.int64()), ("s", pa.int64()), ("off", pa.int64()), ("cid", pa.int64()), ("ctx", pa.string())])
CONTEXT_DDL = "h long, hot boolean, id string, k1 long, s long, off long, cid long, ctx string"


def _contexts(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, CONTEXT.types)], schema=CONTEXT)


def _extend(rows: list[tuple], k: int, side: int, least: int) -> list[tuple[str, int, int]]:
    """Extends all pairs of the occurrences of some anchors to both sides.

    ``rows``: (h, id, k1, s, off, ctx), those of one h together.
    """
    n = len(rows)
    grid = np.zeros((n, 2 * side + k), dtype=np.uint32)  # the anchor starts in column ``side``
    lo, hi = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, (_, _, _, _, off, ctx) in enumerate(rows):
        pts = code_points(ctx)
        lo[i], hi[i] = side - off, side - off + len(pts)
        grid[i, lo[i] : hi[i]] = pts
    left, right, i = [], [], 0
    while i < n:
        j = i
        while j < n and rows[j][0] == rows[i][0]:
            j += 1
        a, b = np.triu_indices(j - i, 1)
        left.append(a + i)
        right.append(b + i)
        i = j
    a, b = np.concatenate(left), np.concatenate(right)
    ids = np.array([r[1] for r in rows], dtype=object)
    keep = ids[a] != ids[b]
    a, b = a[keep], b[keep]
    found: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for c in range(0, len(a), 4096):
        x, y = a[c : c + 4096], b[c : c + 4096]
        same = grid[x] == grid[y]
        cols = np.arange(2 * side + k)
        same &= (cols >= np.maximum(lo[x], lo[y])[:, None]) & (cols < np.minimum(hi[x], hi[y])[:, None])
        ok = same[:, side : side + k].all(1)  # the anchors are equal and not only their hashes
        reach_l = np.where(same[:, :side].all(1), side, (~same[:, :side][:, ::-1]).argmax(1)) if side else np.zeros(len(x), int)
        reach_r = np.where(same[:, side + k :].all(1), side, (~same[:, side + k :]).argmax(1)) if side else np.zeros(len(x), int)
        ok &= reach_l + k + reach_r >= least
        for p, q, l, r in zip(x[ok], y[ok], reach_l[ok], reach_r[ok]):
            for o in (p, q):
                at = rows[o][3] + rows[o][4]
                found.setdefault((rows[o][1], rows[o][3]), []).append((at - l, at + k + r))
    out = []
    for (id_, _), spans in found.items():
        spans.sort()
        s, e = spans[0]
        for s2, e2 in spans[1:]:
            if s2 > e:
                out.append((id_, int(s), int(e)))
                s, e = s2, e2
            else:
                e = max(e, e2)
        out.append((id_, int(s), int(e)))
    return out


def _pair_batches(k: int, side: int, least: int):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        out = _extend(rows, k, side, least)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["id", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "id", "k1", "s", "off", "ctx"))):
                if len(rows) >= 8192 and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)

    return run


def _window_batches(k: int, least: int, bits: int):
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for h, off, cid, mn, mx, ctx in zip(*(b.column(c).to_pylist() for c in ("h", "off", "cid", "mn", "mx", "ctx"))):
                wh = (gram_hashes(code_points(ctx), least) & mask).view(np.int64)
                j = np.arange(len(wh), dtype=np.int64)
                fits = (j <= off) & (j + least >= off + k)  # the window holds the anchor
                wh, j = wh[fits], j[fits]
                for col, v in zip(cols, (h, off, cid, mn, mx)):
                    col.append(np.full(len(j), v, dtype=np.int64))
                cols[5].append(j)
                cols[6].append(wh)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["h", "off", "cid", "mn", "mx", "j", "wh"])

    return run


def merge_spans(spans: DataFrame) -> DataFrame:
    """(id, s, e) with overlaps -> longest runs, by islands within one id."""
    spans = spans.distinct()
    before = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    marked = spans.withColumn("new", F.coalesce((F.col("s") > F.max("e").over(before)).cast("int"), F.lit(1)))
    return marked.withColumn("island", F.sum("new").over(upto)).groupBy("id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("id", "s", "e")


def _alike(own: str, a: str, other: str, b: str, size: str) -> Column:
    """Whether ``size`` characters of ``own`` from ``a`` on are those of ``other`` from ``b`` on."""
    return F.col(own).substr(F.col(a).cast("int") + 1, F.col(size).cast("int")) == F.col(other).substr(F.col(b).cast("int") + 1, F.col(size).cast("int"))


def _hot_spans(hot: DataFrame, k: int, least: int, bits: int) -> DataFrame:
    """(id, s, e) of the occurrences of frequent anchors, without pairs."""
    around = ["h", "off", "cid"]
    alike = stage(hot.groupBy(*around).agg(F.min("k1").alias("mn"), F.max("k1").alias("mx"), F.max("ctx").alias("ctx"), F.count("*").alias("n")), "alike")
    windows = stage(alike.select(*around, "mn", "mx", "ctx").mapInArrow(_window_batches(k, least, bits), "h long, off long, cid long, mn long, mx long, j long, wh long"), "windows")
    classes = windows.groupBy("h", "wh").agg(F.min("mn").alias("lo"), F.max("mx").alias("hi"), F.min(F.struct("off", "cid", "j")).alias("one"), F.count("*").alias("n"))
    classes = stage(classes.where("lo <> hi").select("h", "wh", "one", "n"), "classes")
    # at most min_chars - K + 1 windows hold an anchor; a run of them is compared with the run of one other
    met = join_counted(windows, classes, ["h", "wh"], "n", by=["off", "cid", "j"]).select(*around, "wh", "j", F.col("one.off").alias("r_off"), F.col("one.cid").alias("r_cid"), (F.col("j") - F.col("one.j")).alias("d"))
    texts = alike.select(*around, "ctx")
    one = [F.col("off").alias("r_off"), F.col("cid").alias("r_cid"), F.col("ctx").alias("r_ctx")]

    def runs_of(met: DataFrame, keys: list[str]) -> DataFrame:
        js = met.groupBy(*keys).agg(F.array_sort(F.collect_set("j")).alias("js"))
        a, b = F.filter("js", lambda j: ~F.array_contains("js", j - 1)), F.filter("js", lambda j: ~F.array_contains("js", j + 1))
        return js.select(*keys, F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("r")).select(*keys, F.col("r.a").alias("a"), F.col("r.b").alias("b"))

    runs = stage(runs_of(met, [*around, "r_off", "r_cid", "d"]), "runs")
    ones = runs.groupBy("h", "r_off", "r_cid").agg(F.count("*").alias("m"))
    ones = stage(ones.join(texts.select("h", *one), ["h", "r_off", "r_cid"]), "ones")
    compared = join_counted(runs.join(texts, around), ones, ["h", "r_off", "r_cid"], "m", by=["off", "cid", "a"])
    compared = compared.withColumn("size", F.col("b") - F.col("a") + least).withColumn("ra", F.col("a") - F.col("d"))
    compared = stage(compared.select(*around, "a", "b", _alike("ctx", "a", "r_ctx", "ra", "size").alias("same")), "compared")
    good = compared.where("same")
    wrong = compared.where("not same")
    if wrong.limit(1).count():
        # different texts of one hash: their classes are divided by text
        split = wrong.select(*around, F.explode(F.sequence("a", "b")).alias("j")).join(windows, [*around, "j"]).select("h", "wh").distinct()
        by_text = windows.join(split, ["h", "wh"]).join(texts, around).withColumn("text", F.col("ctx").substr(F.col("j").cast("int") + 1, F.lit(least)))
        equal = by_text.groupBy("h", "text").agg(F.min("mn").alias("lo"), F.max("mx").alias("hi")).where("lo <> hi").select("h", "text")
        rest = met.join(split, ["h", "wh"], "left_anti").select(*around, "j").unionByName(by_text.join(equal, ["h", "text"]).select(*around, "j"))
        good = runs_of(rest, around)
    offsets = good.groupBy(*around).agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    offsets = stage(offsets.join(alike.select(*around, "n"), around), "offsets")
    wide = join_counted(hot.select("id", "s", *around), offsets, around, "n", by=["id", "s"]).select("id", "s", F.explode("runs").alias("r"))
    return wide.select("id", (F.col("s") + F.col("r.a")).alias("s"), (F.col("s") + F.col("r.b") + least).alias("e"))


def shared_spans(df: DataFrame, id_col: str = "id", text_col: str = "text", min_chars: int = 200, pair_limit: int = PAIR_LIMIT, hash_bits: int = 64) -> DataFrame:
    """Longest runs of characters of a text that lie in stretches of at least
    ``min_chars`` which also stand under another id.

    Returns (source_id string, start_char long, end_char long), end exclusive.
    Anchors with more than ``pair_limit`` occurrences go the way without pairs;
    the result is the same for every limit, and for every number of bits that windows are hashed to.
    """
    if min_chars < 2:
        raise ValueError("min_chars must be at least 2")
    k = max(1, min_chars // 2 - 4)
    w = min_chars - k + 1
    side = min_chars - k
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= min_chars))
    docs = docs.select("id", F.xxhash64("id").alias("k1"), F.hash("id").alias("k2"), "text")
    anchors = stage(docs.select("k1", "k2", "text").mapInArrow(_anchor_batches(k, w), "k1 long, k2 int, h array<long>, pos array<long>"), "anchors")
    flat = anchors.select("k1", "k2", F.arrays_zip("h", "pos").alias("a")).select("k1", "k2", F.explode("a").alias("a")).select("k1", "k2", F.col("a.h").alias("h"), F.col("a.pos").alias("pos"))
    shared = flat.groupBy("h").agg(F.min("k1").alias("mn"), F.max("k1").alias("mx"), F.count("*").alias("n")).where("mn <> mx")
    shared = stage(shared.select("h", (F.col("n") > pair_limit).alias("hot"), "n"), "shared")
    marks = join_counted(flat, shared, ["h"], "n", by=["k1", "pos"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "pos", "hot")).alias("marks"))
    contexts = stage(docs.join(marks, ["k1", "k2"]).select("id", "k1", "text", "marks").mapInArrow(_context_batches(k, side), CONTEXT_DDL), "contexts")

    cold = contexts.where("not hot").repartition("h").sortWithinPartitions("h").mapInArrow(_pair_batches(k, side, min_chars), "id string, s long, e long")

    merged = merge_spans(cold.unionByName(_hot_spans(contexts.where("hot"), k, min_chars, hash_bits)))
    return merged.select(F.col("id").alias("source_id"), F.col("s").alias("start_char"), F.col("e").alias("end_char"))


def shared_summary(df: DataFrame, id_col: str = "id", text_col: str = "text", min_chars: int = 200) -> DataFrame:
    """Per id with a shared stretch: characters, shared characters, their share and the number of runs."""
    spans = shared_spans(df, id_col, text_col, min_chars).groupBy("source_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"), F.count("*").alias("runs"))
    lengths = df.groupBy(F.col(id_col).cast("string").alias("source_id")).agg(F.max(F.length(text_col)).cast("long").alias("n_chars"))
    return spans.join(lengths, "source_id").select("source_id", "n_chars", "shared_chars", "runs", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("shared_share"))
