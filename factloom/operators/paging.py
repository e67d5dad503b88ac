"""Pages and budgets.  A budget is worked off in order, so an ordered fold reads what the budget can hold and no more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ordering import join_hot, number_within
from factloom.runtime import stage

ITEM_BYTES, PAGE_BYTES, PROJECTION_BYTES = 48 * 1024, 56 * 1024, 54 * 1024


def page(items: DataFrame, group: str, order: str, size: str, start: int = 0, limit: int = 20, used: int = 0, item_bytes: int = ITEM_BYTES, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """group, order, index, state of one page of each group: SENT, or OMITTED for items above ``item_bytes``.

    The page ends before the first item that it has no room for; items are numbered by ``order`` from 0.
    """
    w = Window.partitionBy(group).orderBy(order)
    # the bound on row_number() is what Spark pushes below the shuffle, so a group of any size sends start + limit rows a task
    rows = items.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= start + limit) & (F.col("_n") > start)).withColumn("index", F.col("_n") - 1).drop("_n")
    fits = F.col(size) <= item_bytes
    total = F.sum(F.when(fits, F.col(size)).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + used
    rows = rows.withColumn("_total", total)
    full = F.max((fits & (F.col("_total") > page_bytes)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_full", full).where("_full = 0").select(group, order, "index", F.when(fits, "SENT").otherwise("OMITTED").alias("state"))


BLOCK, ROUND = 4096, 8192


def _next_page(sizes: list[int], at: int, limit: int, item_bytes: int, page_bytes: int) -> int:
    """Where the page after the one that begins at ``at`` begins; the end of ``sizes``, if they end before."""
    used = sizes[at] if sizes[at] <= item_bytes else 0
    for j in range(at + 1, min(at + limit, len(sizes))):
        if sizes[j] <= item_bytes:
            used += sizes[j]
            if used > page_bytes:
                return j
    return min(at + limit, len(sizes))


def pages(items: DataFrame, group: str, order: str, size: str, limit: int = 20, item_bytes: int = ITEM_BYTES, page_bytes: int = PAGE_BYTES, block: int = BLOCK) -> DataFrame:
    """All pages of each group, read one after the other: group, order, page, state.

    A group is cut into blocks of items.  For each place where a page of the block before may end (fewer than ``limit``),
    a block says where its own last page ends and how many it begins; these few numbers are followed from block to
    block in order, after which the blocks are divided into pages by themselves.
    """
    if block < limit:
        raise ValueError("a block holds a page at least")
    kind, g = items.schema[order].dataType.simpleString(), items.schema[group].dataType.simpleString()
    rows = items.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    rows = number_within(rows, ["g"], ["o"], "no").withColumn("b", F.floor(F.col("no") / block))
    rows = stage(rows, "items")

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        sizes, first = pdf["s"].fillna(0).astype(int).tolist(), int(pdf["no"].iloc[0])
        after: dict[int, tuple[int, int]] = {}
        b = int(pdf["no"].iloc[0] // block)
        exits, counts = [], []
        for entry in range(limit if b else 1):
            path, at = [], entry
            while at < min(block, len(sizes)) and at not in after:
                path.append(at)
                at = _next_page(sizes, at, limit, item_bytes, page_bytes)
            end, n = after.get(at, (at - block, 0))
            for p in reversed(path):
                n += 1
                after[p] = end, n
            exits.append(end)
            counts.append(n)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "b": [first // block], "exits": [exits], "counts": [counts]})

    near = F.when((F.col("b") > 0) & (F.col("no") % block < limit), F.col("b") - 1)
    seen = rows.withColumn("w", F.explode(F.array_compact(F.array("b", near))))
    tables = seen.groupBy("g", "w").applyInPandas(transfer, f"g {g}, b long, exits array<long>, counts array<long>")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of, entry, page = None, 0, 0
        for batch in batches:
            out = []
            for key, b, exits, counts in zip(*(batch.column(c).to_pylist() for c in ("g", "b", "exits", "counts"))):
                if not b or key != group_of:
                    group_of, entry, page = key, 0, 0
                out.append((entry, page))
                if entry >= 0:
                    entry, page = exits[entry], page + counts[entry]
            cols = list(zip(*out)) if out else [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("b"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["g", "b", "entry", "page"])

    starts = tables.repartition("g").sortWithinPartitions("g", "b").mapInArrow(follow, f"g {g}, b long, entry long, page long")

    def divide(mine: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("no")
        sizes = mine["s"].fillna(0).astype(int).tolist()
        at, page = int(start["entry"].iloc[0]), int(start["page"].iloc[0])
        numbers = [page - 1] * min(at, len(sizes)) if at >= 0 else [page - 1] * len(sizes)
        while 0 <= at < len(sizes):
            to = _next_page(sizes, at, limit, item_bytes, page_bytes)
            numbers += [page] * (to - at)
            at, page = to, page + 1
        return pd.DataFrame({group: mine["g"], order: mine["o"], "page": numbers, "state": ["SENT" if x <= item_bytes else "OMITTED" for x in sizes]})

    return rows.groupBy("g", "b").cogroup(starts.groupBy("g", "b")).applyInPandas(divide, f"{group} {g}, {order} {kind}, page long, state string")


def skip_fit(items: DataFrame, group: str, order: list[str], size: str, budget: int = PROJECTION_BYTES, at_once: int = ROUND) -> DataFrame:
    """Items taken in order as long as they fit; one that does not is passed over and smaller ones may follow.

    Rounds: each takes the next ``at_once`` items of a group that could still fit, and folds those; what is too large for
    the room left is never looked at again.  Items without size are not taken, empty ones always.
    """
    key = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n"))
    rows = stage(number_within(items.withColumn("_g", key), ["_g"], order, "_no"), "items")
    some = rows.where(F.col(size) > 0).select("_g", "_no", F.col(size).cast("long").alias("_s"))
    state = some.select("_g").distinct().select("_g", F.lit(budget).cast("long").alias("room"), F.lit(-1).cast("long").alias("after"))
    taken = None

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_no")
        room, kept = int(pdf["room"].iloc[0]), []
        for no, s in zip(pdf["_no"], pdf["_s"]):
            if s <= room:
                room -= s
                kept.append(int(no))
        return pd.DataFrame({"_g": pdf["_g"].iloc[:1], "room": [room], "after": [int(pdf["_no"].iloc[-1])], "kept": [kept]})

    while True:
        open_ = join_hot(some, state, ["_g"], by=["_no"]).where((F.col("_no") > F.col("after")) & (F.col("_s") <= F.col("room")))
        nearest = open_.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy("_no"))).where(F.col("_n") <= at_once).drop("_n", "after")
        done = stage(nearest.groupBy("_g").applyInPandas(fold, "_g string, room long, after long, kept array<long>"), "fitted")
        if not done.limit(1).count():
            break
        kept = done.select("_g", F.explode("kept").alias("_no"))
        taken = kept if taken is None else taken.unionByName(kept)
        state = done.drop("kept")
    empty = rows.where(F.col(size) == 0)
    if taken is None:
        return empty.drop("_g", "_no")
    return rows.join(taken, ["_g", "_no"], "left_semi").unionByName(empty).drop("_g", "_no")


def byte_ranges(df: DataFrame, key: str, text: str, part: int) -> DataFrame:
    """(key, part, start_byte, end_byte) of texts in parts of at most ``part`` bytes that end with whole characters."""
    raw = F.encode(F.col(text), "UTF-8")
    cont = lambda at: F.hex(raw.substr(at + 1, F.lit(1))).rlike("^[89AB]")
    n = F.octet_length(text)
    cut = lambda at: F.when(at >= n, n).when(~cont(at), at).when(~cont(at - 1), at - 1).when(~cont(at - 2), at - 2).otherwise(at - 3)
    begin = F.aggregate(F.sequence(F.lit(1), F.ceil(n / F.lit(part - 3)).cast("int")), F.array(F.lit(0)), lambda acc, _: F.when(F.element_at(acc, -1) >= n, acc).otherwise(F.concat(acc, F.array(cut(F.element_at(acc, -1) + part).cast("int")))))
    rows = df.where(n > 0).select(key, begin.alias("b"))
    return rows.select(key, "b", F.explode(F.sequence(F.lit(1), F.size("b") - 1)).alias("part")).select(key, F.col("part"), F.element_at("b", F.col("part")).alias("start_byte"), F.element_at("b", F.col("part") + 1).alias("end_byte"))
