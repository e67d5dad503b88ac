"""Parent-child rows to full hierarchies: cycles, roots, depths, paths and descendants.

All loops double the distance they look, so a chain of n rows takes log2(n)
rounds; each round is a join on a key that is unique on one side and an
aggregate with map-side combine, and ends in a table in the shared folder, which
takes the place of the one before.  Rows that have arrived leave the join, and a
row that many others wait for (the root of a tree may be that of a third of all
rows) is sent to several tasks.

1. ``separate``: rows whose 2**k-th ancestor exists are followed until what is
   reached maps onto itself one to one; those are the rows on rings.
2. ``decompose``: with the rings cut, subtree sizes, depths and roots come from
   doubling; the child with the largest subtree continues its parent's chain
   (heavy path); chains form a forest of depth log2(n) at most, along which
   segments are concatenated and offsets are summed so that the descendants of a
   row are one interval of positions in its tree.
3. ``paths`` concatenates what the segments hold, ``descendants`` looks the
   intervals up.

Defined results: null ids are ignored; ids and parents are compared without
letter case, outer white space and the given prefixes; of repeated ids the row
loaded last counts; null, empty and unknown parents make a root; an empty table
gives empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ordering import HOT_LEAST, join_counted, latest
from factloom.runtime import restage, stage

SALT, BLOCK = 64, 1024
PREFIXES = ("publication:", "context:")


def spelled(c: Column | str, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """The id that a reference means."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    text = F.regexp_replace(text, "^(" + "|".join(prefixes) + r")\s*", "") if prefixes else text
    return F.nullif(text, F.lit(""))


def nodes(df: DataFrame, kind: str, id_col: str, parent_col: str, loaded_col: str | None = None) -> DataFrame:
    """(kind, key, id, pkey): one row per id that is meant."""
    loaded = F.col(loaded_col) if loaded_col else F.lit(0)
    rows = df.select(F.lit(kind).alias("kind"), spelled(F.col(id_col).cast("string")).alias("key"), F.col(id_col).cast("string").alias("id"), spelled(F.col(parent_col).cast("string")).alias("pkey"), loaded.alias("loaded"))
    return latest(rows, "key", "loaded").select("kind", "key", "id", "pkey")


def link(rows: DataFrame) -> DataFrame:
    """(v, up, kind, id, orphan): rows numbered, with the number of their parent if there is one."""
    own = stage(rows.withColumn("v", F.monotonically_increasing_id()), "nodes")
    up = own.select(F.col("kind").alias("k2"), F.col("key").alias("key2"), F.col("v").alias("up"))
    joined = own.join(up, (F.col("kind") == F.col("k2")) & (F.col("pkey") == F.col("key2")), "left")
    return stage(joined.select("v", "up", "kind", "id", (F.col("pkey").isNotNull() & F.col("up").isNull()).alias("orphan")), "links")


def separate(links: DataFrame) -> DataFrame:
    """(v, kind, id, cycle_key): the rows on rings, with the least id of their ring."""
    edge = links.where("up is not null").select("v", "up")
    live, on_ring = edge, None
    count, top = _crowd(live)
    while count:
        # L(k+1): v whose 2**(k+1)-th ancestor exists
        live = restage(_ahead(live, live.select("v", F.col("up").alias("far")), top).select("v", F.col("far").alias("up")), live, "live")
        now, top = _crowd(live)
        if now == count:
            reached = stage(live.select(F.col("up").alias("v")).distinct(), "reached")
            parents = edge.join(reached, "v").select(F.col("up").alias("v")).distinct()
            if parents.join(reached, "v").count() == reached.count():
                on_ring = reached
                break
        count = now
    if on_ring is None:
        return links.where("false").select("v", "kind", "id", F.col("id").alias("cycle_key"))
    ring = stage(links.join(on_ring, "v").select("v", "up", "kind", "id", F.col("id").alias("least")), "ring")
    while True:  # on a ring each row has one before it, so no key is hot
        ahead = ring.select(F.col("v").alias("mid"), F.col("up").alias("far"), F.col("least").alias("other"))
        ring = restage(ring.join(ahead, ring["up"] == ahead["mid"]).select("v", F.col("far").alias("up"), "kind", "id", F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")), ring, "ring")
        if not ring.where("moved").limit(1).count():
            return ring.select("v", "kind", "id", F.col("least").alias("cycle_key"))


def _crowd(waiting: DataFrame) -> tuple[int, int]:
    """How many rows wait, and how many at most for the same one (up)."""
    total, top = waiting.groupBy("up").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    return total or 0, top or 0


def _ahead(waiting: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """``waiting`` (v, up, ...) with the columns of that one of ``rows`` (v, ...) that is its ``up``."""
    rows = rows.withColumnRenamed("v", "up")
    counts = waiting.groupBy("up").agg(F.count("*").alias("n"))
    return _meet(waiting, rows, ["up"], counts, ["v"], top)


def _meet(many: DataFrame, few: DataFrame, on: list[str], counts: DataFrame, by: list[str], top: int) -> DataFrame:
    """A join with one row per key; keys are counted and spread only where some key may have HOT_LEAST rows (``top``)."""
    if top < HOT_LEAST:
        return many.join(few, on)
    return join_counted(many, stage(counts.join(few, on), "counted"), on, "n", by=by, least=HOT_LEAST).drop("n")


def _double(state: DataFrame, combine: dict[str, Column]) -> DataFrame:
    """Doubles (v, up, ...) until no ``up`` is left.

    ``combine`` gives the new value of a column from its own and the one at ``up`` (prefix ``o_``).
    """
    while True:
        waiting = state.where("up is not null")
        count, top = _crowd(waiting)
        if not count:
            return state
        other = state.select("v", F.col("up").alias("o_up"), *[F.col(c).alias("o_" + c) for c in combine])
        moved = _ahead(waiting, other, top).select("v", F.col("o_up").alias("up"), *[e.alias(c) for c, e in combine.items()])
        state = restage(state.where("up is null").select("v", "up", *combine).unionByName(moved), state, "double")


def decompose(links: DataFrame, rings: DataFrame) -> DataFrame:
    """One row per node:

    v, kind, id, orphan, parent (number or null), depth, root, size (of the
    subtree, itself included), chain (its head), at (place in the chain), pos
    (place in the tree, root 0; descendants are pos + 1 .. pos + size - 1),
    segments (array of (chain, upto) from the root down: the path) and
    cycle_key (of rows on rings, which count as roots here).
    """
    tree = links.join(rings.select("v", "cycle_key"), "v", "left").withColumn("parent", F.when(F.col("cycle_key").isNull(), F.col("up"))).drop("up")
    tree = stage(tree, "tree")
    # depth, root and size; up(v) is the 2**k-th ancestor in round k
    state = tree.select("v", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("v").alias("root"), F.lit(1).cast("long").alias("size"))
    while True:
        count, top = _crowd(state.where("up is not null"))
        if not count:
            break
        gain = state.where("up is not null").groupBy(F.col("up").alias("v")).agg(F.sum("size").alias("gain"))
        sized = state.join(gain, "v", "left").select("v", "up", "depth", "root", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        above = state.select("v", F.col("up").alias("a_up"), F.col("depth").alias("a_depth"), F.col("root").alias("a_root"))
        moved = _ahead(sized.where("up is not null"), above, top)
        moved = moved.select("v", F.col("a_up").alias("up"), (F.col("depth") + F.col("a_depth")).alias("depth"), F.col("a_root").alias("root"), "size")
        state = restage(sized.where("up is null").unionByName(moved), state, "sizes")
    tree = stage(tree.join(state.drop("up"), "v"), "sized")
    top = _largest(tree)  # no parent has more children, no chain more rows and no root more below it

    heavy = tree.where("parent is not null").groupBy("parent").agg(F.max(F.struct(F.col("size"), (-F.col("v")).alias("no"))).alias("h"))
    heavy = heavy.select("parent", (-F.col("h.no")).alias("heavy"), F.col("h.size").alias("heavy_size"))
    below = tree.where("parent is not null").select("v", "parent", "size")
    kids = stage(_meet(below, heavy, ["parent"], _count(below, "parent"), ["v"], top), "kids")
    follows = kids.where("heavy = v").select("v", F.col("parent").alias("up"))
    steps = stage(tree.select("v").join(follows, "v", "left").select("v", "up", F.col("v").alias("chain")), "steps")
    chains = _double(steps, {"chain": F.col("o_chain")})
    tops = tree.select(F.col("v").alias("chain"), F.col("depth").alias("top_depth"))
    sizes = _count(chains, "chain")
    placed = _meet(tree.join(chains.select("v", "chain"), "v"), tops, ["chain"], sizes, ["v"], top)
    placed = stage(placed.withColumn("at", F.col("depth") - F.col("top_depth")).drop("top_depth"), "placed")

    # offsets of light children: a salted running sum over the children of a parent
    light = kids.where("heavy <> v").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)))
    per = light.groupBy("parent", "salt").agg(F.sum("size").alias("s"))
    over = Window.partitionBy("parent").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("parent", "salt", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("base"))
    inner = Window.partitionBy("parent", "salt").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    light = light.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(per, ["parent", "salt"])
    light = light.select("v", F.col("parent").alias("p"), (1 + F.col("heavy_size") + F.col("base") + F.col("within")).alias("skip"))
    hook = placed.select(F.col("v").alias("p"), F.col("chain").alias("up"), F.col("at").alias("p_at"))
    segment = F.array(F.struct(F.col("up").alias("chain"), F.col("p_at").alias("upto")))
    none = placed.where("v = chain and parent is null").select("v", F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("start"), F.expr("cast(array() as array<struct<chain:bigint,upto:bigint>>)").alias("segments"))
    hung = _meet(light, hook, ["p"], _count(light, "p"), ["v"], top).select("v", "up", (F.col("skip") + F.col("p_at")).alias("start"), segment.alias("segments"))
    hung = _double(stage(none.unionByName(hung), "chains"), {"start": F.col("start") + F.col("o_start"), "segments": F.concat("o_segments", "segments")})
    hung = hung.select(F.col("v").alias("chain"), "start", "segments")
    own = F.array(F.struct(F.col("chain").alias("chain"), F.col("at").alias("upto")))
    return stage(_meet(placed, hung, ["chain"], sizes, ["v"], top).select("v", "kind", "id", "orphan", "parent", "depth", "root", "size", "chain", "at", (F.col("start") + F.col("at")).alias("pos"), F.concat("segments", own).alias("segments"), "cycle_key"), "hierarchy")


def _count(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def _largest(tree: DataFrame) -> int:
    return tree.agg(F.max("size")).first()[0] or 0


def paths(full: DataFrame, block: int = BLOCK) -> DataFrame:
    """(v, path): ids from the root down, joined by /.

    Chains are cut into blocks of ids, so the path of a row is put together from one part for each block of each of its
    segments, of which there are log2(n) at most.
    """
    at = full.select("chain", F.floor(F.col("at") / block).alias("part"), F.struct("at", "id").alias("x"))
    ids = at.groupBy("chain", "part").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]).alias("ids"))
    need = full.select("v", F.posexplode("segments").alias("no", "s")).select("v", "no", F.col("s.chain").alias("chain"), F.col("s.upto").alias("upto"))
    need = need.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("upto") / block))))
    met = _meet(need, ids, ["chain", "part"], need.groupBy("chain", "part").agg(F.count("*").alias("n")), ["v"], _largest(full))
    piece = F.slice("ids", 1, F.least(F.lit(block), F.col("upto") - F.col("part") * block + 1).cast("int"))
    parts = met.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("no", "part", F.array_join(piece, "/").alias("text")))).alias("parts"))
    return parts.select("v", F.array_join(F.transform("parts", lambda x: x["text"]), "/").alias("path"))


def descendants(full: DataFrame, asked: Column, block: int = BLOCK) -> DataFrame:
    """(kind, node_id, descendant_id, distance) of the rows for which ``asked`` is true.

    The places of a tree are cut into blocks, so an interval meets those blocks that it covers and no others.
    """
    here = full.select("root", F.floor(F.col("pos") / block).alias("part"), "pos", F.col("id").alias("descendant_id"), F.col("depth").alias("below"))
    top = full.where(asked & (F.col("size") > 1)).select("root", "kind", F.col("id").alias("node_id"), "depth", (F.col("pos") + 1).alias("lo"), (F.col("pos") + F.col("size") - 1).alias("hi"))
    top = top.withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
    met = here.join(top, ["root", "part"]).where("pos between lo and hi")
    return met.select("kind", "node_id", "descendant_id", (F.col("below") - F.col("depth")).alias("distance"))


def report(full: DataFrame) -> DataFrame:
    """Readable form: record_kind, node_id, parent_id, root_id, depth, path (ids from the root, joined by /),
    n_descendants, tree position, and status: TREE, ORPHAN_ROOT, ON_CYCLE or LEADS_TO_CYCLE."""
    top = _largest(full)
    up = full.select(F.col("v").alias("parent"), F.col("id").alias("parent_id"))
    root = full.where("parent is null").select("root", F.col("id").alias("root_id"), F.col("cycle_key").alias("root_cycle"))
    status = F.when(F.col("cycle_key").isNotNull(), "ON_CYCLE").when(F.col("root_cycle").isNotNull(), "LEADS_TO_CYCLE").when(F.col("orphan"), "ORPHAN_ROOT").otherwise("TREE")
    rows = full.drop("segments", "chain", "at")
    below = rows.where("parent is not null")
    under = _meet(below, up, ["parent"], _count(below, "parent"), ["v"], top)
    rows = under.unionByName(rows.where("parent is null").withColumn("parent_id", F.lit(None).cast("string")))
    out = _meet(rows, root, ["root"], _count(full, "root"), ["v"], top).join(paths(full), "v")
    return out.select(F.col("kind").alias("record_kind"), F.col("id").alias("node_id"), "parent_id", "root_id", "depth", "path", (F.col("size") - 1).alias("n_descendants"), F.col("pos").alias("tree_pos"), status.alias("status"))
