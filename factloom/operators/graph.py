"""Traversal of edge tables: frontier loops whose rounds are joins, each ending in a table in the shared folder."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ordering import join_hot
from factloom.runtime import stage

DEPTH, NODES, EDGES = 32, 4096, 8192
#: After so many rounds what they added is written as one table.
ROUNDS = 8


def bfs(edges: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node, depth): the least number of edges from any root, as far as ``depth``.

    The edges are written once, as every round reads them.
    """
    edges = stage(edges.where("source is not null and target is not null").select("source", "target"), "edges")
    seen = stage(roots.select(F.col("node"), F.lit(0).alias("depth")).distinct(), "seen")
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges.select(F.col("source").alias("node"), "target"), "node").select(F.col("target").alias("node")).where("node is not null").distinct()
        front = stage(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "front")
        if not front.limit(1).count():
            break
        seen = stage(seen.unionByName(front), "seen") if d % ROUNDS == 0 else seen.unionByName(front)
    return seen


def slice_from(edges: DataFrame, root: str, depth: int = DEPTH, nodes: int = NODES, max_edges: int = EDGES) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges reached from one root within the limits, in order of depth and key.

    Nodes: (node, depth, position); edges: (source, target, status) with RESOLVED or
    BOUNDARY (its target is null, unknown or beyond a limit).
    """
    spark = edges.sparkSession
    found = bfs(edges, spark.createDataFrame([(root,)], "node string"), depth)
    near = found.orderBy("depth", "node").limit(nodes)
    near = stage(near.withColumn("position", F.row_number().over(Window.orderBy("depth", "node"))), "slice")
    inside = near.select(F.col("node").alias("t"))
    out = edges.join(near.select(F.col("node").alias("source"), "position"), "source").join(inside, F.col("target") == F.col("t"), "left")
    out = out.withColumn("status", F.when(F.col("t").isNull(), "BOUNDARY").otherwise("RESOLVED"))
    return near, out.orderBy("position", "target").limit(max_edges).select("source", "target", "status")


def linked(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """(source, target, status, linked): calls (source, target, name) LINKED to the one declaration (name, declaration) of their
    name; AMBIGUOUS for several, UNRESOLVED for none."""
    n = declarations.groupBy("name").agg(F.count_distinct("declaration").alias("n"), F.min("declaration").alias("one"))
    out = join_hot(calls, n, ["name"], "left")
    status = F.when(F.col("n").isNull(), "UNRESOLVED").when(F.col("n") == 1, "LINKED").otherwise("AMBIGUOUS")
    return out.select("source", "target", status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("linked"))


def reverse_closure(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, depth): what depends on changed nodes, themselves included, without a limit.

    Rounds follow the longest chain of first reaches; the visited set only grows, so cycles end.
    """
    return bfs(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), changed, depth=2**31 - 1)


def plan_update(parent: DataFrame, current: DataFrame, edges: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, reason): CHANGED files of two digest tables and those INVALIDATED through what they depend on.

    ``edges``: source depends on target.  No rows: unchanged.
    """
    b, c = parent.select(F.col(path).alias("node"), F.col(digest).alias("old")), current.select(F.col(path).alias("node"), F.col(digest).alias("new"))
    changed = stage(b.join(c, "node", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("node"), "changed")
    out = reverse_closure(edges, changed)
    return out.select(F.col("node").alias(path), F.when(F.col("depth") == 0, "CHANGED").otherwise("INVALIDATED").alias("reason"))


def outcome_masks(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, mask): for each node the bits of the outcomes (node, bit) it can reach."""
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))).alias("mask")
    log = front = stage(seeds.groupBy("node").agg(bits), "mask")
    back = stage(edges.select("source", "target").distinct(), "edges").select(F.col("target").alias("node"), F.col("source").alias("caller"))
    zero = F.lit(0).cast("long")
    for k in itertools.count(1):
        came = front.join(back, "node").select(F.col("caller").alias("node"), F.col("mask").alias("more"), zero.alias("mask"))
        both = came.unionByName(log.select("node", zero.alias("more"), "mask")).groupBy("node").agg(F.bit_or("more").alias("more"), F.bit_or("mask").alias("mask"))
        front = stage(both.where(F.col("more").bitwiseAND(F.bitwise_not("mask")) != 0).select("node", F.col("more").bitwiseOR(F.col("mask")).alias("mask")), "front")
        if not front.limit(1).count():
            return log.groupBy("node").agg(F.bit_or("mask").alias("mask"))
        log = log.unionByName(front)
        if k % ROUNDS == 0:
            log = stage(log.groupBy("node").agg(F.bit_or("mask").alias("mask")), "mask")


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest chain before a node; level is null for nodes on or behind a cycle.

    A node is due once as many of its edges have come from placed nodes as lead to it; a round reads the edges of the
    nodes placed last, and only the counts of what these lead to.
    """
    links = stage(edges.where("source is not null and target is not null").select("source", "target").distinct(), "edges")
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).where("node is not null").distinct()
    wanted = stage(nodes.join(links.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("want")), "node", "left").select("node", F.coalesce("want", F.lit(0)).alias("want")), "nodes")
    front = stage(wanted.where("want = 0").select("node", F.lit(0).alias("level")), "level")
    done, came = front, None
    for level in itertools.count(1):
        now = front.join(links, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"))
        now = stage(now, "came")
        if not now.limit(1).count():
            break
        came = now if came is None else came.unionByName(now)
        if level % ROUNDS == 0:
            came = stage(came.groupBy("node").agg(F.sum("n").alias("n")), "came")
        due = came.join(now.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("n").alias("n")).join(wanted, "node").where("n = want")
        front = stage(due.select("node", F.lit(level).alias("level")), "level")
        done = done.unionByName(front)
    return wanted.select("node").join(done, "node", "left")


def components_mutual(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their least node.

    Forward-backward colouring: each node takes the least node that reaches it;
    within a colour, what reaches the colour's own node is its component; the
    rest goes round again.
    """
    nodes = stage(edges.select(F.col("source").alias("node")).union(edges.select("target")).where("node is not null").distinct(), "nodes")
    live = stage(edges.where("source is not null and target is not null").select("source", "target").distinct(), "edges")
    out = None
    while nodes.limit(1).count():
        color = stage(nodes.withColumn("color", F.col("node")), "color")
        while True:
            came = live.join(color.select(F.col("node").alias("source"), "color"), "source").groupBy(F.col("target").alias("node")).agg(F.min("color").alias("other"))
            nxt = stage(color.join(came, "node", "left").select("node", F.least("color", "other").alias("color"), (F.col("other") < F.col("color")).alias("moved")), "color")
            color = nxt.select("node", "color")
            if not nxt.where("moved").limit(1).count():
                break
        same = live.join(color.select(F.col("node").alias("source"), F.col("color").alias("cs")), "source").join(color.select(F.col("node").alias("target"), F.col("color").alias("ct")), "target").where("cs = ct").select("source", "target")
        same = stage(same, "same")
        own = bfs(same.select(F.col("target").alias("source"), F.col("source").alias("target")), color.where("node = color").select("node"), depth=2**31 - 1).select("node")
        part = stage(color.join(own, "node").select("node", F.col("color").alias("component")), "component")
        out = part if out is None else out.unionByName(part)
        nodes = stage(nodes.join(part.select("node"), "node", "left_anti"), "nodes")
        gone = part.select("node")
        live = stage(same.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti"), "edges")
    return out if out is not None else nodes.withColumn("component", F.col("node"))


def path_claims(support: DataFrame, edges: DataFrame, claim: str = "claim") -> DataFrame:
    """(claim, valid): whether claimed references (claim, pos, edge, subject, object) are edges that follow each other from subject to object."""
    w = Window.partitionBy(claim).orderBy("pos")
    rows = support.join(edges.select(F.col("edge").alias("e"), "source", "target"), F.col("edge") == F.col("e"), "left")
    rows = rows.withColumn("next", F.lead("source").over(w)).withColumn("first", F.row_number().over(w) == 1).withColumn("last", F.lead("pos").over(w).isNull())
    ok = F.col("e").isNotNull() & (F.col("last") | F.col("next").eqNullSafe(F.col("target"))) & (~F.col("first") | F.col("source").eqNullSafe(F.col("subject"))) & (~F.col("last") | F.col("target").eqNullSafe(F.col("object")))
    return rows.groupBy(claim).agg((F.min(ok.cast("int")) == 1).alias("valid"))


def local_order(nodes: pd.DataFrame, edges: pd.DataFrame, before: int, after: int) -> tuple[bool | None, bool | None, str | None]:
    """(may reach, strictly dominates, reason for neither) in one control-flow graph without its dead parts.

    nodes: node, role; edges: source, target, kind.  One graph is a callable body, so it fits a task.
    """
    active = set(nodes.loc[nodes["role"] != "DEAD", "node"])
    if before not in active or after not in active:
        return None, None, "LOCAL_CFG_NODE_MISSING_OR_DEAD"
    entry = nodes.loc[nodes["role"] == "ENTRY", "node"].iloc[0]
    to: dict = {}
    for s, t, k in zip(edges["source"], edges["target"], edges["kind"]):
        if k != "DEAD" and s in active and t in active:
            to.setdefault(s, []).append(t)

    def reaches(a, b, without=None) -> bool:
        todo, seen = [a] if a != without else [], {a}
        while todo:
            x = todo.pop()
            if x == b:
                return True
            for y in to.get(x, ()):
                if y not in seen and y != without:
                    seen.add(y)
                    todo.append(y)
        return False

    if not reaches(entry, before) or not reaches(entry, after):
        return None, None, "LOCAL_CFG_NODE_NOT_ACTIVE_REACHABLE"
    return reaches(before, after), before != after and not reaches(entry, after, before), None


def back_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Back edges of a depth-first walk of one graph in order of its edges (``applyInPandas``; columns graph, source, target, ordinal)."""
    to: dict = {}
    for r in pdf.sort_values(["source", "ordinal"]).itertuples():
        to.setdefault(r.source, []).append((r.target, r.ordinal))
    active, done, out = set(), set(), []
    for root in sorted(to):
        if root in done:
            continue
        stack = [(root, iter(to.get(root, ())))]
        active.add(root)
        while stack:
            node, it = stack[-1]
            for target, ordinal in it:
                if target in active:
                    out.append((node, target, ordinal))
                elif target not in done:
                    active.add(target)
                    stack.append((target, iter(to.get(target, ()))))
                    break
            else:
                stack.pop()
                active.discard(node)
                done.add(node)
    return pd.DataFrame([(pdf["graph"].iloc[0], *x) for x in out], columns=["graph", "source", "target", "ordinal"])


def reachable_objects(objects: DataFrame, refs: DataFrame, roots: DataFrame) -> DataFrame:
    """(digest, state): LIVE objects, DEAD ones, and DANGLING references to none; objects: digest, refs: source, target."""
    live = bfs(refs, roots.select(F.col("digest").alias("node")), depth=2**31 - 1).select(F.col("node").alias("digest"))
    known = objects.select("digest").distinct()
    return (
        known.join(live, "digest", "left_semi").withColumn("state", F.lit("LIVE"))
        .unionByName(known.join(live, "digest", "left_anti").withColumn("state", F.lit("DEAD")))
        .unionByName(live.join(known, "digest", "left_anti").withColumn("state", F.lit("DANGLING")))
    )
