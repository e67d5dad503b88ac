"""Calls, arguments and values inside callable bodies; one body fits a task, bodies are spread over tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXTS, NODES = 128, 4096


def bind_arguments(calls: DataFrame, formals: DataFrame) -> DataFrame:
    """(call, slot, argument, formal, status) for calls (call, target, arguments) and formals (target, slot, formal).

    BOUND, or MISSING_ARGUMENT and EXTRA_ARGUMENT where the numbers differ, or TARGET_UNKNOWN.
    """
    actual = calls.select("call", "target", F.posexplode_outer("arguments").alias("slot", "argument"))
    known = formals.select("target").distinct().withColumn("known", F.lit(True))
    want = calls.select("call", "target").join(formals, "target").select("call", "slot", "formal")
    both = actual.where("slot is not null").select("call", "slot", "argument").join(want, ["call", "slot"], "full_outer")
    rows = both.join(calls.select("call", "target").join(known, "target", "left"), "call")
    status = F.when(F.col("known").isNull(), "TARGET_UNKNOWN").when(F.col("formal").isNull(), "EXTRA_ARGUMENT").when(F.col("argument").isNull(), "MISSING_ARGUMENT").otherwise("BOUND")
    return rows.select("call", "slot", "argument", "formal", status.alias("status"))


def inline_calls(functions: dict[str, dict], owner: str, contexts: int = CONTEXTS, nodes: int = NODES) -> dict[str, tuple[str, list[str], list[str]]]:
    """Equations of a function with the bodies of exact callees put in, a context per call chain.

    functions: owner -> {"nodes": {id: (op, operands, guards)}, "parameters": [id], "calls": {definition: (target, [argument])}}.
    A result is the node ``result``.  Recursive calls, unknown targets and spent budgets stay UNKNOWN.
    """
    out: dict[str, tuple[str, list[str], list[str]]] = {}
    todo: list[tuple[str, str, tuple[str, ...], dict[str, str]]] = [("", owner, (owner,), {})]
    used = 0
    while todo:
        prefix, name, chain, actual = todo.pop(0)
        body = functions[name]
        at = lambda i, prefix=prefix: prefix + i
        for i, (op, operands, guards) in sorted(body["nodes"].items()):
            if len(out) >= nodes:
                out[at(i)] = ("UNKNOWN", [], [])
                continue
            if i in actual:
                out[at(i)] = ("COPY", [actual[i]], [])
            elif i in body["calls"]:
                target, arguments = body["calls"][i]
                callee = functions.get(target)
                if callee is None or target in chain or used == contexts or len(callee["parameters"]) != len(arguments):
                    out[at(i)] = ("UNKNOWN", [], [])
                else:
                    used += 1
                    inner = f"{at(i)}/"
                    out[at(i)] = ("COPY", [inner + "result"], [])
                    todo.append((inner, target, (*chain, target), {p: at(a) for p, a in zip(callee["parameters"], arguments)}))
            else:
                out[at(i)] = (op, [at(x) for x in operands], [at(x) for x in guards])
    return out


def join_paths(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Storages after several paths meet: (keys, storage, kind, alternatives).

    ``paths``: keys, path, storage, definition, guards; ended paths are left out before.  SAME where all paths
    agree (a storage that a path lacks counts as another value), else CHOICE of (guards, definition).
    """
    n = paths.groupBy(*keys).agg(F.count_distinct("path").alias("n_paths"))
    per = paths.groupBy(*keys, "storage").agg(F.count_distinct("path").alias("having"), F.count_distinct("definition").alias("values"), F.min("definition").alias("one"), F.array_sort(F.collect_set(F.struct("path", "guards", "definition"))).alias("alternatives"))
    out = per.join(n, keys)
    same = (F.col("values") == 1) & (F.col("having") == F.col("n_paths"))
    return out.select(*keys, "storage", F.when(same, "SAME").otherwise("CHOICE").alias("kind"), F.when(same, F.col("one")).alias("definition"), F.when(~same, F.col("alternatives")).alias("alternatives"))


def outline(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nesting of the intervals of one owner (``applyInPandas``; owner, id, first, last): id, parent, depth, ordinal.

    The parent is the smallest interval around; intervals that cut each other are siblings.
    """
    rows = pdf.sort_values(["first", "last", "id"], ascending=[True, False, True])
    stack: list[tuple[str, int]] = []
    counts: dict[str | None, int] = {}
    out = []
    for r in rows.itertuples():
        while stack and stack[-1][1] < r.last:
            stack.pop()
        parent = stack[-1][0] if stack else None
        out.append((r.owner, r.id, parent, len(stack), counts.get(parent, 0)))
        counts[parent] = counts.get(parent, 0) + 1
        stack.append((r.id, r.last))
    return pd.DataFrame(out, columns=["owner", "id", "parent", "depth", "ordinal"])


def graph_problems(nodes: DataFrame, edges: DataFrame, claims: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, problem, subject) of proposed data-flow graphs: too large, edges to no node, repeated nodes, claims about none."""
    size = nodes.groupBy(graph).agg(F.count("*").alias("n")).where("n > 64").select(graph, F.lit("TOO_MANY_NODES").alias("problem"), F.col("n").cast("string").alias("subject"))
    many = edges.groupBy(graph).agg(F.count("*").alias("n")).where("n > 128").select(graph, F.lit("TOO_MANY_EDGES").alias("problem"), F.col("n").cast("string").alias("subject"))
    twice = nodes.groupBy(graph, "node").agg(F.count("*").alias("n")).where("n > 1").select(graph, F.lit("NODE_REPEATED").alias("problem"), F.col("node").alias("subject"))
    ends = edges.select(graph, F.col("source").alias("node")).unionByName(edges.select(graph, F.col("target").alias("node"))).distinct()
    lost = ends.join(nodes.select(graph, "node"), [graph, "node"], "left_anti").select(graph, F.lit("EDGE_WITHOUT_NODE").alias("problem"), F.col("node").alias("subject"))
    bare = claims.join(nodes.select(graph, "node"), [graph, "node"], "left_anti").select(graph, F.lit("CLAIM_WITHOUT_NODE").alias("problem"), F.col("node").alias("subject"))
    return size.unionByName(many).unionByName(twice).unionByName(lost).unionByName(bare)


def alias_chains(events: DataFrame, owner: str) -> DataFrame:
    """The last definition of each name before a use, by order: owner, ordinal, name, defined_at."""
    w = Window.partitionBy(owner, "name").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("defined_at", F.last(F.when(F.col("op") == "DEFINE", F.col("ordinal")), ignorenulls=True).over(w))
    return rows.where("op = 'USE'").select(owner, "ordinal", "name", "defined_at")
