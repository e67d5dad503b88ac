"""Nullness as bits (NULL 1, NON_NULL 2, both: unknown) over equations of values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.runtime import stage

NULL, NON_NULL, TOP = 1, 2, 3
NAMES = {NULL: "NULL", NON_NULL: "NON_NULL"}


def relevant(equations: dict[str, tuple[str, list[str], list[str]]], target: str, most: int) -> tuple[list[str], list[str]]:
    """(nodes the target needs, nodes beyond the budget); equations: id -> (op, operands, guards)."""
    chosen: dict[str, None] = {}
    over: dict[str, None] = {}
    todo = {target} if target in equations else set()
    while todo:
        node = min(todo)
        todo.discard(node)
        if node in chosen:
            continue
        if len(chosen) == most:
            over[node] = None
            continue
        chosen[node] = None
        _, operands, guards = equations[node]
        todo.update(x for x in (*operands, *guards) if x in equations)
    return list(chosen), list(over)


def value_of(op: str, operands: list[str], state: dict[str, int]) -> int:
    seen = [state.get(x, TOP) for x in operands]
    if op == "NULL":
        return NULL
    if op == "NON_NULL":
        return NON_NULL
    if op == "COPY":
        return seen[0]
    if op == "JOIN":
        out = 0
        for v in seen:
            out |= v
        return out
    if op == "COALESCE":
        return (seen[0] & NON_NULL) | (seen[1] if seen[0] & NULL else 0)
    return TOP


def solve(equations: dict[str, tuple[str, list[str], list[str]]], target: str, nodes: int = 4096, transfers: int = 1_000_000) -> tuple[dict[str, int], bool]:
    """(bits of the nodes the target needs, converged); a spent budget makes all unknown."""
    chosen, _ = relevant(equations, target, nodes)
    state = dict.fromkeys(chosen, 0)
    users: dict[str, set[str]] = {}
    for n in chosen:
        for x in equations[n][1]:
            users.setdefault(x, set()).add(n)
    todo, spent = set(chosen), 0
    for _round in range(2):
        while todo:
            n = min(todo)
            todo.discard(n)
            if spent == transfers:
                return dict.fromkeys(chosen, TOP), False
            spent += 1
            new = state[n] | value_of(equations[n][0], equations[n][1], state)
            if new != state[n]:
                state[n] = new
                todo |= users.get(n, set())
        for n, v in state.items():  # what no equation gave a value to is unknown
            if not v and not _round:
                state[n] = TOP
                todo |= users.get(n, set())
    return state, True


def nullness(values: DataFrame, targets: DataFrame) -> DataFrame:
    """(owner, id, nullness, converged) for the target of each owner; values: owner, id, op, operands, guards.

    An owner is one callable body, whose equations fit a task.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        eq = {r.id: (r.op, list(r.operands), list(r.guards)) for r in left.itertuples()}
        for r in right.itertuples():
            state, ok = solve(eq, r.target)
            out += [(r.owner, n, NAMES.get(v, "UNKNOWN"), ok) for n, v in state.items()]
        return pd.DataFrame(out, columns=["owner", "id", "nullness", "converged"])

    return values.groupBy("owner").cogroup(targets.groupBy("owner")).applyInPandas(run, "owner string, id string, nullness string, converged boolean")


def transfer(op: Column, left: Column, right: Column, joined: Column) -> Column:
    """One equation as a column expression."""
    coalesced = left.bitwiseAND(F.lit(NON_NULL)).bitwiseOR(F.when(left.bitwiseAND(F.lit(NULL)) != 0, right).otherwise(0))
    return F.when(op == "NULL", NULL).when(op == "NON_NULL", NON_NULL).when(op == "COPY", left).when(op == "JOIN", joined).when(op == "COALESCE", coalesced).otherwise(TOP)


def spread(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """(id, bits): joins over any number of nodes at once; nodes: id, bits (0 for none), flows: source, target.

    Bits only grow, so rounds end; nodes that nothing gives a value to are unknown.
    """
    state = stage(nodes.select("id", F.col("bits").cast("int").alias("bits")), "bits")
    front = state.where("bits <> 0")
    while True:
        came = front.join(flows.select(F.col("source").alias("id"), "target"), "id").groupBy(F.col("target").alias("id")).agg(F.bit_or("bits").alias("more"))
        nxt = stage(state.join(came, "id", "left").select("id", F.col("bits").alias("old"), F.col("bits").bitwiseOR(F.coalesce("more", F.lit(0))).alias("bits")), "bits")
        front = nxt.where("bits <> old").select("id", "bits")
        state = nxt.select("id", "bits")
        if not front.limit(1).count():
            return state.select("id", F.when(F.col("bits") == 0, TOP).otherwise(F.col("bits")).alias("bits"))
