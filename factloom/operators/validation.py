"""Constraints on facts as queries for what breaks them; a sound table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_stream(events: DataFrame, attempt: str) -> DataFrame:
    """(attempt, problem) of producer streams: shards (seq, kind SHARD, first_key, last_key, rows) and one COMPLETE (rows)."""
    w = Window.partitionBy(attempt).orderBy("seq")
    rows = events.withColumn("prev_seq", F.lag("seq").over(w)).withColumn("prev_key", F.lag("last_key").over(w)).withColumn("prev_kind", F.lag("kind").over(w))
    bad = (
        F.when(F.col("prev_kind") == "COMPLETE", "EVENT_AFTER_COMPLETION")
        .when(F.col("seq") != F.coalesce("prev_seq", F.lit(-1)) + 1, "SEQUENCE_GAP")
        .when((F.col("kind") == "SHARD") & (F.coalesce("rows", F.lit(0)) <= 0), "EMPTY_SHARD")
        .when((F.col("kind") == "SHARD") & (F.col("first_key") > F.col("last_key")), "KEYS_OUT_OF_ORDER")
        .when((F.col("kind") == "SHARD") & (F.col("prev_key") >= F.col("first_key")), "KEYS_OUT_OF_ORDER")
    )
    each = rows.select(attempt, bad.alias("problem")).where("problem is not null")
    total = events.groupBy(attempt).agg(F.sum(F.when(F.col("kind") == "SHARD", F.col("rows")).otherwise(0)).alias("sent"), F.max(F.when(F.col("kind") == "COMPLETE", F.col("rows"))).alias("claimed"), F.sum((F.col("kind") == "COMPLETE").cast("int")).alias("ends"))
    whole = total.select(attempt, F.when(F.col("ends") == 0, "NOT_COMPLETED").when(F.col("ends") > 1, "COMPLETED_TWICE").when(F.col("sent") != F.col("claimed"), "COUNT_DIFFERS").alias("problem")).where("problem is not null")
    return each.unionByName(whole).distinct()


def sorted_unique(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Rows whose key is not above the one before it in their group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("before", F.lag(key).over(w)).where(F.col(key) <= F.col("before")).select(group, order, key, "before")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def branches(steps: DataFrame, owner: str) -> DataFrame:
    """(owner, problem) of step lists (ordinal, kind, text): IF, ELSE and END have to nest.

    The depth is a running sum; an ELSE belongs to the open IF of its depth, which
    is the last IF before it that is opened at that depth.
    """
    w = Window.partitionBy(owner).orderBy("ordinal")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    delta = F.when(F.col("kind") == "IF", 1).when(F.col("kind") == "END", -1).otherwise(0)
    rows = steps.withColumn("depth", F.sum(delta).over(upto)).withColumn("outer", F.coalesce(F.sum(delta).over(before), F.lit(0)))
    at = Window.partitionBy(owner, "level").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    level = F.when(F.col("kind") == "IF", F.col("outer") + 1).when(F.col("kind") == "ELSE", F.col("outer"))
    rows = rows.withColumn("level", level).withColumn("last_at_level", F.when(level.isNotNull(), F.last(F.when(level.isNotNull(), F.col("kind")), ignorenulls=True).over(at)))
    problem = (
        F.when((F.col("kind") == "IF") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "IF_CONDITION_MISSING")
        .when((F.col("kind") == "ELSE") & ((F.col("outer") <= 0) | ~F.coalesce(F.col("last_at_level") == "IF", F.lit(False))), "ELSE_WITHOUT_OPEN_IF_OR_DUPLICATE_ELSE")
        .when((F.col("kind") == "END") & (F.col("outer") <= 0), "END_WITHOUT_OPEN_IF")
    )
    first = rows.withColumn("problem", problem).where("problem is not null").groupBy(owner).agg(F.min_by("problem", "ordinal").alias("problem"))
    open_ = steps.groupBy(owner).agg(F.sum(delta).alias("left")).where("left > 0").select(owner, F.lit("IF_WITHOUT_END").alias("problem"))
    return first.unionByName(open_.join(first.select(owner), owner, "left_anti"))


def control_graph(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """(graph, problem): repeated nodes, edges to none, and not exactly one entry."""
    twice = nodes.groupBy(graph, "node").agg(F.count("*").alias("n")).where("n > 1").select(graph, F.lit("NODE_REPEATED").alias("problem"))
    known = nodes.select(graph, F.col("node")).distinct()
    ends = edges.select(graph, F.col("source").alias("node")).unionByName(edges.select(graph, F.col("target").alias("node")))
    lost = ends.join(known, [graph, "node"], "left_anti").select(graph, F.lit("EDGE_WITHOUT_NODE").alias("problem"))
    entry = nodes.groupBy(graph).agg(F.sum((F.col("role") == "ENTRY").cast("int")).alias("n")).where("n <> 1").select(graph, F.lit("NOT_ONE_ENTRY").alias("problem"))
    return twice.unionByName(lost).unionByName(entry).distinct()


def closed_schema(df: DataFrame, column: str, required: list[str], optional: list[str]) -> DataFrame:
    """Rows of JSON text with the first rule they break: UNREADABLE, UNKNOWN_FIELD or MISSING_FIELD."""
    m = F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"})
    odd = F.exists(F.map_keys(m), lambda k: ~k.isin(*required, *optional))
    lack = F.lit(False)
    for r in required:
        lack = lack | F.element_at(m, r).isNull()
    problem = F.when(m.isNull(), "UNREADABLE").when(odd, "UNKNOWN_FIELD").when(lack, "MISSING_FIELD")
    return df.withColumn("problem", problem).where("problem is not null")
