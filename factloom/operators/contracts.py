"""Declared contracts against declared routes, in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import path_key

#: HTTP methods that are compared (fixed values).
METHODS = ("GET", "PUT", "POST", "DELETE", "OPTIONS", "HEAD", "PATCH", "TRACE")


def routes(entries: DataFrame) -> DataFrame:
    """(entry, method, path, key, gaps) of entries (entry, methods, paths): each method with each path, unless both are several."""
    many = (F.size("methods") > 1) & (F.size("paths") > 1)
    none = F.array(F.lit(""))
    methods = F.when(many | (F.size("methods") == 0) | (F.size("paths") == 0), none).otherwise(F.col("methods"))
    paths = F.when(many | (F.size("paths") == 0), none).otherwise(F.col("paths"))
    gaps = F.array_compact(F.array(
        F.when(many, "METHOD_PATH_CORRELATION_UNAVAILABLE"), F.when(~many & (F.size("methods") == 0), "HTTP_METHOD_UNSPECIFIED"), F.when(many | (F.size("paths") == 0), "NO_COMPARABLE_ROUTE_PAIR")))
    rows = entries.select("entry", gaps.alias("gaps"), paths.alias("paths"), F.explode(methods).alias("m")).select("entry", "gaps", F.upper("m").alias("method"), F.explode("paths").alias("path")).distinct()
    rows = rows.withColumn("key", path_key("path"))
    more = F.array_compact(F.array(F.when(~F.col("method").isin(*METHODS), "HTTP_METHOD_UNKNOWN"), F.when(F.col("key").isNull(), "PATH_SEMANTICS_UNSUPPORTED")))
    return rows.withColumn("gaps", F.array_sort(F.array_union("gaps", more)))


def reconcile(contracts: DataFrame, declared: DataFrame) -> DataFrame:
    """(direction, id, method, path, status, matches) for contracts (contract, method, path) and ``routes``.

    Both sides are counted per method and key before they meet, so the join is one to one on keys.
    """
    c = contracts.select("contract", F.upper("method").alias("method"), "path", path_key("path").alias("key"))
    usable = declared.where(F.size("gaps") == 0)
    n_routes = usable.groupBy("method", "key").agg(F.count("*").alias("n_routes"))
    n_contracts = c.where("key is not null").groupBy("method", "key").agg(F.count("*").alias("n_contracts"))
    forward = c.join(n_routes, ["method", "key"], "left").join(n_contracts, ["method", "key"], "left")
    state = (
        F.when(F.col("key").isNull() | ~F.col("method").isin(*METHODS), "UNSUPPORTED_INCOMPLETE")
        .when(F.col("n_contracts") > 1, "AMBIGUOUS")
        .when(F.col("n_routes").isNull(), "CONTRACT_ONLY_UNPROVEN")
        .when(F.col("n_routes") > 1, "AMBIGUOUS")
        .otherwise("MATCHED")
    )
    forward = forward.select(F.lit("CONTRACT_TO_SOURCE").alias("direction"), F.col("contract").alias("id"), "method", "path", state.alias("status"), F.coalesce("n_routes", F.lit(0)).alias("matches"))
    backward = declared.join(n_contracts, ["method", "key"], "left").join(n_routes, ["method", "key"], "left")
    state = (
        F.when(F.size("gaps") > 0, "UNSUPPORTED_INCOMPLETE")
        .when(F.col("n_contracts").isNull(), "DECLARED_ROUTE_ONLY")
        .when((F.col("n_contracts") > 1) | (F.col("n_routes") > 1), "AMBIGUOUS")
        .otherwise("MATCHED")
    )
    backward = backward.select(F.lit("SOURCE_TO_CONTRACT").alias("direction"), F.col("entry").alias("id"), "method", "path", state.alias("status"), F.coalesce("n_contracts", F.lit(0)).alias("matches"))
    return forward.unionByName(backward)


def merge_parameters(path_level: DataFrame, operation_level: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters of an operation: its own win over those of its path."""
    rest = path_level.join(operation_level.select(*keys), keys, "left_anti").withColumn("level", F.lit("PATH"))
    return operation_level.withColumn("level", F.lit("OPERATION")).unionByName(rest)


def nth_call(calls: DataFrame, declared: DataFrame, owner: str, order: str) -> DataFrame:
    """Declared interactions (owner, ordinal, expected) against the call at that ordinal: MATCH, DIFFERENT or MISSING.

    ``calls``: owner, order, target; ordinals count from 0 in ``order``.
    """
    from pyspark.sql import Window

    placed = calls.withColumn("ordinal", F.row_number().over(Window.partitionBy(owner).orderBy(order)) - 1).select(owner, "ordinal", "target")
    out = declared.join(placed, [owner, "ordinal"], "left")
    status = F.when(F.col("target").isNull(), "MISSING").when(F.col("target") == F.col("expected"), "MATCH").otherwise("DIFFERENT")
    return out.select(owner, "ordinal", "expected", "target", status.alias("status"))
