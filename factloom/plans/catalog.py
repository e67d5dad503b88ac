"""All queries of the core, by name, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import bodies, evidence, graphs, index, scopes, structure

MODULES = [index, evidence, graphs, bodies, scopes, structure]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["topk_candidates"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= m.SQL
    return out
