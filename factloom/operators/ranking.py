"""Ranking candidates and taking turns over lanes that share nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T


def interleave(df: DataFrame, lane: str, order: list[Column | str], limit: int | None = None) -> DataFrame:
    """The first of each lane, then the second of each, ...; adds ``turn`` and ``position``.

    With a limit, a lane gives its first ``limit`` rows at most (pushed below
    the shuffle as a group limit) before the rows of all lanes meet.
    """
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(lane).orderBy(*order)))
    if limit is None:
        return ranked
    near = ranked.where(F.col("turn") <= limit)
    best = near.orderBy("turn", lane).limit(limit)
    return best.withColumn("position", F.row_number().over(Window.orderBy("turn", lane)))


def top(df: DataFrame, by: list[Column | str], k: int) -> DataFrame:
    """The k best rows with ``position``, the number of all rows, and how many are left out."""
    best = df.orderBy(*by).limit(k).withColumn("position", F.row_number().over(Window.orderBy(*by)))
    return best.withColumn("total", df.agg(F.count("*")).scalar()).withColumn("omitted", F.greatest(F.col("total") - k, F.lit(0)))


def top_per(df: DataFrame, key: str, order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each key, and whether there were more."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)
    return ranked.join(n, key).withColumn("truncated", F.col("n") > k)


def relevance(names: Column, text: Column, terms: list[str]) -> tuple[Column, Column, Column]:
    """(terms found, terms found in names, occurrences) of terms in names and text, letter case apart."""
    low_n, low_t = F.lower(F.coalesce(names, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    in_n = [T.occurrences(low_n, F.lit(t)) for t in terms]
    in_t = [T.occurrences(low_t, F.lit(t)) for t in terms]
    total = lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0)
    found = total([((a + b) > 0).cast("int") for a, b in zip(in_n, in_t)])
    named = total([(a > 0).cast("int") for a in in_n])
    return found, named, total([a + b for a, b in zip(in_n, in_t)])


def term_hits(texts: Column, terms: list[str]) -> Column:
    """Asked terms that are whole index terms of texts."""
    return F.array_intersect(F.array(*[F.lit(t) for t in sorted(set(terms))]), T.index_terms(texts))


def decision(required: int, unmatched: Column, truncated: Column, exact: Column, covered: Column) -> Column:
    """SUPPORTED for one exact candidate that covers all terms of a complete search; else the first reason against."""
    return (
        F.when(F.lit(required == 0), "NO_REQUIRED_TERMS")
        .when(unmatched > 0, "UNMATCHED_TERMS")
        .when(truncated, "SEARCH_TRUNCATED")
        .when(exact == 0, "NO_EXACT_IDENTIFIER")
        .when(exact > 1, "EXACT_IDENTIFIER_AMBIGUOUS")
        .when(covered < required, "INCOMPLETE_COVERAGE")
        .otherwise("SUPPORTED")
    )
