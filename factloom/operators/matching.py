"""Joins that give exactly one answer or say why there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exactly_one(left: DataFrame, right: DataFrame, key: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, status, n_candidates, right_id): RESOLVED, AMBIGUOUS or MISSING for each row of ``left``.

    Candidates are counted per key before the join, so an ambiguous key of any size comes to the join as one row.
    """
    per = right.groupBy(*key).agg(F.count("*").alias("n"), F.min(right_id).alias("only"))
    out = left.select(left_id, *key).join(per, key, "left")
    status = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return out.select(left_id, status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_candidates"), F.when(F.col("n") == 1, F.col("only")).alias(right_id))


def exact_or_family(refs: DataFrame, decls: DataFrame, ref_id: str, exact: str, family: str, decl_id: str) -> DataFrame:
    """References resolved by their exact key, or by their family where they have no exact key; one candidate or a boundary."""
    by_exact = exactly_one(refs.where(F.col(exact).isNotNull()), decls.where(F.col(exact).isNotNull()), [exact], ref_id, decl_id).withColumn("basis", F.lit("EXACT"))
    rest = refs.where(F.col(exact).isNull() & F.col(family).isNotNull())
    by_family = exactly_one(rest, decls.where(F.col(family).isNotNull()), [family], ref_id, decl_id).withColumn("basis", F.lit("FAMILY"))
    none = refs.where(F.col(exact).isNull() & F.col(family).isNull()).select(ref_id, F.lit("MISSING").alias("status"), F.lit(0).cast("long").alias("n_candidates"), F.lit(None).cast(decls.schema[decl_id].dataType).alias(decl_id), F.lit("NONE").alias("basis"))
    return by_exact.unionByName(by_family).unionByName(none)


def two_phase(before: DataFrame, after: DataFrame, exact: str, family: list[str]) -> DataFrame:
    """Pairs two versions: by the exact key, then by a family that has one row left on either side, then ADDED or REMOVED.

    ``exact`` is unique on each side.
    """
    b = before.select(F.col(exact).alias("b_key"), *[F.col(c).alias("b_" + c) for c in family])
    a = after.select(F.col(exact).alias("a_key"), *[F.col(c).alias("a_" + c) for c in family])
    same = b.join(a, F.col("b_key") == F.col("a_key"))
    left_b = b.join(a, F.col("b_key") == F.col("a_key"), "left_anti")
    left_a = a.join(b, F.col("b_key") == F.col("a_key"), "left_anti")
    one_b = left_b.groupBy(*["b_" + c for c in family]).agg(F.count("*").alias("nb"), F.min("b_key").alias("b_key")).where("nb = 1")
    one_a = left_a.groupBy(*["a_" + c for c in family]).agg(F.count("*").alias("na"), F.min("a_key").alias("a_key")).where("na = 1")
    moved = one_b.join(one_a, [F.col("b_" + c) == F.col("a_" + c) for c in family]).select("b_key", "a_key")
    removed = left_b.select("b_key").join(moved, "b_key", "left_anti")
    added = left_a.select("a_key").join(moved, "a_key", "left_anti")
    kind = before.schema[exact].dataType
    none = F.lit(None).cast(kind)
    return (
        same.select(F.col("b_key").alias("before"), F.col("a_key").alias("after"), F.lit("EXACT").alias("status"))
        .unionByName(moved.select(F.col("b_key").alias("before"), F.col("a_key").alias("after"), F.lit("FAMILY").alias("status")))
        .unionByName(removed.select(F.col("b_key").alias("before"), none.alias("after"), F.lit("REMOVED").alias("status")))
        .unionByName(added.select(none.alias("before"), F.col("a_key").alias("after"), F.lit("ADDED").alias("status")))
    )


def lane_changes(before: DataFrame, after: DataFrame, lane: list[str], symbol: str, complete: Column | None = None) -> DataFrame:
    """One verdict per lane on the symbols of two versions.

    All matched: UNCHANGED; one left on either side and none matched: PAIRED;
    incomplete: UNSUPPORTED; else ADDED, REMOVED or OVERLOAD_SET_CHANGED.
    """
    b = before.select(*lane, symbol).distinct().withColumn("in_b", F.lit(1))
    a = after.select(*lane, symbol).distinct().withColumn("in_a", F.lit(1))
    both = b.join(a, [*lane, symbol], "full_outer")
    per = both.groupBy(*lane).agg(
        F.sum((F.col("in_b").isNotNull() & F.col("in_a").isNotNull()).cast("long")).alias("matched"),
        F.sum(F.col("in_a").isNull().cast("long")).alias("only_before"),
        F.sum(F.col("in_b").isNull().cast("long")).alias("only_after"),
    )
    verdict = (
        F.when((F.col("only_before") == 0) & (F.col("only_after") == 0), "UNCHANGED")
        .when((F.col("only_before") == 1) & (F.col("only_after") == 1) & (F.col("matched") == 0), "PAIRED")
        .when(~(complete if complete is not None else F.lit(True)), "UNSUPPORTED")
        .when((F.col("matched") > 0) | ((F.col("only_before") > 0) & (F.col("only_after") > 0)), "OVERLOAD_SET_CHANGED")
        .when(F.col("only_before") == 0, "ADDED")
        .otherwise("REMOVED")
    )
    return per.withColumn("verdict", verdict)


def difference_codes(pairs: DataFrame, codes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row per pair and field that differs, nulls being equal to nulls."""
    found = F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(code)) for code, (a, b) in codes.items()]))
    return pairs.withColumn("code", F.explode(found))


def unique_or_error(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows, each failing the job if its key is repeated."""
    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("_n", n).withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit("a key is repeated"))).where("_ok is null").drop("_n", "_ok")


def containing(points: DataFrame, spans: DataFrame, key: list[str], point_id: str, span_id: str, width: int) -> DataFrame:
    """Spans (first, last) that hold a point interval (p_first, p_last) under the same key: one owner or a label.

    Spans are cut into strips of ``width``, so the join is on key and strip
    and no pair outside of a strip is looked at.
    """
    strips = spans.withColumn("strip", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    pts = points.withColumn("strip", F.floor(F.col("p_first") / width))
    hits = pts.join(strips, [*key, "strip"]).where("first <= p_first and last >= p_last")
    per = hits.groupBy(point_id).agg(F.count("*").alias("n"), F.min(span_id).alias("only"))
    out = points.select(point_id).join(per, point_id, "left")
    status = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return out.select(point_id, status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_candidates"), F.when(F.col("n") == 1, F.col("only")).alias(span_id))


def facet(relations: DataFrame, ids: DataFrame, side: str) -> DataFrame:
    """Relations with one end among ``ids`` (column ``id``); one UNSUPPORTED row instead of none."""
    end = {"callers": "target", "callees": "source"}[side]
    hits = relations.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi").select("source", "target", "kind", F.lit("SUPPORTED").alias("status"))
    empty = hits.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("kind"), F.lit("UNSUPPORTED").alias("status"))
    return hits.unionByName(empty)


def selector_status(endpoints: DataFrame, observations: DataFrame, key: list[str]) -> DataFrame:
    """(endpoint, status): INCOMPLETE without a selector, MISSING, AMBIGUOUS, SOURCE_UNAVAILABLE, SOURCE_MATCH (syntax only) or RESOLVED.

    endpoints: endpoint, selected (boolean), key columns; observations: key columns, has_source, syntax.
    """
    per = observations.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.col("has_source").cast("int")).alias("src"), F.max(F.col("syntax").cast("int")).alias("syn"))
    out = endpoints.join(per, key, "left")
    status = (
        F.when(~F.col("selected"), "INCOMPLETE").when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("src") == 0, "SOURCE_UNAVAILABLE").when(F.col("syn") == 1, "SOURCE_MATCH").otherwise("RESOLVED")
    )
    return out.select("endpoint", status.alias("status"))


def entity_dependencies(entities: DataFrame, observations: DataFrame, entity: str, ids: str, obs_id: str, sources: str) -> DataFrame:
    """(entity, missing, source_ids): dependencies that are not there, and the sources of those that are."""
    named = entities.select(entity, F.explode_outer(ids).alias("dep")).distinct()
    known = observations.select(F.col(obs_id).alias("dep"), F.col(sources).alias("_s"), F.lit(True).alias("known"))
    per = named.join(known, "dep", "left")
    empty = F.array().cast("array<string>")
    return per.groupBy(entity).agg(
        F.array_sort(F.collect_set(F.when(F.col("dep").isNotNull() & F.col("known").isNull(), F.col("dep")))).alias("missing"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("_s", empty))))).alias("source_ids"),
    )
