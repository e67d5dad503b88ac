"""Aggregates of evidence: completeness, catalogues, inventories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meet(df: DataFrame, key: str, order: str) -> DataFrame:
    """Completeness vectors of a key met in ``order``.

    Columns: support (SUPPORTED or not), coverage (COMPLETE, PARTIAL, UNKNOWN),
    scopes and boundaries (arrays), certainty (VERIFIED or UNSURE), checks.
    All but one part is an aggregate without order.  SCOPE_MISMATCH arises only
    where the result so far is COMPLETE and meets a COMPLETE of another scope:
    as PARTIAL absorbs, that is so if and only if the first two scopes in order
    that differ come before the first PARTIAL.
    """
    supported = F.min((F.col("support") == "SUPPORTED").cast("int")) == 1
    unknown = F.max((F.col("coverage") == "UNKNOWN").cast("int")) == 1
    gather = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))
    scope = F.when(F.col("coverage") == "COMPLETE", F.array_join("scopes", ","))
    first = F.min_by(scope, F.when(scope.isNotNull(), F.col(order)))
    partial_at = F.min(F.when(F.col("coverage") == "PARTIAL", F.col(order)))
    facts = df.groupBy(key).agg(supported.alias("sup"), unknown.alias("unk"), gather(F.col("scopes")).alias("all_scopes"), gather(F.col("boundaries")).alias("all_bounds"), gather(F.col("checks")).alias("all_checks"), (F.max((F.col("certainty") == "UNSURE").cast("int")) == 1).alias("unsure"), first.alias("first_scope"), partial_at.alias("partial_at"))
    other = df.withColumn("_scope", scope).join(facts.select(F.col(key).alias("_k"), "first_scope"), (F.col(key) == F.col("_k")) & F.col("_scope").isNotNull() & (F.col("_scope") != F.col("first_scope")))
    other = other.groupBy("_k").agg(F.min(order).alias("other_at"))
    out = facts.join(other, F.col(key) == F.col("_k"), "left")
    mismatch = F.col("other_at").isNotNull() & (F.col("partial_at").isNull() | (F.col("other_at") < F.col("partial_at")))
    coverage = F.when(F.col("unk"), "UNKNOWN").when(F.col("partial_at").isNull() & F.col("other_at").isNull(), "COMPLETE").otherwise("PARTIAL")
    empty = F.array().cast("array<string>")
    bounds = F.when(coverage != "PARTIAL", empty).when(mismatch, F.array_sort(F.array_union("all_bounds", F.array(F.lit("SCOPE_MISMATCH"))))).otherwise(F.col("all_bounds"))
    return out.select(
        key, F.when(F.col("sup"), "SUPPORTED").otherwise("UNSUPPORTED").alias("support"), coverage.alias("coverage"), F.when(coverage == "UNKNOWN", empty).otherwise(F.col("all_scopes")).alias("scopes"),
        bounds.alias("boundaries"), F.when(F.col("unsure"), "UNSURE").otherwise("VERIFIED").alias("certainty"), F.when(F.col("unsure"), F.col("all_checks")).otherwise(empty).alias("checks"),
    )


def publishable(obligations: Column | None = None) -> Column:
    none = F.lit(True) if obligations is None else F.size(obligations) == 0
    return (F.col("support") == "SUPPORTED") & (F.col("coverage") == "COMPLETE") & (F.col("certainty") == "VERIFIED") & none


def members_status(df: DataFrame, members: DataFrame, key: str, member: str) -> DataFrame:
    """One status over members: INCOMPLETE before CONDITIONAL_TASK before COMPLETE_TASK; columns complete, conditional."""
    per = df.groupBy(key).agg(F.min(F.col("complete").cast("int")).alias("c"), F.max(F.col("conditional").cast("int")).alias("q"), F.count_distinct(member).alias("members"))
    return per.select(key, "members", F.when(F.col("c") == 0, "INCOMPLETE").when(F.col("q") == 1, "CONDITIONAL_TASK").otherwise("COMPLETE_TASK").alias("status"))


def in_all(df: DataFrame, key: str, member: str, n_members: int) -> DataFrame:
    """Keys that all of ``n_members`` members have."""
    return df.groupBy(key).agg(F.count_distinct(member).alias("n")).where(F.col("n") == n_members).select(key)


def ambiguous_groups(df: DataFrame, keys: list[str], content: str, ids: str) -> DataFrame:
    """Rows of one name: AMBIGUOUS if their content differs; the union of the ids of their sources."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("occurrences"),
        F.when(F.count_distinct(content) > 1, "AMBIGUOUS").otherwise("UNIQUE").alias("status"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(ids)))).alias("source_ids"),
    )


def process_candidates(events: DataFrame, local: DataFrame, owner: str) -> DataFrame:
    """Owners whose events call several local targets under control: (owner, targets, controls, lexical_calls, reasons).

    ``events``: owner, kind, target, syntactic (boolean); ``local``: target.
    """
    call = F.col("kind").isin("CALL", "CONSTRUCT")
    known = events.join(local.select("target", F.lit(True).alias("known")).distinct(), "target", "left")
    per = known.groupBy(owner).agg(
        F.count_distinct(F.when(call & F.col("known"), F.col("target"))).alias("targets"),
        F.sum(F.col("kind").isin("IF", "LOOP").cast("long")).alias("controls"),
        F.sum((call & F.col("syntactic")).cast("long")).alias("lexical_calls"),
    )
    inner = F.when((F.col("targets") >= 2) & (F.col("controls") > 0), "INTERNAL_ORCHESTRATION_CANDIDATE")
    lexical = F.when((F.col("lexical_calls") >= 2) & (F.col("controls") > 0), "LEXICAL_ORCHESTRATION_CANDIDATE")
    return per.withColumn("reasons", F.array_compact(F.array(inner, lexical))).where(F.size("reasons") > 0)


def ordinal_gaps(events: DataFrame, owner: str, ordinal: str, expected: DataFrame, n: str) -> DataFrame:
    """Owners whose ordinals are not exactly 0 .. n-1; null and repeated ordinals are gaps."""
    per = events.groupBy(owner).agg(F.count("*").alias("rows"), F.count_distinct(ordinal).alias("distinct_ordinals"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    out = expected.select(owner, n).join(per, owner, "left")
    fine = (F.coalesce("rows", F.lit(0)) == F.col(n)) & ((F.col(n) == 0) | ((F.col("distinct_ordinals") == F.col(n)) & (F.col("lo") == 0) & (F.col("hi") == F.col(n) - 1)))
    return out.where(~F.coalesce(fine, F.lit(False))).select(owner, F.col(n).alias("expected"), F.coalesce("rows", F.lit(0)).alias("present"))


def inventory(df: DataFrame, size: str) -> DataFrame:
    """Rows, bytes, and rows of negative size, which must not be."""
    return df.agg(F.count("*").alias("objects"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.sum((F.col(size) < 0).cast("long")), F.lit(0)).alias("negative"))


def allocation_proof(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follows aliases through the statements of one owner in order (``applyInPandas``).

    Statements: ordinal, op (NEW, COPY, ENDPOINT, WORKER), name, value.  PROVEN if endpoint and worker are
    bound once each, to the same allocation.
    """
    bound: dict[str, str] = {}
    seen: dict[str, list[str | None]] = {"ENDPOINT": [], "WORKER": []}
    for r in pdf.sort_values("ordinal").itertuples():
        if r.op == "NEW":
            bound[r.name] = f"{r.name}@{r.ordinal}"
        elif r.op == "COPY":
            if r.value in bound:
                bound[r.name] = bound[r.value]
            else:
                bound.pop(r.name, None)
        elif r.op in seen:
            seen[r.op].append(bound.get(r.name))
    one = all(len(v) == 1 for v in seen.values())
    same = one and seen["ENDPOINT"][0] is not None and seen["ENDPOINT"][0] == seen["WORKER"][0]
    return pd.DataFrame({"owner": [pdf["owner"].iloc[0]], "status": ["PROVEN" if same else "UNPROVEN"]})
