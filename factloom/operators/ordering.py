"""Numbering rows within a key without gathering a key in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.runtime import stage


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str = "seq") -> DataFrame:
    """Adds ``out``: 0, 1, ... in ``order`` within equal ``keys`` (nulls equal, first).

    Rows are range partitioned by keys and order, so a key of any size spreads
    over partitions; only a count per key and partition meets in a window.
    The rows are written first, as range partitioning reads them twice.
    """
    cols = [*keys, *order]
    laid = stage(stage(df, "rows").repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    laid = laid.withColumn("_pid", F.shiftright("_mid", 33))
    parts = laid.groupBy(*keys, "_pid").agg(F.min("_mid").alias("_lo"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_lo"))
    parts = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_pid").alias("_p"), "_base")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_pid") == F.col("_p"))
    return laid.join(parts, on).withColumn(out, (F.col("_base") + F.col("_mid")).cast("long")).drop("_mid", "_pid", "_p", "_base", *[f"_k_{k}" for k in keys])


def join_hot(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", by: list[str] | None = None, salt: int = 32) -> DataFrame:
    """Joins ``many`` with ``few``, which has one row per key; how: inner, left, left_semi or left_anti.

    A key that stands in a large part of ``many`` is spread over ``salt`` tasks by its columns ``by`` (all others than
    ``on``, where none are given), to each of which its one row of ``few`` is sent.
    """
    by = by or [c for c in many.columns if c not in on]
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salt)).cast("int")).join(spread, [*on, "_salt"], how).drop("_salt")


HOT_PARTS, HOT_LEAST = 4096, 10_000


def join_counted(many: DataFrame, few: DataFrame, on: list[str], n: str, by: list[str] | None = None, least: int = HOT_LEAST, salt: int = 32) -> DataFrame:
    """Joins ``many`` with ``few``, which has one row per key and in ``n`` how many rows of ``many`` have it at most.

    Keys with at least ``least`` rows and more than one in HOT_PARTS of all are spread over ``salt`` tasks by the columns
    ``by`` of ``many``; as their rows add up to all, there are fewer than HOT_PARTS of them, which are broadcast.
    ``few`` is read twice, so it should be staged.
    """
    total, top = few.agg(F.sum(n), F.max(n)).first()
    limit = max(least, (total or 0) // HOT_PARTS + 1)
    if top is None or top < limit:
        return many.join(few, on)
    hot = few.where(F.col(n) >= limit).select(*[F.col(c).alias("_h_" + c) for c in on], F.lit(True).alias("_hot"))
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col("_h_" + c) for c in on])
    part = F.pmod(F.xxhash64(*(by or [c for c in many.columns if c not in on])), F.lit(salt)).cast("int")
    split = many.join(F.broadcast(hot), match, "left").withColumn("_salt", F.when(F.col("_hot"), part).otherwise(0)).drop("_hot", *["_h_" + c for c in on])
    spread = few.withColumn("_salt", F.explode(F.when(F.col(n) >= limit, F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))))
    return split.join(spread, [*on, "_salt"]).drop("_salt")


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per non-null ``key``: the one with the greatest ``by``, then the greatest other columns.

    An aggregate, so repeated rows of a hot key combine before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, by)]
    packed = F.max(F.struct(F.col(by), *[F.col(c) for c in rest])).alias("_r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(packed).select(key, *[F.col(f"_r.{c}").alias(c) for c in [by, *rest]])


def first_per_key(df: DataFrame, keys: list[str], order: list[str], k: int, out: str, salt: int = 64) -> DataFrame:
    """The first ``k`` rows of each key in ``order`` with their place from 1.

    A key is cut in ``salt`` parts first, so what meets in one task is salt x k rows of it at most.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(salt))
    near = df.withColumn("_salt", part).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_n") <= k)
    return near.drop("_salt", "_n").withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)
