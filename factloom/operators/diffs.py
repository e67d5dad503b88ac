"""Comparing versions of tables, and maintaining them without rewriting what stays."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], digest: str, mode: str | None = None) -> DataFrame:
    """key, status: ADDED, DELETED, MODIFIED, MODE_CHANGED (same content) or UNCHANGED; nulls are equal to nulls."""
    extra = [mode] if mode else []
    b = before.select(*key, *[F.col(c).alias("b_" + c) for c in [digest, *extra]], F.lit(True).alias("in_b"))
    a = after.select(*key, *[F.col(c).alias("a_" + c) for c in [digest, *extra]], F.lit(True).alias("in_a"))
    both = b.join(a, key, "full_outer")
    same = F.col("b_" + digest).eqNullSafe(F.col("a_" + digest))
    status = F.when(F.col("in_b").isNull(), "ADDED").when(F.col("in_a").isNull(), "DELETED").when(~same, "MODIFIED")
    if mode:
        status = status.when(~F.col("b_" + mode).eqNullSafe(F.col("a_" + mode)), "MODE_CHANGED")
    return both.select(*key, F.col("b_" + digest).alias("before"), F.col("a_" + digest).alias("after"), status.otherwise("UNCHANGED").alias("status"))


def bounded(changes: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows and how many were left out."""
    kept = changes.orderBy(*order).limit(limit)
    return kept.withColumn("omitted", F.greatest(changes.agg(F.count("*")).scalar() - limit, F.lit(0)))


def merge(table: DataFrame, upserts: DataFrame, removals: DataFrame, key: list[str], order: str) -> DataFrame:
    """Removals first, then upserts, of which the last by ``order`` counts."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    last = upserts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)
    kept = table.join(removals.select(*key).distinct(), key, "left_anti").join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.select(*table.columns))


def replace_scope(table: DataFrame, scope: str, scope_col: str, rows: DataFrame, key: list[str], complete: bool) -> DataFrame:
    """A scope replaced by ``rows``; an incomplete analysis may only add and overwrite, never delete."""
    inside = F.col(scope_col) == scope
    kept = table.where(~inside | F.col(scope_col).isNull())
    if not complete:
        kept = kept.unionByName(table.where(inside).join(rows.select(*key), key, "left_anti"))
    return kept.unionByName(rows.select(*table.columns))


def dependency_states(pinned: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """key, state of pinned digests: CURRENT, CHANGED or UNAVAILABLE."""
    now = current.select(F.col(key).alias("_k"), F.col(digest).alias("_now"))
    out = pinned.join(now, F.col(key) == F.col("_k"), "left")
    state = F.when(F.col("_k").isNull(), "UNAVAILABLE").when(~F.col(digest).eqNullSafe(F.col("_now")), "CHANGED").otherwise("CURRENT")
    return out.select(*pinned.columns, state.alias("state"))


def freshness(uses: DataFrame, states: DataFrame, owner: str, key: str) -> DataFrame:
    """owner, status, affected: STALE with the dependencies that changed or went, else CURRENT."""
    bad = uses.join(states.where("state <> 'CURRENT'").select(key), key, "left_semi").groupBy(owner).agg(F.count_distinct(key).alias("affected"))
    out = uses.select(owner).distinct().join(bad, owner, "left")
    return out.select(owner, F.when(F.col("affected").isNull(), "CURRENT").otherwise("STALE").alias("status"), F.coalesce("affected", F.lit(0)).alias("affected"))


def catalogue_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    gone = before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("REMOVED"))
    return gone.unionByName(after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("ADDED")))


def claim_states(claims: DataFrame, evidence: DataFrame, key: str, digest: str, claim: str) -> DataFrame:
    """claim, reason: EVIDENCE_MISSING, SEMANTIC_DIGEST_CHANGED, EVIDENCE_AMBIGUOUS or CURRENT."""
    per = evidence.groupBy(key).agg(F.count("*").alias("n"), F.min(digest).alias("_now"))
    out = claims.join(per, key, "left")
    reason = F.when(F.col("n").isNull(), "EVIDENCE_MISSING").when(F.col("n") > 1, "EVIDENCE_AMBIGUOUS").when(~F.col(digest).eqNullSafe(F.col("_now")), "SEMANTIC_DIGEST_CHANGED").otherwise("CURRENT")
    return out.select(claim, reason.alias("reason"))


def candidate_delta(parent: DataFrame, child: DataFrame, key: str, content: str) -> DataFrame:
    """Upserts ADDED and UPDATED, REMOVED, and UNCHANGED of two candidate lists."""
    out = snapshot_diff(parent, child, [key], content)
    return out.select(key, F.when(F.col("status") == "DELETED", "REMOVED").when(F.col("status") == "MODIFIED", "UPDATED").otherwise(F.col("status")).alias("status"))


def overlay(base: DataFrame, worktree: DataFrame, path: str, regular: str) -> DataFrame:
    """Committed files with saved ones laid over: touched paths go, regular files come back."""
    rest = base.join(worktree.select(path).distinct(), path, "left_anti").withColumn("state", F.lit("COMMITTED"))
    return rest.unionByName(worktree.where(F.col(regular)).select(*base.columns).withColumn("state", F.lit("SAVED")))


def share_equal(local: DataFrame, shared: DataFrame, key: str, content: str, owner: str) -> DataFrame:
    """owner, key, form: a row equal to the shared one becomes a REFERENCE, any other stays OWN."""
    s = shared.select(F.col(key).alias("_k"), F.col(content).alias("_c"))
    out = local.join(s, F.col(key) == F.col("_k"), "left")
    return out.select(owner, key, F.when(F.col("_k").isNotNull() & F.col(content).eqNullSafe(F.col("_c")), "REFERENCE").otherwise("OWN").alias("form"))


CELLS, HUNKS, LINES = 1_000_000, 64, 262_144


def _lines(text: str) -> list[str]:
    """Lines with their line feeds; nothing but a line feed ends a line."""
    out = [x + "\n" for x in text.split("\n")]
    out[-1] = out[-1][:-1]
    return out if out[-1] else out[:-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """(line of a, line of b) of a longest common subsequence; where it is free to choose, lines of ``a`` are left out first."""
    rows = [[0] * (len(b) + 1)]
    for x in reversed(a):
        after, row = rows[-1], [0]
        for j in range(len(b) - 1, -1, -1):
            row.append(after[len(b) - j - 1] + 1 if x == b[j] else max(after[len(b) - j], row[-1]))
        rows.append(row)
    best = lambda i, j: rows[len(a) - i][len(b) - j]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best(i, j + 1) > best(i + 1, j):
            j += 1
        else:
            i += 1
    return out


def line_hunks(old: str | None, new: str | None, cells: int = CELLS, hunks: int = HUNKS) -> tuple[list[tuple[int, int, int, int]], str]:
    """(first old line, old lines, first new line, new lines) of each difference, and the granularity.

    LINES: the gaps of a longest common subsequence.  COARSE_REPLACEMENT: one hunk between common ends, where the table of
    lines exceeds ``cells`` or there are more than ``hunks`` differences; all of both texts, beyond LINES line feeds.
    """
    if max((old or "").count("\n"), (new or "").count("\n")) > LINES:
        return [(1, len(_lines(old or "")), 1, len(_lines(new or "")))], "COARSE_REPLACEMENT"
    a, b = _lines(old or ""), _lines(new or "")
    head = len(os.path.commonprefix([a, b]))
    tail = len(os.path.commonprefix([a[head:][::-1], b[head:][::-1]]))
    ends = (len(a) - tail, len(b) - tail)
    if (len(a) + 1) * (len(b) + 1) <= cells:
        met = [(-1, -1), *_common(a, b), (len(a), len(b))]
        found = [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(met, met[1:]) if k > i + 1 or m > j + 1]
        if len(found) <= hunks:
            return [(i + 1, k - i, j + 1, m - j) for i, k, j, m in found], "LINES"
    return [(head + 1, ends[0] - head, head + 1, ends[1] - head)], "COARSE_REPLACEMENT"


def text_hunks(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """A row per hunk of each pair of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, x, y in zip(*(b.column(c).to_pylist() for c in ("key", "old", "new"))):
                found, how = line_hunks(x, y)
                rows += [(k, n, *h, how) for n, h in enumerate(found)]
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 5, pa.string()))], names=["key", "hunk", "old_line", "old_lines", "new_line", "new_lines", "granularity"])

    src = pairs.select(F.col(key).cast("string").alias("key"), F.col(old).alias("old"), F.col(new).alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))
    return src.mapInArrow(run, "key string, hunk long, old_line long, old_lines long, new_line long, new_lines long, granularity string").withColumnRenamed("key", key)


def put_objects(catalog: DataFrame, objects: DataFrame, digest: Column) -> DataFrame:
    """What a content-addressed sink has to append: one row per digest that the catalog lacks; writing twice adds nothing."""
    keyed = objects.withColumn("digest", digest).dropDuplicates(["digest"])
    return keyed.join(catalog.select("digest"), "digest", "left_anti")


def remove_exact(catalog: DataFrame, plan: DataFrame, key: list[str]) -> DataFrame:
    """The catalog without the planned rows; each has to be there exactly as planned, or the job fails."""
    found = catalog.join(plan.distinct(), key, "left_semi")
    ok = (found.agg(F.count("*")).scalar() == plan.distinct().agg(F.count("*")).scalar()).alias("ok")
    checked = catalog.join(plan.distinct(), key, "left_anti").withColumn("_ok", F.assert_true(ok, F.lit("a planned row is not there")))
    return checked.where("_ok is null").drop("_ok")


def enumerate_bounded(catalog: DataFrame, limit: int) -> DataFrame:
    """All rows, or an error if there are more than ``limit``."""
    n = catalog.limit(limit + 1).agg(F.count("*")).scalar()
    return catalog.withColumn("_ok", F.assert_true(n <= limit, F.lit("more rows than the limit"))).where("_ok is null").drop("_ok")


