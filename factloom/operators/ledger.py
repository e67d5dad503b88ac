"""Append-only records: hashed ledgers, journals of packs, revisions, packages with manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import content_digest


def hashed(entries: DataFrame, columns: list[str], out: str = "event_hash") -> DataFrame:
    """Each entry with the digest of its other columns in a fixed form."""
    return entries.withColumn(out, content_digest(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})))


def broken_hashes(entries: DataFrame, columns: list[str], out: str = "event_hash") -> DataFrame:
    """Entries whose content does not give their hash."""
    return hashed(entries, columns, "_again").where(~F.col("_again").eqNullSafe(F.col(out))).drop("_again")


def replay(journal: DataFrame, pack: str, order: str) -> DataFrame:
    """(pack, state, problem) after a journal of ADD and REMOVE records (op, manifest).

    An add of a pack that is there and a removal of one that is not, or whose manifest differs, are problems; a
    record is judged by the one before it of the same pack.
    """
    w = Window.partitionBy(pack).orderBy(order)
    rows = journal.withColumn("_op", F.lag("op").over(w)).withColumn("_manifest", F.lag("manifest").over(w)).withColumn("_last", F.lead(order).over(w).isNull())
    wrong = (
        F.when((F.col("op") == "ADD") & (F.col("_op") == "ADD"), "ADDS_EXISTING_PACK")
        .when((F.col("op") == "REMOVE") & ~F.coalesce(F.col("_op") == "ADD", F.lit(False)), "REMOVES_MISSING_PACK")
        .when((F.col("op") == "REMOVE") & ~F.col("manifest").eqNullSafe(F.col("_manifest")), "REMOVES_DIFFERENT_PACK")
    )
    rows = rows.withColumn("_wrong", wrong)
    return rows.groupBy(pack).agg(F.max_by("op", order).alias("_end"), F.min_by("_wrong", F.when(F.col("_wrong").isNotNull(), F.col(order))).alias("problem")).select(pack, F.when(F.col("problem").isNotNull(), "CORRUPT").when(F.col("_end") == "ADD", "PRESENT").otherwise("ABSENT").alias("state"), "problem")


def reconcile_revisions(configured: DataFrame, observed: DataFrame, key: str, revision: str) -> DataFrame:
    """(key, status): UP_TO_DATE, PENDING for another revision, or NOT_OBSERVED."""
    seen = observed.select(F.col(key).alias("_k"), F.col(revision).alias("_r"))
    out = configured.join(seen, F.col(key) == F.col("_k"), "left")
    return out.select(key, F.when(F.col("_k").isNull(), "NOT_OBSERVED").when(F.col("_r").eqNullSafe(F.col(revision)), "UP_TO_DATE").otherwise("PENDING").alias("status"))


def verified_scopes(versions: DataFrame, scope: str, content: str, digest: str) -> DataFrame:
    """Distinct scopes of versions; one whose content does not give its digest fails the job."""
    rows = versions.select(scope, content, digest).dropDuplicates([scope])
    ok = F.assert_true(content_digest(content).eqNullSafe(F.col(digest)), F.lit("a scope differs from its digest"))
    return rows.withColumn("_ok", ok).where("_ok is null").drop("_ok")


def whitelisted(records: DataFrame, kind: str, body: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Diagnostic records of known kinds with only the fields allowed for them; others come out without a body."""
    m = F.from_json(body, "map<string,string>")
    out: Column = F.lit(None).cast("map<string,string>")
    for k, fields in allowed.items():
        keep = [F.lit(f) for f in fields]
        out = F.when(F.col(kind) == k, F.map_filter(m, lambda n, _: F.array_contains(F.array(*keep), n))).otherwise(out)  # noqa: B023
    return records.withColumn("fields", out)


def export_package(rows: DataFrame, folder: str, by: str) -> DataFrame:
    """Writes rows in parts by a column and gives the manifest: part, rows, digest of the part's content."""
    rows.write.mode("errorifexists").partitionBy(by).parquet(f"{folder}/parts")
    manifest = _manifest(rows, by)
    manifest.write.parquet(f"{folder}/manifest")
    return manifest


def _manifest(rows: DataFrame, by: str) -> DataFrame:
    # independent of the order of rows: the sum of hashes of rows, in a width that can't overflow
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(rows.columns)]).cast("decimal(38,0)")
    return rows.groupBy(F.col(by).cast("string").alias("part")).agg(F.count("*").alias("rows"), content_digest(F.sum(row).cast("string")).alias("digest"))


def import_package(spark: SparkSession, folder: str, by: str) -> DataFrame:
    """The rows of a package whose parts are those of its manifest; else the job fails."""
    rows = spark.read.parquet(f"{folder}/parts")
    want = spark.read.parquet(f"{folder}/manifest")
    bad = _manifest(rows, by).exceptAll(want).unionByName(want.exceptAll(_manifest(rows, by)))
    ok = F.assert_true(bad.agg(F.count("*")).scalar() == 0, F.lit("a package differs from its manifest"))
    return rows.withColumn("_ok", ok).where("_ok is null").drop("_ok")
