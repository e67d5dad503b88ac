"""File scans: committed and saved files as rows with their digests, and exact literals in them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import content_digest

#: Names of files that steer a build (fixed values).
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties", "Cargo.toml", "Cargo.lock", "package.json", "package-lock.json", "pyproject.toml", "go.mod")


def scan(spark: SparkSession, root: str, state: str = "COMMITTED", glob: str | None = None) -> DataFrame:
    """(path, state, size, digest, content) of the files below a folder; ``glob`` prunes at the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + base + "/", "")
    return reader.load(root).select(rel.alias("path"), F.lit(state).alias("state"), F.col("length").alias("size"), content_digest("content").alias("digest"), "content")


def materialize(files: DataFrame, folder: str) -> None:
    """Writes (path, content) rows as files below a folder that all executors share."""

    def put(rows) -> None:
        import os

        for r in rows:
            target = os.path.normpath(os.path.join(folder, r["path"]))
            if not target.startswith(os.path.normpath(folder) + os.sep):
                raise ValueError("a path leaves the folder")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as f:
                f.write(r["content"])

    files.select("path", "content").foreachPartition(put)


def is_build_file(path: str):
    """Whether a path is one that steers a build."""
    return F.substring_index(F.col(path), "/", -1).isin(*BUILD_FILES)


def locate(texts: DataFrame, key: str, text: str, literal: str, most: int) -> DataFrame:
    """(key, byte_start, byte_end) of each occurrence of a literal, without overlap; none at all if there are more than ``most``."""
    needle = literal.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                at = raw.find(needle)
                while at >= 0:
                    out.append((k, at, at + len(needle)))
                    at = raw.find(needle, at + len(needle))
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["k", "byte_start", "byte_end"])

    rows = texts.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.contains("t", F.lit(literal))).distinct()
    hits = rows.mapInArrow(run, "k string, byte_start long, byte_end long")
    return hits.where(hits.limit(most + 1).agg(F.count("*")).scalar() <= most).withColumnRenamed("k", key)
