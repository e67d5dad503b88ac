"""Session helpers shared by all operators: staging and small generic checks."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master, as in tests, may fall back to a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_shipped: set[str] = set()
_staged: list[tuple[str, str]] = []


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session, for clusters where it is not installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = shared_dir(spark)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    # written by Hadoop's file system, so it lies in the shared folder whatever scheme that has, a bare path included
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base}/factloom-{uuid.uuid4().hex}.zip")
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(fs.makeQualified(path).toString())
    _shipped.add(context.applicationId)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage, survives the loss of executors and is evaluated once, so
    random partition ids or sampled ranges inside ``df`` become fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append((spark.sparkContext.applicationId, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, as those of earlier rounds of a loop."""
    for df in tables:
        path = df.staged_path
        _delete(df.sparkSession, path)
        _staged[:] = [x for x in _staged if x[1] != path]


def restage(df: DataFrame, old: DataFrame, name: str = "stage") -> DataFrame:
    """Stages ``df``, the next round of ``old``, which is deleted once it is written, if it was staged itself."""
    new = stage(df, name)
    if "staged_path" in old.__dict__:
        unstage(old)
    return new


def release(spark: SparkSession) -> int:
    """Deletes the tables that this session has staged so far; results that read them have to be written before."""
    mine = [p for a, p in _staged if a == spark.sparkContext.applicationId]
    for p in mine:
        _delete(spark, p)
    _staged[:] = [x for x in _staged if x[1] not in set(mine)]
    return len(mine)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
