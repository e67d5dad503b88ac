"""Facts as streams: appended once each, counted in windows, and attempts followed until they complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import content_digest
from factloom.runtime import shared_dir


def _source(spark: SparkSession, path: str) -> DataFrame:
    # a pattern, as the path may be a file or a folder; event times need a zone
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + f"[{path[-1]}]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, spark: SparkSession, mode: str, name: str, target: str | None = None) -> DataFrame:
    """Works off all that is there and gives the table that was written; checkpoints lie in the shared folder."""
    base = target or f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/table")


def append_facts(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Each fact once, however often it arrives within a day of its first time; with a target, a second call adds only new files."""
    facts = _source(spark, path).where("props is not null").withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    return _run(facts.select("event_id", "user_id", "event_type", content_digest("props").alias("digest")), spark, "append", "facts", target)


def hourly_counts(spark: SparkSession, path: str) -> DataFrame:
    """(event_type, start, n) per hour; rows later than the watermark would be dropped, so the last state is written whole."""
    base = f"{shared_dir(spark)}/streams/hours-{uuid.uuid4().hex}"
    hours = _source(spark, path).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    out = hours.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table")

    out.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{base}/table")


def attempt_states(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, rows, last_ts): open sessions of events, closed by the first gap above half an hour."""
    base = f"{shared_dir(spark)}/streams/sessions-{uuid.uuid4().hex}"
    s = _source(spark, path).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("rows"), F.max("ts").alias("last_ts"))

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table")

    s.select("user_id", "rows", F.col("last_ts").cast("timestamp_ntz").alias("last_ts")).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{base}/table")
