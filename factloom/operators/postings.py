"""The inverted index: building, looking up, and fair choice among lanes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.ordering import first_per_key

#: Limits that results are defined by.
PER_TERM, PER_CONTEXT, QUERY_TERMS, PAYLOAD_BYTES = 1024, 4096, 256, 65_536


def term_rows(facts: DataFrame, text_col: str = "texts") -> DataFrame:
    """A row per fact and term; ``texts`` is an array of strings, larger payloads than PAYLOAD_BYTES are left out."""
    small = F.filter(F.array_compact(F.col(text_col)), lambda t: F.octet_length(t) <= PAYLOAD_BYTES)
    return facts.select("lane", "fact_key", F.explode(T.index_terms(small)).alias("term")).distinct()


def left_out(facts: DataFrame, text_col: str = "texts", limit: int = PAYLOAD_BYTES) -> DataFrame:
    """(lane, fact_key, payload, bytes, reason): payloads that the index leaves out, by their place in the fact from 0."""
    each = facts.select("lane", "fact_key", F.posexplode(text_col).alias("payload", "_t"))
    return each.select("lane", "fact_key", "payload", F.octet_length("_t").alias("bytes"), F.lit("PAYLOAD_TOO_LARGE").alias("reason")).where(F.col("bytes") > limit)


def postings(facts: DataFrame, per_term: int = PER_TERM) -> DataFrame:
    """(bucket, term, lane, fact_key, place): the least ``per_term`` facts of each term.

    Terms are cut in salted parts first, so one that stands in a third of all facts meets no task as a whole.
    """
    ranked = first_per_key(term_rows(facts), ["term"], ["fact_key", "lane"], per_term, "place")
    return ranked.select(T.term_bucket("term").alias("bucket"), "term", "lane", "fact_key", F.col("place").cast("int"))


INDEX_DDL = "bucket string, term string, lane string, fact_key string, place int, shard string"


def write_index(index: DataFrame, path: str) -> None:
    """Writes postings by the first digit of their bucket, each part sorted by term, so that a lookup reads few row groups of few parts."""
    rows = index.withColumn("shard", F.substring("bucket", 1, 1))
    rows.repartitionByRange("shard", "term").sortWithinPartitions("shard", "term", "place").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_DDL).parquet(path)


def overflow_terms(facts: DataFrame, per_term: int = PER_TERM) -> DataFrame:
    """Terms with more facts than the index keeps, and how many."""
    return term_rows(facts).groupBy("term").agg(F.count("*").alias("n_facts")).where(F.col("n_facts") > per_term)


def term_table(spark: SparkSession, terms: list[str]) -> DataFrame:
    if len(terms) > QUERY_TERMS:
        raise ValueError(f"a query has at most {QUERY_TERMS} terms")
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, terms)).cast("array<string>")).alias("raw"))
    asked = rows.select(F.explode(T.normal_terms(F.array("raw"))).alias("term")).distinct()
    return asked


def lookup(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of each asked term or of its alias without underscores.

    A query has QUERY_TERMS terms at most, so what they and their aliases are goes into the scan as values: a written
    index is read by shard and by term.
    """
    asked = terms.select("term", F.explode(F.array(F.struct(F.col("term").alias("key"), F.lit(0).alias("by_alias")), F.struct(T.query_alias("term").alias("key"), F.lit(1).alias("by_alias")))).alias("k"))
    asked = asked.select("term", "k.key", "k.by_alias").where("key is not null").withColumn("bucket", T.term_bucket("key")).limit(2 * QUERY_TERMS + 1).toArrow()
    if asked.num_rows > 2 * QUERY_TERMS:
        raise ValueError(f"a query has at most {QUERY_TERMS} terms")
    if "shard" in index.columns:
        index = index.where(F.col("shard").isin(sorted({b[:1] for b in asked["bucket"].to_pylist()}))).drop("shard")
    index = index.where(F.col("term").isin(sorted(set(asked["key"].to_pylist()))))
    asked = index.sparkSession.createDataFrame(asked)
    hits = asked.join(index.withColumnRenamed("term", "key"), ["bucket", "key"])
    return hits.groupBy("term", "lane", "fact_key").agg(F.min("by_alias").alias("by_alias"))


def unmatched(index: DataFrame, terms: DataFrame) -> DataFrame:
    return terms.join(lookup(index, terms).select("term").distinct(), "term", "left_anti")


def expand_terms(parent: DataFrame, more: DataFrame) -> DataFrame:
    return parent.unionByName(more).distinct()


def exact_names(facts: DataFrame, id_col: str, names: DataFrame) -> DataFrame:
    """Facts whose identity equals a name, letter case included, by the digest of the identity; with the count per name."""
    keyed = facts.withColumn("digest", F.sha2(F.col(id_col), 256))
    asked = names.select("name", F.sha2("name", 256).alias("digest"))
    hits = asked.join(keyed, "digest").groupBy("name").agg(F.count_distinct("fact_key").alias("n"), F.min("fact_key").alias("least"))
    out = asked.select("name").join(hits, "name", "left")
    status = F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") == 1, "FOUND").otherwise("AMBIGUOUS")
    return out.select("name", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_matches"), F.when(F.col("n") == 1, F.col("least")).alias("fact_key"))


def fair(lanes: list[list], limit: int) -> list:
    """Round robin over lanes that may share items; what is chosen is passed over within the same turn."""
    chosen: dict = {}
    at = [0] * len(lanes)
    while len(chosen) < limit:
        before = len(chosen)
        for k, lane in enumerate(lanes):
            while at[k] < len(lane) and lane[at[k]] in chosen:
                at[k] += 1
            if at[k] < len(lane):
                chosen[lane[at[k]]] = None
                at[k] += 1
            if len(chosen) == limit:
                break
        if len(chosen) == before:
            break
    return sorted(chosen)


def diversify(hits: DataFrame, lane: str = "term", key: str = "fact_key") -> DataFrame:
    """Order within a lane that takes one of each family of keys in turn: adds ``turn`` and ``place``."""
    family = T.semantic_key(key)
    turn = F.row_number().over(Window.partitionBy(lane, "family").orderBy(key))
    ranked = hits.withColumn("family", family).withColumn("turn", turn)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(lane).orderBy("turn", "family")))


def fair_selection(hits: DataFrame, limit: int = PER_CONTEXT) -> DataFrame:
    """Facts chosen fairly over the terms that found them, in order of their keys.

    Each lane gives its first ``limit`` facts at most, as no more of it can be
    chosen, so the fold gets limit x QUERY_TERMS rows however large the index.
    """
    lanes = diversify(hits).where(F.col("place") <= limit).select("term", "fact_key", "place", F.lit(1).alias("query"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["term", "place"])
        chosen = fair([g["fact_key"].tolist() for _, g in pdf.groupby("term", sort=True)], limit)
        return pd.DataFrame({"fact_key": chosen, "position": range(1, len(chosen) + 1)})

    return lanes.groupBy("query").applyInPandas(fold, "fact_key string, position long")


def check_index(index: DataFrame, per_term: int = PER_TERM) -> DataFrame:
    """Postings that break the order, the limit or the routing of the index; none if it is sound."""
    w = Window.partitionBy("term").orderBy("place")
    looked = index.withColumn("before", F.lag("fact_key").over(w)).withColumn("earlier", F.lag("place").over(w))
    bad = F.when(F.col("bucket") != T.term_bucket("term"), "WRONG_BUCKET").when(F.col("place") > per_term, "TOO_MANY").when(F.col("before") > F.col("fact_key"), "OUT_OF_ORDER").when(F.col("place") != F.coalesce("earlier", F.lit(0)) + 1, "GAP")
    return looked.withColumn("problem", bad).where("problem is not null").select("term", "fact_key", "place", "problem")


def pack_shards(index: DataFrame, limit: int) -> DataFrame:
    """(bucket, shard, first_term, last_term, postings, bytes): terms of a bucket in order, as many to a shard as fit ``limit`` bytes.

    A bucket is routed by one byte of a digest; the fold reads a row per term.
    """
    sizes = index.groupBy("bucket", "term").agg(F.count("*").alias("n"), F.sum(F.octet_length("fact_key") + F.octet_length("lane")).alias("size"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("term")
        shard, used, no = [], 0, -1
        for size in pdf["size"]:
            if no < 0 or used + size > limit:
                no, used = no + 1, 0
            used += size
            shard.append(no)
        g = pdf.assign(shard=shard).groupby("shard")
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "shard": g["term"].first().index, "first_term": g["term"].first().values, "last_term": g["term"].last().values, "postings": g["n"].sum().values, "bytes": g["size"].sum().values})

    return sizes.groupBy("bucket").applyInPandas(fold, "bucket string, shard long, first_term string, last_term string, postings long, bytes long")
