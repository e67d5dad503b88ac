"""The queries of the training-text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import leaks, packing, pieces, prose, spans
from factloom.runtime import table


_SPANS = """t as (select id, any_value(text) as text from sources where id is not null and text is not null group by id), w as (select id, unnest(range(0, length(text) - 199)) as i, text from t where length(text) >= 200), g as (select id, i, substr(text, i::int + 1, 200) as gram from w),
s as (select gram from g group by gram having count(distinct id) > 1), p as (select id, i from g where gram in (select gram from s)), m as (select *, case when i > lag(i) over (partition by id order by i) + 200 or lag(i) over (partition by id order by i) is null then 1 else 0 end as new from p),
n as (select *, sum(new) over (partition by id order by i) as island from m), spans as (select id as source_id, min(i) as start_char, max(i) + 200 as end_char from n group by id, island)"""
P1_FOUND = f"with {_SPANS} select source_id, start_char, end_char from spans"
P1_SUMMARY = f"with {_SPANS}, c as (select source_id, sum(end_char - start_char)::bigint as shared_chars, count(*) as runs from spans group by source_id) select source_id, length(text) as n_chars, shared_chars, runs, round(shared_chars / length(text), 6) as shared_share from c join t on id = source_id"
P2_FOUND = r"""
with parts as (select id, unnest(string_split_regex(text, '[ \t\r\n]')) as part from sources where id is not null and strlen(text) > 8192)
select id as source_id, case when max(strlen(part)) > 8192 then 'forced' else 'natural' end as boundary from parts group by id
"""


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "sources"))


def p1_without_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p1_found, with all anchors taking the way of the frequent ones."""
    return spans.shared_spans(table(spark, sf_dir, "sources"), pair_limit=1)


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_summary(table(spark, sf_dir, "sources"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.boundary_kind(table(spark, sf_dir, "sources"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(table(spark, sf_dir, "sources"))


P2_REBUILT = "select id as source_id, sha256(any_value(text)) as digest, true as fits, true as overlaps, true as continued from sources where id is not null and strlen(text) > 8192 group by id"


def p2_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of a text give when put together without their overlaps, and whether all keep to the rules."""
    p = p2_pieces(spark, sf_dir)
    own = Window.partitionBy("source_id").orderBy("piece")
    p = p.withColumn("before", F.coalesce(F.lag("endByte").over(own), F.lit(0))).withColumn("next", F.lead("startByte").over(own))
    fresh = F.encode("text", "UTF-8").substr((F.col("before") - F.col("startByte") + 1).cast("int"), (F.col("endByte") - F.col("before")).cast("int"))
    fits = (F.col("endByte") - F.col("startByte") <= pieces.LIMIT) & (F.octet_length("text") == F.col("endByte") - F.col("startByte"))
    overlaps = F.col("startByte").between(F.col("before") - pieces.OVERLAP, F.col("before"))
    continued = F.when(F.col("next").isNull(), F.col("nextCursor").isNull()).otherwise(F.contains("nextCursor", F.concat(F.lit(":"), F.col("next").cast("string"), F.lit(":"))))
    rows = p.select("source_id", "piece", F.hex(fresh).alias("fresh"), fits.alias("fits"), overlaps.alias("overlaps"), continued.alias("continued"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "fresh"))), lambda x: x["fresh"]), "")
    return rows.groupBy("source_id").agg(F.sha2(F.unhex(joined), 256).alias("digest"), F.bool_and("fits").alias("fits"), F.bool_and("overlaps").alias("overlaps"), F.bool_and("continued").alias("continued"))


P6_PLACED = "select distinct doc_id, true as whole, true as fits from documents where doc_id is not null and text <> ''"


def p6_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text is there once with all its tokens, in parts only above the capacity, in containers that are not overfull."""
    placed = p6_containers(spark, sf_dir).where("container_id is not null")
    used = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    sizes = packing.token_counts(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("n_tokens").alias("size"))
    own = placed.join(used, "container_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("parts"), F.max("part").alias("last"), F.max("used").alias("used"))
    need = F.ceil(F.col("size") / packing.CAPACITY)
    whole = (F.col("tokens") == F.col("size")) & (F.col("parts") == need) & (F.col("last") == need - 1)
    return sizes.where("size > 0").join(own, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce(F.col("used") <= packing.CAPACITY, F.lit(False)).alias("fits"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, sf_dir))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_report(spark, sf_dir).select("doc_id", "item_id")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.text_stats(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_stats(spark, sf_dir).where("not is_prose").select("doc_id")


P8_COUNTS = r"""
select doc_id, length(text) as n_chars, case when trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' then 0 else len(regexp_extract_all(text, '\p{L}+')) end as n_words,
 case when trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' then round(len(regexp_extract_all(text, '\d')) / length(text), 6) end as digit_ratio from documents where doc_id is not null
"""


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_stats(spark, sf_dir).select("doc_id", "n_chars", "n_words", F.round("digit_ratio", 6).alias("digit_ratio"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_without_pairs": p1_without_pairs, "p1_summary": p1_summary, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rebuilt": p2_rebuilt, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_placed": p6_placed, "p7_found": p7_found, "p7_report": p7_report, "p8_found": p8_found, "p8_stats": p8_stats, "p8_counts": p8_counts}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_without_pairs": P1_FOUND, "p1_summary": P1_SUMMARY, "p2_found": P2_FOUND, "p2_rebuilt": P2_REBUILT, "p6_placed": P6_PLACED, "p8_counts": P8_COUNTS}
