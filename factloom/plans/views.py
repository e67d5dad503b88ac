"""The tables as the operators' inputs; each view is given once here and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.runtime import table

#: Facts: contexts with their intent and terms, by session.
FACTS_SQL = "facts as (select distinct session_id as lane, context_id as fact_key, intent, terms from contexts)"
#: Terms of facts: tokens and identifier parts.
SPLIT = r"string_split_regex(regexp_replace(regexp_replace(v, '([\p{Ll}\p{N}])(\p{Lu})', '\1_\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1_\2', 'g'), '[^\p{L}\p{N}]+')"
TERMS_SQL = (
    FACTS_SQL
    + r""", texts as (select lane, fact_key, intent as v from facts where intent is not null union all select lane, fact_key, unnest(terms) as v from facts),
tokens as (select lane, fact_key, unnest(string_split_regex(lower(v), '[^\p{L}\p{N}_]+')) as term from texts where v is not null
  union all select lane, fact_key, lower(unnest("""
    + SPLIT
    + r""")) as term from texts where v is not null),
terms as (select distinct lane, fact_key, term from tokens where strlen(term) >= 2)"""
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "contexts").select(F.col("session_id").alias("lane"), F.col("context_id").alias("fact_key"), "intent", "terms").distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(F.array("intent"), F.coalesce("terms", F.array().cast("array<string>")))
    return facts(spark, sf_dir).withColumn("texts", both)


#: Symbols of source files: one row per record of retained source.
SOURCES_SQL = "src as (select distinct id, service, revision, file, start_line, end_line, start_byte, end_byte, text, text_digest, snapshot from sources where id is not null)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sources").where("id is not null").select("id", "service", "revision", "file", "start_line", "end_line", "start_byte", "end_byte", "text", "text_digest", "snapshot").distinct()


#: A graph of orders: nation, customer, order, part, supplier.
EDGES_SQL = """edges as (select distinct source, target, kind from (
  select 'n' || c_nationkey as source, 'c' || c_custkey as target, 'CALLS' as kind from customer
  union all select 'c' || o_custkey, 'o' || o_orderkey, 'CALLS' from orders
  union all select 'o' || l_orderkey, 'p' || l_partkey, 'REFERENCES' from lineitem
  union all select 'p' || l_partkey, 's' || l_suppkey, 'READS' from lineitem
  union all select 's' || s_suppkey, 'n' || s_nationkey, 'WRITES' from supplier))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = lambda df, a, x, b, y, k: df.select(key(a, x).alias("source"), key(b, y).alias("target"), F.lit(k).alias("kind"))
    out = e(t("customer"), "n", "c_nationkey", "c", "c_custkey", "CALLS").unionByName(e(t("orders"), "c", "o_custkey", "o", "o_orderkey", "CALLS"))
    out = out.unionByName(e(t("lineitem"), "o", "l_orderkey", "p", "l_partkey", "REFERENCES")).unionByName(e(t("lineitem"), "p", "l_partkey", "s", "l_suppkey", "READS"))
    return out.unionByName(e(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", "WRITES")).distinct()


#: Two versions of the customers' order states, parted at a date.
HALF = "1998-01-01"
STATES_SQL = """orders_by as (select o_custkey, o_orderdate < (select min(o_orderdate) + (max(o_orderdate) - min(o_orderdate)) / 2 from orders) as early, count(*) as n, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities,
  string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as states from orders group by all),
before as (select o_custkey, n, priorities, states from orders_by where early), after as (select o_custkey, n, priorities, states from orders_by where not early)"""


def order_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(before, after): what customers ordered in the first and in the second half of the time."""
    o = table(spark, sf_dir, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    mid = o.agg(((F.min("us") + F.max("us")) / 2).alias("mid")).scalar()
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = o.withColumn("early", F.col("us") < mid).groupBy("o_custkey", "early").agg(F.count("*").alias("n"), names("o_orderpriority").alias("priorities"), names("o_orderstatus").alias("states"))
    return per.where("early").drop("early"), per.where("not early").drop("early")
