"""Queries on hierarchies, drifting schemas and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import drift, hierarchy, nested
from factloom.runtime import table

MANIFEST_COLUMNS = ["schema", "id", "parent", "ordinal", "inputDigest", "released", "documentationLanguage", "evidencePackages", "files"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = hierarchy.nodes(table(spark, sf_dir, "publications"), "PUBLICATION", "id", "parent", "loaded_at")
    return hierarchy.link(both.unionByName(hierarchy.nodes(table(spark, sf_dir, "contexts"), "CONTEXT", "context_id", "parent_context_id", "loaded_at")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.separate(_records(spark, sf_dir)).select(F.col("kind").alias("record_kind"), F.col("id").alias("node_id"), "cycle_key")


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _records(spark, sf_dir)
    return hierarchy.decompose(links, hierarchy.separate(links))


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.report(_full(spark, sf_dir)).drop("tree_pos")


#: The rows whose descendants are asked for: those whose id has a digest divisible by 100.
ASKED_SQL = "('0x' || substr(md5({0}), 1, 8))::bigint % 100 = 0"


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 100 == 0
    return hierarchy.descendants(_full(spark, sf_dir), asked).withColumnRenamed("kind", "record_kind")


#: Places in a block where every row asks: of the rows that meet in a small block most are an ancestor and its descendant.
ALL_BLOCK = 64


def p3_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descendants of every record; ``p3_descendants`` has those of the rows that its SQL asks for."""
    return hierarchy.descendants(_full(spark, sf_dir), F.lit(True), ALL_BLOCK).withColumnRenamed("kind", "record_kind")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "publication_manifests"))


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = drift.unify(table(spark, sf_dir, "publication_manifests"), MANIFEST_COLUMNS)
    flag = F.lower(F.trim("released"))
    return df.withColumn("released", F.when(flag.isin("true", "1", "yes"), True).when(flag.isin("false", "0", "no"), False)).withColumn("ordinal", F.expr("try_cast(ordinal as bigint)"))


def _relations(spark: SparkSession, sf_dir: str) -> nested.Relations:
    return nested.relations(table(spark, sf_dir, "work_records"), "record_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.links(_relations(spark, sf_dir))


def p5_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.table_of(_relations(spark, sf_dir), "fragment", ["id", "subject", "text"]).drop("row_no", "parent_row", "ordinal")


def p5_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _relations(spark, sf_dir)
    names = ["id", "textDigest", "occurrence.snapshot", "occurrence.startByte", "occurrence.endByte", "occurrence.generatedOrigin"]
    out = nested.table_of(found, "source", names)
    return out.withColumnsRenamed({n: n.replace(".", "_") for n in names}).drop("row_no", "parent_row", "ordinal", "path")


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and records of each table of the work records."""
    rows = _relations(spark, sf_dir).rows
    return rows.groupBy("table_name", "parent_table").agg(F.count("*").alias("n_rows"), F.count_distinct("record_id").alias("n_records"))


_SPELLED = r"nullif(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '^(publication:|context:)\s*', ''), '')"
RECORDS_SQL = f"""recs as (select distinct 'PUBLICATION' as k, id as node, {_SPELLED.format('id')} as key, {_SPELLED.format('parent')} as up from publications where id is not null
  union all select distinct 'CONTEXT', context_id, {_SPELLED.format('context_id')}, {_SPELLED.format('parent_context_id')} from contexts where context_id is not null),
tree as (select r.k, r.key, p.key as up from recs r join recs p on p.k = r.k and p.key = r.up), walk(k, key, anc) as (select k, key, up from tree union select w.k, w.key, t.up from walk w join tree t on t.k = w.k and t.key = w.anc),
ring as (select k, key from walk where key = anc)"""
#: Ancestors of each record with the rings cut.
PATHS_SQL = f"""{RECORDS_SQL}, cut as (select * from tree where (k, key) not in (select k, key from ring)), ups(k, key, anc, dist) as (select k, key, key, 0 from recs union all select u.k, u.key, c.up, dist + 1 from ups u join cut c on c.k = u.k and c.key = u.anc)"""
QUERIES = {"p5_found": p5_found, "p5_fragments": p5_fragments, "p5_sources": p5_sources, "p5_tables": p5_tables, "p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants, "p3_all_descendants": p3_all_descendants, "p4_found": p4_found, "p4_unified": p4_unified}
_LIST = "case json_type({0}) when 'ARRAY' then from_json({0}, '[\"json\"]') when 'NULL' then [] else [{0}] end"
NESTED_SQL = f"""raw as (select distinct record_id, case when json_type(body::json) = 'VARCHAR' then json_extract_string(body::json, '$')::json else body::json end as j from (select * from work_records where record_id is not null and json_valid(body))),
top as (select record_id, json_extract(j, '$.record.fragment') as x, json_extract(j, '$.source') as s from raw),
frag(record_id, parent_id, f) as (select record_id, record_id, unnest({_LIST.format('x')}) from top where x is not null
  union all select record_id, json_extract_string(f, '$.id'), unnest({_LIST.format("(json_extract(f, '$.fragments'))")}) from frag where json_type(f) = 'OBJECT' and json_extract(f, '$.fragments') is not null),
own as (select record_id, parent_id, f from frag where json_type(f) = 'OBJECT'),
ids(record_id, parent_id, link, v) as (select record_id, json_extract_string(f, '$.id'), 'SOURCE', coalesce(json_extract(f, '$.sourceIds'), json_extract(f, '$.source_ids')) from own union all select record_id, json_extract_string(f, '$.id'), 'DEPENDENCY', coalesce(json_extract(f, '$.dependencyIds'), json_extract(f, '$.dependency_ids')) from own
  union all select record_id, parent_id, link, unnest(from_json(v, '["json"]')) from ids where json_type(v) = 'ARRAY'),
src as (select record_id, unnest({_LIST.format('s')}) as o from top where s is not null),
links as (select record_id, parent_id, 'FRAGMENT' as link, json_extract_string(f, '$.id') as child_id from own
  union all select record_id, parent_id, link, case json_type(v) when 'OBJECT' then json_extract_string(v, '$.id') else json_extract_string(v, '$') end from ids where json_type(v) not in ('ARRAY', 'NULL')
  union all select record_id, json_extract_string(o, '$.id'), 'OCCURRENCE', coalesce(json_extract_string(o, '$.occurrence.startByte'), json_extract_string(o, '$.occurrence.start_byte')) from src)"""
SQL: dict[str, str] = {
    "p3_found": f"with recursive {RECORDS_SQL} select r.k as record_kind, n.node as node_id, min(a.node) as cycle_key from ring r join walk w on w.k = r.k and w.key = r.key join recs n on n.k = r.k and n.key = r.key join recs a on a.k = w.k and a.key = w.anc group by all",
    "p3_hierarchy": f"""with recursive {PATHS_SQL}, p as (select u.k, u.key, max(dist) as depth, string_agg(a.node, '/' order by dist desc) as path, arg_max(a.node, dist) as root_id, arg_max(a.key, dist) as root_key from ups u join recs a on a.k = u.k and a.key = u.anc group by u.k, u.key),
below as (select k, anc, count(*) - 1 as n from ups group by all)
select r.k as record_kind, r.node as node_id, pr.node as parent_id, root_id, depth::bigint as depth, path, b.n as n_descendants,
 case when (r.k, r.key) in (select k, key from ring) then 'ON_CYCLE' when (p.k, p.root_key) in (select k, key from ring) then 'LEADS_TO_CYCLE' when r.up is not null and t.up is null then 'ORPHAN_ROOT' else 'TREE' end as status
from recs r join p on p.k = r.k and p.key = r.key join below b on b.k = r.k and b.anc = r.key left join tree t on t.k = r.k and t.key = r.key left join cut c on c.k = r.k and c.key = r.key left join recs pr on pr.k = c.k and pr.key = c.up""",
    "p3_descendants": f"with recursive {PATHS_SQL} select u.k as record_kind, a.node as node_id, n.node as descendant_id, dist::bigint as distance from ups u join recs a on a.k = u.k and a.key = u.anc join recs n on n.k = u.k and n.key = u.key where dist > 0 and {ASKED_SQL.format('a.node')}",
    "p3_all_descendants": f"with recursive {PATHS_SQL} select u.k as record_kind, a.node as node_id, n.node as descendant_id, dist::bigint as distance from ups u join recs a on a.k = u.k and a.key = u.anc join recs n on n.k = u.k and n.key = u.key where dist > 0",
    "p5_found": f"with recursive {NESTED_SQL} select distinct record_id, parent_id, link, child_id from links where parent_id is not null and child_id is not null",
    "p5_fragments": f"""with recursive {NESTED_SQL} select record_id, case when parent_id = record_id then 'root' else 'fragment' end as parent_table, case when parent_id = record_id then 'record.fragment' else 'fragment' end as path,
 json_extract_string(f, '$.id') as id, json_extract_string(f, '$.subject') as subject, json_extract_string(f, '$.text') as text from own""",
    "p5_sources": f"""with recursive {NESTED_SQL} select record_id, 'root' as parent_table, json_extract_string(o, '$.id') as id, coalesce(json_extract_string(o, '$.textDigest'), json_extract_string(o, '$.text_digest')) as "textDigest",
 json_extract_string(o, '$.occurrence.snapshot') as occurrence_snapshot, coalesce(json_extract_string(o, '$.occurrence.startByte'), json_extract_string(o, '$.occurrence.start_byte')) as "occurrence_startByte",
 coalesce(json_extract_string(o, '$.occurrence.endByte'), json_extract_string(o, '$.occurrence.end_byte')) as "occurrence_endByte", coalesce(json_extract_string(o, '$.occurrence.generatedOrigin'), json_extract_string(o, '$.occurrence.generated_origin')) as "occurrence_generatedOrigin" from src where json_type(o) <> 'NULL'""",
    "p5_tables": f"""with recursive {NESTED_SQL}, l as (select 'root' as table_name, null as parent_table, record_id from raw where json_type(j) = 'OBJECT' union all select 'fragment', case when parent_id = record_id then 'root' else 'fragment' end, record_id from own
  union all select case link when 'SOURCE' then 'sourceId' else 'dependencyId' end, 'fragment', record_id from ids where json_type(v) not in ('ARRAY', 'NULL') union all select 'source', 'root', record_id from src where json_type(o) <> 'NULL')
select table_name, parent_table, count(*) as n_rows, count(distinct record_id) as n_records from l group by all""",
}
