"""Queries on terms, the index, ranking and scalar functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import json as J
from factloom.functions import text as T
from factloom.operators import postings as P
from factloom.operators import ranking as R
from factloom.plans import views as V
from factloom.plans.views import FACTS_SQL, SOURCES_SQL, TERMS_SQL
from factloom.runtime import shared_dir, table

ASKED = ["session", "queue", "trackSession", "report", "frontier", "no_such_term"]
ASKED_SQL = "asked as (select unnest(['session', 'queue', 'tracksession', 'report', 'frontier', 'no_such_term']) as term)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("term_rows", f"with {TERMS_SQL} select lane, fact_key, term from terms")
def term_rows(spark: SparkSession, d: str) -> DataFrame:
    return P.term_rows(V.texts(spark, d))


@query("term_postings", f"""with {TERMS_SQL}, ranked as (select *, row_number() over (partition by term order by fact_key, lane) as place from terms)
select substr(sha256(term), 1, 2) as bucket, term, lane, fact_key, place::int as place from ranked where place <= 1024""")
def term_postings(spark: SparkSession, d: str) -> DataFrame:
    return P.postings(V.texts(spark, d))


@query("term_overflow", f"with {TERMS_SQL} select term, count(*) as n_facts from terms group by term having count(*) > 20")
def term_overflow(spark: SparkSession, d: str) -> DataFrame:
    return P.overflow_terms(V.texts(spark, d), 20)


def written(spark: SparkSession, d: str) -> DataFrame:
    """The index of the contexts, written once for each state of their table and read from then on."""
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/contexts.parquet")
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = f"{fs.makeQualified(source)} {fs.getContentSummary(source).getLength()} {fs.getFileStatus(source).getModificationTime()}"
    path = f"{shared_dir(spark)}/index/{hashlib.sha256(state.encode()).hexdigest()[:32]}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        P.write_index(P.postings(V.texts(spark, d)), path)
    return P.read_index(spark, path)


@query("index_write", f"with {TERMS_SQL}, ranked as (select *, row_number() over (partition by term order by fact_key, lane) as place from terms) select substr(sha256(term), 1, 1) as shard, count(*) as postings, count(distinct term) as terms from ranked where place <= 1024 group by 1")
def index_write(spark: SparkSession, d: str) -> DataFrame:
    """Writes the index, if it is not yet there, and says what its parts hold."""
    return written(spark, d).groupBy("shard").agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))


@query("index_problems", f"""with {TERMS_SQL}, ranked as (select *, row_number() over (partition by term order by fact_key, lane) as place from terms), kept as (select * from ranked where place <= 1024)
select term, fact_key, place::int as place, 'WRONG_BUCKET' as problem from kept where starts_with(term, 'q') union all select term, fact_key, (place + 2)::int, 'GAP' from kept where starts_with(term, 'k') and place = 1""")
def index_problems(spark: SparkSession, d: str) -> DataFrame:
    """The index with terms of one letter put into another bucket, and those of another numbered from 3."""
    moved = F.when(F.col("term").startswith("q"), F.concat(F.lit("x"), F.substring("bucket", 2, 1))).otherwise(F.col("bucket"))
    later = F.when(F.col("term").startswith("k"), F.col("place") + 2).otherwise(F.col("place"))
    return P.check_index(written(spark, d).drop("shard").withColumn("bucket", moved).withColumn("place", later))


@query("index_left_out", "select source as lane, doc_id::varchar as fact_key, 1 as payload, strlen(text)::int as bytes, 'PAYLOAD_TOO_LARGE' as reason from documents where strlen(text) > 8192")
def index_left_out(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("source").alias("lane"), F.col("doc_id").cast("string").alias("fact_key"), F.array("lang", "text").alias("texts"))
    return P.left_out(t, limit=8192)


@query("index_shards", fr"""with recursive {TERMS_SQL}, ranked as (select *, row_number() over (partition by term order by fact_key, lane) as place from terms), s as (select substr(sha256(term), 1, 2) as bucket, term, count(*) as n, sum(strlen(fact_key) + strlen(lane)) as size from ranked where place <= 1024 group by all),
o as (select *, row_number() over (partition by bucket order by term) as i from s), f(bucket, i, shard, used) as (select bucket, i, 0, size from o where i = 1 union all select o.bucket, o.i, case when used + size > 65536 then shard + 1 else shard end, case when used + size > 65536 then size else used + size end from f join o on o.bucket = f.bucket and o.i = f.i + 1)
select o.bucket, shard::bigint as shard, min(term) as first_term, max(term) as last_term, sum(n)::bigint as postings, sum(size)::bigint as bytes from o join f on f.bucket = o.bucket and f.i = o.i group by o.bucket, shard""")
def index_shards(spark: SparkSession, d: str) -> DataFrame:
    return P.pack_shards(written(spark, d), 64 * 1024)


@query("index_key_counts", f"with {TERMS_SQL} select count(distinct term) as terms, count(distinct lane) as lanes, count(distinct fact_key) as facts, count(*) as postings from terms")
def index_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.term_rows(V.texts(spark, d)).agg(F.count_distinct("term").alias("terms"), F.count_distinct("lane").alias("lanes"), F.count_distinct("fact_key").alias("facts"), F.count("*").alias("postings"))


LOOKUP_SQL = f"""with {TERMS_SQL}, {ASKED_SQL},
keys as (select term, term as key, 0 as by_alias from asked union all select term, replace(term, '_', ''), 1 from asked where contains(term, '_')),
kept as (select * from (select *, row_number() over (partition by term order by fact_key, lane) as place from terms) where place <= 1024),
hits as (select a.term, k.lane, k.fact_key, min(by_alias)::int as by_alias from keys a join kept k on k.term = a.key group by all)"""


@query("multi_term_lookup", f"{LOOKUP_SQL} select term, lane, fact_key, by_alias from hits")
def multi_term_lookup(spark: SparkSession, d: str) -> DataFrame:
    return P.lookup(written(spark, d), P.term_table(spark, ASKED))


@query("unmatched_terms", f"{LOOKUP_SQL} select term from asked where term not in (select term from hits)")
def unmatched_terms(spark: SparkSession, d: str) -> DataFrame:
    return P.unmatched(written(spark, d), P.term_table(spark, ASKED))


@query("expanded_terms", f"with {ASKED_SQL} select term from asked union select 'signal' union select 'kiln'")
def expanded_terms(spark: SparkSession, d: str) -> DataFrame:
    return P.expand_terms(P.term_table(spark, ASKED), P.term_table(spark, ["signal", "kiln", "Queue"]))


@query("fair_selection")
def fair_selection(spark: SparkSession, d: str) -> DataFrame:
    return P.fair_selection(P.lookup(written(spark, d), P.term_table(spark, ASKED)), 48)


@query("family_turns", """with f as (select distinct text_digest as fact_key, service as lane, regexp_replace(text_digest, ':[0-9a-f]{64}$', '') as family from sources where text_digest is not null and service is not null),
r as (select *, row_number() over (partition by lane, family order by fact_key) as turn from f)
select lane, fact_key, turn::int as turn, row_number() over (partition by lane order by turn, family)::int as place from r""")
def family_turns(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select(F.col("service").alias("lane"), F.col("text_digest").alias("fact_key")).where("lane is not null and fact_key is not null").distinct()
    return P.diversify(s, "lane").select("lane", "fact_key", "turn", "place")


NAMES_SQL = "names as (select distinct intent as name from contexts where intent is not null union select 'no such intent')"


@query("exact_name_lookup", f"""with {FACTS_SQL}, {NAMES_SQL}, m as (select intent, count(distinct fact_key) as n, min(fact_key) as least from facts group by intent)
select name, case when n is null then 'NOT_FOUND' when n = 1 then 'FOUND' else 'AMBIGUOUS' end as status, coalesce(n, 0) as n_matches, case when n = 1 then least end as fact_key from names left join m on intent = name""")
def exact_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    facts = V.facts(spark, d)
    names = facts.where("intent is not null").select(F.col("intent").alias("name")).union(spark.createDataFrame([("no such intent",)], "name string")).distinct()
    return P.exact_names(facts, "intent", names)


@query("rank_interleave", f"""with {FACTS_SQL}, s as (select *, len(terms) as n from facts where terms is not null), r as (select lane, fact_key, row_number() over (partition by lane order by n desc, fact_key) as turn from s)
select lane, fact_key, turn::int as turn, row_number() over (order by turn, lane)::int as position from (select * from r order by turn, lane limit 40)""")
def rank_interleave(spark: SparkSession, d: str) -> DataFrame:
    facts = V.facts(spark, d).where("terms is not null").withColumn("n", F.size("terms"))
    return R.interleave(facts, "lane", [F.desc("n"), "fact_key"], 40).select("lane", "fact_key", "turn", "position")


@query("lane_turns", """select o_orderpriority as lane, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey)::int as turn from orders""")
def lane_turns(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("lane", F.col("o_orderpriority"))
    return R.interleave(o, "lane", [F.desc("o_totalprice"), "o_orderkey"]).select("lane", "o_orderkey", "turn")


@query("top_per_key", """with r as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as place, count(*) over (partition by c_nationkey) as n from customer)
select c_nationkey, c_custkey, place::int as place, n > 3 as truncated from r where place <= 3""")
def top_per_key(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per(table(spark, d, "customer"), "c_nationkey", [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey", "place", "truncated")


RANK_TERMS = ["queue", "session", "report", "frontier"]


@query("topk_candidates", f"""with {FACTS_SQL}, s as (select *, lower(array_to_string(coalesce(terms, []), ' ')) as nm, lower(coalesce(intent, '')) as tx from facts),
v as (select lane, fact_key, {' + '.join(f"(contains(nm, '{t}') or contains(tx, '{t}'))::int" for t in RANK_TERMS)} as found, {' + '.join(f"contains(nm, '{t}')::int" for t in RANK_TERMS)} as named,
 {' + '.join(f"(length(nm) - length(replace(nm, '{t}', ''))) // {len(t)} + (length(tx) - length(replace(tx, '{t}', ''))) // {len(t)}" for t in RANK_TERMS)} as occ from s),
c as (select * from v where found > 0)
select lane, fact_key, found::int as found, named::int as named, occ::int as occurrences, row_number() over (order by found desc, named desc, occ desc, fact_key)::int as position, (select count(*) from c) as total, greatest((select count(*) from c) - 3, 0) as omitted
from c order by found desc, named desc, occ desc, fact_key limit 3""")
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_join(F.coalesce("terms", F.array().cast("array<string>")), " ")
    found, named, occ = R.relevance(names, F.col("intent"), RANK_TERMS)
    rows = V.facts(spark, d).select("lane", "fact_key", found.alias("found"), named.alias("named"), occ.alias("occurrences")).where("found > 0")
    return R.top(rows, [F.desc("found"), F.desc("named"), F.desc("occurrences"), F.col("fact_key")], 3)


@query("term_hits", f"""with {TERMS_SQL} select fact_key, list_sort(list(distinct term)) as hits from terms where term in ('frontier', 'queue', 'report', 'session') group by fact_key""")
def term_hits(spark: SparkSession, d: str) -> DataFrame:
    return V.texts(spark, d).select("fact_key", F.array_sort(R.term_hits(F.col("texts"), RANK_TERMS)).alias("hits")).where(F.size("hits") > 0)


@query("decision_authority", f"""with {FACTS_SQL}, {NAMES_SQL}, m as (select intent, count(distinct fact_key) as n from facts group by intent)
select name, case when coalesce(n, 0) = 0 then 'NO_EXACT_IDENTIFIER' when n > 1 then 'EXACT_IDENTIFIER_AMBIGUOUS' else 'SUPPORTED' end as decision from names left join m on intent = name""")
def decision_authority(spark: SparkSession, d: str) -> DataFrame:
    facts = V.facts(spark, d)
    names = facts.where("intent is not null").select(F.col("intent").alias("name")).union(spark.createDataFrame([("no such intent",)], "name string")).distinct()
    hits = P.exact_names(facts, "intent", names)
    return hits.select("name", R.decision(1, F.lit(0), F.lit(False), F.col("n_matches"), F.lit(1)).alias("decision"))


@query("json_score", rf"""with l as (select record_id, lower(json_extract_string(t.atom, '$')) as v, regexp_extract(regexp_replace(t.fullkey, '(\[\d+\])+$', ''), '([^.\]]+)$', 1) as key from (select distinct record_id, body::json as j from work_records where json_valid(body)) b, json_tree(b.j) t where t.type = 'VARCHAR'), w as (select record_id, case when key in ('symbolIdentity', 'compilerCallableId', 'compilerClassId', 'ownerIdentity') then 16 when key in ('path', 'file', 'fileId', 'relativePath', 'sourcePath') then 8 when key in ('name', 'declarationKind') then 6 when key in ('sourceSet', 'module', 'provider', 'schema') then 0 else 1 end * (contains(v, 'antenna')::int + contains(v, 'java')::int + contains(v, 'service')::int) as n from l)
select distinct r.record_id, coalesce(s.n, 0)::bigint as score from work_records r left join (select record_id, sum(n) as n from w group by record_id) s using (record_id)""")
def json_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_records").select("record_id", J.weighted_score(F.col("body"), ["antenna", "java", "service"]).alias("score")).distinct()


@query("json_strings", r"""with b as (select distinct manifest_id, body from publication_manifests), l as (select distinct manifest_id, body, json_extract_string(t.atom, '$') as v from (select manifest_id, body, body::json as j from b where json_valid(body)) b, json_tree(b.j) t where t.type = 'VARCHAR')
select manifest_id, case when json_valid(body) then coalesce((select list_sort(list(v)) from l where l.manifest_id = b.manifest_id and l.body = b.body and not regexp_full_match(v, 'sha256:[0-9a-f]{64}')), []) end as strings from b""")
def json_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "publication_manifests").select("manifest_id", J.json_strings("body").alias("strings")).distinct()


@query("canonical_digest")
def canonical_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "publication_manifests").select("manifest_id", J.canonical_digest("body").alias("digest")).distinct()


FORM_SQL = """select p_partkey, '{"a":[' || p_size || ',{"b":"' || p_name || '","z":null}],"k":{"q":true},"n":"é"}' as form from part"""


def _forms(spark: SparkSession, d: str) -> DataFrame:
    """JSON of parts with keys out of order, white space, an escape and members that say where it was found."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.concat(F.lit('{"n": "\\u00e9", "file": "x", "k":\n{"start": [1, 2], "q" :true, "end":{"q":1}}, "a" : [ '), F.col("p_size").cast("string"), F.lit(', {"z":null,"orderKey":7 , "b":"'), "p_name", F.lit('"} ], "sourceProvenance":{"a":1}}')).alias("j"))


@query("stripped_forms", FORM_SQL)
def stripped_forms(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("p_partkey", J.strip_source("j").alias("form"))


@query("canonical_forms", """select p_partkey, f as form, 'sha256:' || sha256(f) as digest, null::varchar as twice from (select p_partkey, '{"a":[' || p_size || ',{"b":"' || p_name || '","orderKey":7,"z":null}],"file":"x","k":{"end":{"q":1},"q":true,"start":[1,2]},"n":"é","sourceProvenance":{"a":1}}' as f from part)""")
def canonical_forms(spark: SparkSession, d: str) -> DataFrame:
    forms = _forms(spark, d)
    twice = F.replace("j", F.lit('"file": "x"'), F.lit('"n": "x"'))
    return forms.select("p_partkey", J.canonical_json("j").alias("form"), J.canonical_digest("j").alias("digest"), J.canonical_json(twice).alias("twice"))


@query("strip_source")
def strip_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_records").select("record_id", J.strip_source("body").alias("body")).distinct()


@query("identifier_split", rf"""with v as (select distinct unnest(terms) as v from contexts), p as (select v, lower(unnest({V.SPLIT})) as part from v)
select v as identifier, list_sort(list(distinct part)) as parts from p where strlen(part) between 2 and 256 group by v""")
def identifier_split(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "contexts").select(F.explode("terms").alias("identifier")).distinct()
    return v.select("identifier", T.identifier_parts(F.array("identifier")).alias("parts")).where(F.size("parts") > 0)


@query("hash_bucket", f"""with {FACTS_SQL} select distinct fact_key, substr(sha256(fact_key), 1, 2) as bucket, ('0x' || substr(sha256(fact_key), 1, 2))::int % 64 as slot, 'sha256:' || sha256(fact_key) as digest from facts""")
def hash_bucket(spark: SparkSession, d: str) -> DataFrame:
    return V.facts(spark, d).select("fact_key", T.term_bucket("fact_key").alias("bucket"), T.key_bucket("fact_key").alias("slot"), T.content_digest("fact_key").alias("digest")).distinct()


@query("object_digest", f"""with {SOURCES_SQL} select distinct id, 'sha256:' || sha256(encode('object/1:' || coalesce(service, 'none')) || '\\x00'::blob || encode(text)) as digest from src where text is not null""")
def object_digest(spark: SparkSession, d: str) -> DataFrame:
    return V.sources(spark, d).where("text is not null").select("id", T.object_digest("object/1:", F.coalesce("service", F.lit("none")), "text").alias("digest")).distinct()


PATHS = "(select distinct '/' || replace(file, '\\', '/') as path, '/{' || split_part(replace(file, '\\', '/'), '/', 2) || '}/' || split_part(replace(file, '\\', '/'), '/', 3) as template from sources where file is not null)"


@query("path_key_normalise", rf"""with p as (select path from {PATHS} union select template from {PATHS}), q as (select path, string_split(path, '/') as parts from p)
select path, case when starts_with(path, '/') and len(list_filter(parts, lambda x: not regexp_full_match(x, '\{{[A-Za-z0-9_]+\}}') and regexp_matches(x, '[{{}}*?:#$%\\]'))) = 0
 then array_to_string(list_transform(parts, lambda x: case when regexp_full_match(x, '\{{[A-Za-z0-9_]+\}}') then '{{}}' else x end), '/') end as path_key from q""")
def path_key_normalise(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "sources").where("file is not null").select(F.replace("file", F.lit("\\"), F.lit("/")).alias("f"))
    part = lambda n: F.split_part("f", F.lit("/"), F.lit(n))
    paths = f.select(F.concat(F.lit("/"), "f").alias("path")).union(f.select(F.concat(F.lit("/{"), part(2), F.lit("}/"), part(3)).alias("path"))).distinct()
    return paths.select("path", T.path_key("path").alias("path_key"))


@query("joined_paths", r"""with s as (select distinct service, file from sources where service is not null and file is not null)
select service, file, case when not regexp_matches(service || file, '[$#]\{') and not regexp_matches(service, '[*?]') and file <> '' then rtrim('/' || ltrim(service, '/'), '/') || '/' || ltrim(file, '/') end as path,
 rtrim(ltrim(file, '/'), '/') as template, case when not regexp_matches(service || file, '[\[\]]') then '/docs/' || service || '/[x]/' || file end as filled from s""")
def joined_paths(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("service is not null and file is not null").select("service", "file").distinct()
    return s.select("service", "file", T.join_path(F.concat("service", F.lit("/*")), "file").alias("path"), T.join_template("service", F.concat(F.lit("~/"), "file")).alias("template"), T.fill_template(F.lit("[Area]/[controller]/[[x]]/[action]"), "service", "file", F.lit("docs")).alias("filled"))


@query("source_links", r"""select distinct id, case when regexp_full_match(revision, '[0-9a-fA-F]{40}|[0-9a-fA-F]{64}') and start_line > 0 and end_line >= start_line and not regexp_matches(file, '^/|(^|/)\.\.?(/|$)|\\')
 then 'https://git.example.org/docs/' || 'core' || '/blob/' || revision || '/' || file || '#L' || start_line || '-L' || end_line end as link from sources""")
def source_links(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.select("id", T.permalink(F.lit("github"), F.lit("https://git.example.org/docs/core/"), "revision", "file", "start_line", "end_line").alias("link")).distinct()


@query("escaped_html", "select distinct id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as html from sources")
def escaped_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", T.escape_html("text").alias("html")).distinct()


@query("access_classes", r"""with t as (select distinct unnest(terms) as name from contexts)
select name, case when regexp_matches(name, '^(set|update|save|add|remove|close|delete|builder|build|<init>)') then 'W' when regexp_matches(name, '^(get|find|is|has|contains|load)') then 'R' end as access,
 case when name = 'IF' then 'D' when regexp_matches(name, '^(set|update|save|add|remove|close|delete|builder|build|<init>)') then 'W' when regexp_matches(name, '^(get|find|is|has|contains|load)') then 'R' end as step from t""")
def access_classes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "contexts").select(F.explode("terms").alias("name")).distinct()
    return t.select("name", T.access_class("name").alias("access"), T.step_class(F.lit("CALL"), F.concat(F.lit("Owner#"), "name", F.lit("(int)"))).alias("step"))


@query("plain_names", "with t as (select distinct unnest(terms) as name from contexts) select name, replace(lower(name), '_', '') as plain from t")
def plain_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contexts").select(F.explode("terms").alias("name")).distinct().select("name", T.plain_name("name").alias("plain"))


@query("descriptors", """select p_partkey, '(I[Lcom/' || regexp_replace(p_name, '[^A-Za-z]+', '/', 'g') || ';[[J)' || case when p_size % 3 = 0 then 'V' else 'Ljava/lang/String;' end as descriptor, true as valid, ['int', 'com.' || replace(regexp_replace(p_name, '[^A-Za-z]+', '/', 'g'), '/', '.') || '[]', 'long[][]'] as parameters from part""")
def descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Method descriptors made of the names of parts and their sizes."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("(I[Lcom/"), F.regexp_replace("p_name", "[^A-Za-z]+", "/"), F.lit(";[[J)"), F.when(F.col("p_size") % 3 == 0, "V").otherwise("Ljava/lang/String;")).alias("descriptor"))
    return p.select("p_partkey", "descriptor", T.valid_descriptor("descriptor").alias("valid"), T.descriptor_parameters("descriptor").alias("parameters"))


@query("byte_previews", r"""with t as (select doc_id, text, hex(encode(text)) as h from documents where text is not null), c as (select *, case when strlen(text) <= 2048 then strlen(text) when not substr(h, 4097, 1) between '8' and 'B' then 2048 when not substr(h, 4095, 1) between '8' and 'B' then 2047 when not substr(h, 4093, 1) between '8' and 'B' then 2046 else 2045 end as n from t)
select doc_id, decode(unhex(substr(h, 1, 2 * n))) as preview, strlen(text) > 2048 as truncated from c""")
def byte_previews(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", T.byte_prefix("text", 2048).alias("preview"), (F.octet_length("text") > 2048).alias("truncated"))


@query("line_numbers", r"""with s as (select distinct id, text from sources where id is not null and text is not null), p as (select id, regexp_replace(substr(hex(encode(text)), 1, 2 * (strlen(text) // 2)), '(..)', '\1 ', 'g') as pairs from s)
select id, ((len(pairs) - len(replace(pairs, '0A ', ''))) // 3 + 1)::int as line from p""")
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The line in each text where its second half begins, by bytes."""
    s = V.sources(spark, d).where("text is not null").select("id", "text").distinct()
    return s.select("id", T.line_at("text", (F.octet_length("text") / 2).cast("int")).alias("line"))


@query("first_bytes", "with s as (select distinct id, text from sources where text is not null) select id, case when position('return' in text) > 0 then strlen(left(text, position('return' in text)::int - 1))::bigint end as at from s")
def first_bytes(spark: SparkSession, d: str) -> DataFrame:
    s = V.sources(spark, d).where("text is not null").select("id", "text").distinct()
    return s.select("id", T.find_bytes("text", F.lit("return")).alias("at"))


@query("safe_addresses", r"""select distinct service, regexp_full_match('https://' || service || '.example.org/' || coalesce(file, ''), 'https://[^/@?#\\\s]+(/[^?#\\\s]*)?') as safe from sources where service is not null""")
def safe_addresses(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("service is not null")
    return s.select("service", T.safe_url(F.concat(F.lit("https://"), "service", F.lit(".example.org/"), F.coalesce("file", F.lit("")))).alias("safe")).distinct()
