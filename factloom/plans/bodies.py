"""Queries on source windows, callable bodies, ledgers, packages and entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import content_digest
from factloom.operators import dataflow as D
from factloom.operators import ledger as L
from factloom.operators import matching as M
from factloom.operators import windows as W
from factloom.plans import views as V
from factloom.sources import entries as E
from factloom.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TERMS = ["return", "ledger", "throw"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("source_windows")
def source_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each text around its own middle line, as if a declaration stood there."""
    s = V.sources(spark, d).where("text is not null").select("id", "text").distinct()
    mid = (F.regexp_count("text", F.lit("\n")) / 2).cast("long") + 1
    return W.source_windows(s.withColumn("ranges", F.array(F.struct(mid.alias("first"), mid.alias("last")))), "id", "text", "ranges", TERMS)


@query("declaration_windows", r"""with s as (select distinct id, text from sources where id is not null and text is not null and text <> ''), l as (select id, text, string_split(case when ends_with(text, chr(10)) then text[:-2] else text end, chr(10)) as lines, (len(text) - len(replace(text, chr(10), ''))) // 2 + 1 as mid from s),
w as (select *, strlen(text) <= 8192 as small, case when mid <= len(lines) then mid else 1 end as spot from l), x as (select id, text, lines, small, case when small then 1 else greatest(1, spot - 8) end as a, case when small then len(lines) else least(len(lines), spot + 24) end as b from w)
select id, a::bigint as first_line, b::bigint as last_line, array_to_string(lines[a:b], chr(10)) as text from x""")
def declaration_windows(spark: SparkSession, d: str) -> DataFrame:
    """As source_windows, without terms."""
    s = V.sources(spark, d).where("text is not null").select("id", "text").distinct()
    mid = F.floor(F.regexp_count("text", F.lit("\n")) / 2) + 1
    return W.source_windows(s.withColumn("ranges", F.array(F.struct(mid.alias("first"), mid.alias("last")))), "id", "text", "ranges", [])


@query("term_anchors")
def term_anchors(spark: SparkSession, d: str) -> DataFrame:
    return W.term_anchors(V.sources(spark, d).where("text is not null").select("id", "text").distinct(), "id", "text", TERMS)


@query("bound_arguments", """with c as (select o_orderkey as call, o_custkey as target, o_orderkey % 4 as n from orders), f as (select c_custkey as target, unnest(range(0, 2)) as slot from customer where c_acctbal >= 0),
a as (select call, target, unnest(range(0, n)) as slot from c), w as (select call, slot from c join f using (target)), j as (select coalesce(a.call, w.call) as call, coalesce(a.slot, w.slot) as slot, a.call is not null as given, w.call is not null as wanted from a full join w on a.call = w.call and a.slot = w.slot)
select j.call, j.slot::int as slot, case when given then 'a' || j.slot end as argument, case when wanted then 'f' || j.slot end as formal,
 case when c.target not in (select target from f) then 'TARGET_UNKNOWN' when not wanted then 'EXTRA_ARGUMENT' when not given then 'MISSING_ARGUMENT' else 'BOUND' end as status from j join c on c.call = j.call""")
def bound_arguments(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("o_orderkey") % 4).cast("int")
    args = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit("a"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("target"), args.alias("arguments"))
    formals = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("target"), F.explode(F.array(F.lit(0), F.lit(1))).alias("slot"))
    return D.bind_arguments(calls, formals.withColumn("formal", F.concat(F.lit("f"), F.col("slot").cast("string"))))


@query("joined_paths_of_values", """with p as (select l_orderkey as k, l_linestatus as path, l_shipmode_ as storage, max(l_returnflag) as definition from (select *, case when l_quantity > 25 then 'big' else 'small' end as l_shipmode_ from lineitem) group by all),
n as (select k, count(distinct path) as n from p group by k), q as (select k, storage, count(distinct path) as having_, count(distinct definition) as vals, min(definition) as one from p group by all)
select k, storage, case when vals = 1 and having_ = n then 'SAME' else 'CHOICE' end as kind, case when vals = 1 and having_ = n then one end as definition from q join n using (k)""")
def joined_paths_of_values(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("path"), F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("storage"), F.col("l_returnflag").alias("definition"))
    paths = l.groupBy("k", "path", "storage").agg(F.max("definition").alias("definition")).withColumn("guards", F.array("path"))
    return D.join_paths(paths, ["k"]).select("k", "storage", "kind", "definition")


@query("outlines", r"""with recursive s as (select distinct service || '/' || file as owner, id, start_byte as a, end_byte as b from sources where service is not null and file is not null and id is not null and start_byte is not null and end_byte > start_byte), o as (select *, row_number() over (partition by owner order by a, b desc, id) as i from s),
p as (select o.owner, o.id, o.i, max(x.i) as up from o left join o x on x.owner = o.owner and x.i < o.i and x.b >= o.b group by all), d(owner, i, depth) as (select owner, i, 0 from p where up is null union all select p.owner, p.i, depth + 1 from d join p on p.owner = d.owner and p.up = d.i)
select p.owner, p.id, q.id as parent, depth::int as depth, (row_number() over (partition by p.owner, p.up order by p.i) - 1)::int as ordinal from p join d on d.owner = p.owner and d.i = p.i left join o q on q.owner = p.owner and q.i = p.up""")
def outlines(spark: SparkSession, d: str) -> DataFrame:
    """Nesting of the records of a file by their byte ranges."""
    s = table(spark, d, "sources").where("service is not null and file is not null and id is not null and start_byte is not null and end_byte > start_byte")
    rows = s.select(F.concat_ws("/", "service", "file").alias("owner"), "id", F.col("start_byte").alias("first"), F.col("end_byte").alias("last")).distinct()
    return rows.groupBy("owner").applyInPandas(D.outline, "owner string, id string, parent string, depth int, ordinal int")


@query("last_definitions", """with e as (select distinct user_id::varchar as owner, ts, event_id, event_type as name, value > 50 as def from events), r as (select owner, event_id as ordinal, name, def, max(case when def then event_id end) over (partition by owner, name order by event_id rows between unbounded preceding and 1 preceding) as defined_at from e)
select owner, ordinal, name, defined_at from r where not def""")
def last_definitions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("name"), F.when(F.col("value") > 50, "DEFINE").otherwise("USE").alias("op"))
    return D.alias_chains(e, "owner")


@query("proposed_graph_problems", """with g as (select o_custkey as graph, 'o' || o_orderkey as node from orders), e as (select o_custkey as graph, 'o' || o_orderkey as source, 'x' as target from orders where o_orderstatus = 'P')
select graph, 'TOO_MANY_NODES' as problem, count(*)::varchar as subject from g group by graph having count(*) > 64 union all select graph, 'EDGE_WITHOUT_NODE', 'x' from e group by graph union all select o_custkey, 'CLAIM_WITHOUT_NODE', 'o' || (o_orderkey + 1000000000) from orders where o_orderstatus = 'P'""")
def proposed_graph_problems(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = lambda c: F.concat(F.lit("o"), c.cast("string"))
    nodes = o.select(F.col("o_custkey").alias("graph"), key(F.col("o_orderkey")).alias("node"))
    open_ = o.where("o_orderstatus = 'P'")
    edges = open_.select(F.col("o_custkey").alias("graph"), key(F.col("o_orderkey")).alias("source"), F.lit("x").alias("target"))
    return D.graph_problems(nodes, edges, open_.select(F.col("o_custkey").alias("graph"), key(F.col("o_orderkey") + 1000000000).alias("node")))


@query("hashed_ledger", """select o_orderkey, o_custkey, o_orderstatus, 'sha256:' || sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') as event_hash from orders""")
def hashed_ledger(spark: SparkSession, d: str) -> DataFrame:
    return L.hashed(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("broken_ledger", """select o_orderkey, o_custkey, 'X' as o_orderstatus, 'sha256:' || sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') as event_hash from orders where o_orderkey % 50 = 0""")
def broken_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger in which some states were changed after the fact."""
    changed = F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus"))
    return L.broken_hashes(hashed_ledger(spark, d).withColumn("o_orderstatus", changed), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("replayed_journal", """with j as (select o_custkey as pack, o_orderkey as seq, case when o_orderstatus = 'F' then 'REMOVE' else 'ADD' end as op, o_orderpriority as manifest from orders), r as (select *, lag(op) over (partition by pack order by seq) as po, lag(manifest) over (partition by pack order by seq) as pm from j),
w as (select *, case when op = 'ADD' and po = 'ADD' then 'ADDS_EXISTING_PACK' when op = 'REMOVE' and coalesce(po, '') <> 'ADD' then 'REMOVES_MISSING_PACK' when op = 'REMOVE' and manifest is distinct from pm then 'REMOVES_DIFFERENT_PACK' end as wrong from r),
g as (select pack, arg_max(op, seq) as fin, arg_min(wrong, case when wrong is not null then seq end) as problem from w group by pack)
select pack, case when problem is not null then 'CORRUPT' when fin = 'ADD' then 'PRESENT' else 'ABSENT' end as state, problem from g""")
def replayed_journal(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "REMOVE").otherwise("ADD").alias("op"), F.col("o_orderpriority").alias("manifest"))
    return L.replay(j, "pack", "seq")


@query("revision_states", """with c as (select service, min(revision) as revision from sources where service is not null group by service), o as (select service, max(revision) as r from sources where service is not null and next_cursor is not null group by service)
select c.service, case when o.service is null then 'NOT_OBSERVED' when r is not distinct from revision then 'UP_TO_DATE' else 'PENDING' end as status from c left join o using (service)""")
def revision_states(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("service is not null")
    seen = s.where("next_cursor is not null").groupBy("service").agg(F.max("revision").alias("revision"))
    return L.reconcile_revisions(s.groupBy("service").agg(F.min("revision").alias("revision")), seen, "service", "revision")


@query("influence_scopes", "select distinct service, 'sha256:' || sha256(service) as digest from sources where service is not null")
def influence_scopes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("service is not null").select("service", F.col("service").alias("content"), content_digest("service").alias("digest"))
    return L.verified_scopes(s, "service", "content", "digest").select("service", "digest")


@query("support_fields", r"""with r as (select distinct record_id, body from work_records), o as (select *, case when json_valid(body) then body::json end as j from r), k as (select record_id, case when json_type(j) = 'OBJECT' then j end as j from o)
select record_id, json_extract_string(j, '$.kind') as kind, case when json_extract_string(j, '$.kind') = 'FRAGMENT' then json_extract_string(j, '$.reference') end as reference, case when json_extract_string(j, '$.kind') = 'FRAGMENT' then (list_contains(json_keys(j), 'kind')::int + list_contains(json_keys(j), 'reference')::int) end as n_fields from k""")
def support_fields(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "work_records").select("record_id", F.get_json_object("body", "$.kind").alias("kind"), "body").distinct()
    return L.whitelisted(r, "kind", "body", {"FRAGMENT": ["kind", "reference"]}).select("record_id", "kind", F.element_at("fields", "reference").alias("reference"), F.size(F.map_keys("fields")).alias("n_fields"))


@query("package_round_trip", "select n_nationkey, n_name, n_regionkey from nation")
def package_round_trip(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from factloom.runtime import shared_dir

    folder = f"{shared_dir(spark)}/packages/{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    L.export_package(n, folder, "n_regionkey")
    return L.import_package(spark, folder, "n_regionkey").select("n_nationkey", "n_name", "n_regionkey")


@query("selector_states", """with o as (select service, count(*) as n, max((text is not null)::int) as src, max((start_line is null)::int) as syn from (select distinct id, service, text, start_line from sources where service is not null) group by service)
select distinct c.session_id || '/' || coalesce(c.terms[1], '') as endpoint, case when len(c.terms) = 0 or c.terms is null then 'INCOMPLETE' when n is null then 'MISSING' when n > 1 then 'AMBIGUOUS' when src = 0 then 'SOURCE_UNAVAILABLE' when syn = 1 then 'SOURCE_MATCH' else 'RESOLVED' end as status from contexts c left join o on o.service = lower(c.terms[1])""")
def selector_states(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("terms", F.lit(0))
    ends = table(spark, d, "contexts").select(F.concat_ws("/", "session_id", F.coalesce(first, F.lit(""))).alias("endpoint"), F.coalesce(F.size("terms") > 0, F.lit(False)).alias("selected"), F.lower(first).alias("service")).distinct()
    obs = table(spark, d, "sources").where("service is not null").select("id", "service", "text", "start_line").distinct().select("service", F.col("text").isNotNull().alias("has_source"), F.col("start_line").isNull().alias("syntax"))
    return M.selector_status(ends, obs, ["service"]).distinct()


@query("entity_dependencies", """with e as (select session_id as entity, unnest(terms) as dep from contexts), k as (select p_name as dep, p_brand as s from part)
select entity, list_sort(list(distinct e.dep)) as missing, []::varchar[] as source_ids from (select distinct entity, dep from e) e group by entity""")
def entity_dependencies(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "contexts").select("session_id", F.explode("terms").alias("t")).groupBy(F.col("session_id").alias("entity")).agg(F.collect_set("t").alias("ids"))
    obs = table(spark, d, "part").groupBy(F.col("p_name").alias("id")).agg(F.array_sort(F.collect_set("p_brand")).alias("sources"))
    return M.entity_dependencies(e, obs, "entity", "ids", "id", "sources")


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    """Parts as members of their brand's class, with the annotations that their type names."""
    p = table(spark, d, "part")
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    t = lambda *c: [x.alias(n) for x, n in zip(c, ("class", "member", "name", "path", "http_method"))]
    none = F.lit(None).cast("string")
    own = p.select(*t(brand, none, F.lit("RestController"), none, none)).union(p.where("p_brand not like '%1'").select(*t(brand, none, F.lit("RequestMapping"), F.concat(F.lit("/"), brand, F.lit("/*")), none))).distinct()
    member = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    name = F.when(F.col("p_size") < 15, "GetMapping").when(F.col("p_size") < 30, "PostMapping").when(F.col("p_size") < 40, "RequestMapping").when(F.col("p_size") < 45, "KafkaListener").otherwise("Scheduled")
    path = F.when(F.col("p_size") == 44, F.lit("${topic}")).when(F.col("p_size") == 14, none).otherwise(F.replace("p_type", F.lit(" "), F.lit("/")))
    return own.union(p.select(*t(brand, member, name, path, none)))


@query("annotated_routes", """with p as (select replace(p_brand, '#', '') as class, 'm' || p_partkey as member, case when p_size < 15 then 'GET' when p_size < 30 then 'POST' end as http_method, p_brand not like '%1' as based, case when p_size = 14 then '' else replace(p_type, ' ', '/') end as child from part where p_size < 40),
q as (select class, member, http_method, case when based and child = '' then null when based then '/' || class || '/' || child when child = '' then '' else '/' || child end as path from p)
select class, member, http_method, path, case when path is null then 'PATH_NOT_STATIC' when http_method is null then 'HTTP_METHOD_UNSPECIFIED' end as gap from q""")
def annotated_routes(spark: SparkSession, d: str) -> DataFrame:
    return E.jvm_routes(_annotations(spark, d))


@query("annotated_listeners", """select replace(p_brand, '#', '') as class, 'm' || p_partkey as member, case when p_size < 45 then 'KAFKA_LISTENER' else 'SCHEDULE' end as kind, case when p_size <> 44 then replace(p_type, ' ', '/') end as subject, case when p_size = 44 then 'VALUE_NOT_STATIC' end as gap from part where p_size >= 40""")
def annotated_listeners(spark: SparkSession, d: str) -> DataFrame:
    return E.listeners(_annotations(spark, d))


@query("attribute_routes", """with p as (select replace(p_brand, '#', '') as class, 'm' || p_partkey as member, case when p_size < 15 then 'GET' else 'POST' end as http_method, p_brand not like '%1' as based, case when p_size = 14 then null when p_size = 44 then '${topic}' else replace(p_type, ' ', '/') end as child from part),
q as (select class, member, http_method, case when child like 'PROMO%' then '/' || member when based and child is null then '/api/' || class when based then '/api/' || class || '/' || child when child is not null then '/' || child end as path from p)
select class, member, http_method, path, case when path is null then 'TEMPLATE_NOT_STATIC' end as gap from q""")
def attribute_routes(spark: SparkSession, d: str) -> DataFrame:
    a = _annotations(spark, d)
    name = F.when(F.col("name") == "RestController", "ApiController").when(F.col("member").isNull(), "Route").when(F.col("name") == "GetMapping", "HttpGet").otherwise("HttpPost")
    path = F.when(F.col("member").isNull(), F.lit("api/[controller]")).when(F.startswith("path", F.lit("PROMO")), F.lit("~/[action]")).otherwise(F.col("path"))
    return E.clr_routes(a.withColumn("name", name).withColumn("path", path))
