"""Queries on matching, versions, aggregates and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import json as J
from factloom.functions import text as T
from factloom.operators import aggregates as A
from factloom.operators import diffs as D
from factloom.operators import matching as M
from factloom.operators import paging as G
from factloom.plans import views as V
from factloom.plans.views import EDGES_SQL, SOURCES_SQL, STATES_SQL
from factloom.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- filters and projections ---------------------------------------------------------------------


@query("selector_filter", "select distinct id, file from sources where service = 'ledger-core' and (file is null or contains(file, '/')) and start_line is not null and text is not null")
def selector_filter(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.where((F.col("service") == "ledger-core") & (F.col("file").isNull() | F.contains("file", F.lit("/"))) & F.col("start_line").isNotNull() & F.col("text").isNotNull()).select("id", "file").distinct()


@query("source_inventory", "select file, count(*) as n, min(start_line) as first_line, max(end_line) as last_line, count(distinct service) as services from sources where file is not null group by file")
def source_inventory(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("file is not null")
    return s.groupBy("file").agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.count_distinct("service").alias("services"))


@query("source_navigation", f"with {SOURCES_SQL} select id, service, file, start_line, end_line, case when text is not null then 'sha256:' || sha256(text) end as digest, text_digest = 'sha256:' || sha256(text) as intact from src")
def source_navigation(spark: SparkSession, d: str) -> DataFrame:
    digest = T.content_digest("text")
    return V.sources(spark, d).select("id", "service", "file", "start_line", "end_line", digest.alias("digest"), (F.col("text_digest") == digest).alias("intact"))


@query("exact_rows", "select context_id, intent from (select distinct context_id, intent from contexts)")
def exact_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the order that their ids are asked for; each has to be there once, or the job fails."""
    c = table(spark, d, "contexts").select("context_id", "intent").distinct()
    asked = c.select("context_id").distinct()
    return asked.join(M.unique_or_error(c, ["context_id"]), "context_id").select("context_id", "intent")


_OR_NONE = "select * from h union all select null, null, null, 'UNSUPPORTED' where not exists (select 1 from h)"


@query("facet_callers", f"with {EDGES_SQL}, h as (select source, target, kind, 'SUPPORTED' as status from edges where target in (select 's' || s_suppkey from supplier where s_acctbal < 0)) {_OR_NONE}")
def facet_callers(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return M.facet(V.edges(spark, d), ids, "callers")


@query("facet_callees", f"with {EDGES_SQL}, h as (select source, target, kind, 'SUPPORTED' as status from edges where source in (select 'c' || c_custkey from customer where c_mktsegment = 'BUILDING')) {_OR_NONE}")
def facet_callees(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return M.facet(V.edges(spark, d), ids, "callees")


@query("facet_unsupported", "select null::varchar as source, null::varchar as target, null::varchar as kind, 'UNSUPPORTED' as status")
def facet_unsupported(spark: SparkSession, d: str) -> DataFrame:
    return M.facet(V.edges(spark, d), spark.createDataFrame([("nobody",)], "id string"), "callers")


@query("display_names", "select distinct context_id, coalesce(intent, terms[1], session_id, context_id) as name from contexts")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contexts").select("context_id", F.coalesce("intent", F.get("terms", F.lit(0)), "session_id", "context_id").alias("name")).distinct()


@query("saved_overlay", """with b as (select distinct file as path, id as content from sources where file is not null), l as (select file as path, max(id) as content from sources where file is not null and next_cursor is not null group by file),
r as (select l.path, l.content, l.path not like '%.md' as regular from l) select path, content, 'COMMITTED' as state from b where path not in (select path from r) union all select path, content, 'SAVED' from r where regular""")
def saved_overlay(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("file is not null")
    base = s.select(F.col("file").alias("path"), F.col("id").alias("content")).distinct()
    work = s.where("next_cursor is not null").groupBy(F.col("file").alias("path")).agg(F.max("id").alias("content")).withColumn("regular", ~F.endswith("path", F.lit(".md")))
    return D.overlay(base, work, "path", "regular")


@query("literal_locate", """with s as (select distinct id, text from sources where id is not null and contains(text, 'digest')), p as (select id, string_split(text, 'digest') as parts from s), q as (select id, parts, unnest(range(1, len(parts))) as i from p),
r as (select id, list_sum(list_transform(parts[1:i], lambda x: strlen(x)))::bigint + (i - 1) * 6 as begun from q) select id, begun as byte_start, begun + 6 as byte_end from r""")
def literal_locate(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.files import locate

    return locate(V.sources(spark, d), "id", "text", "digest", 1_000_000)


# --- joins ---------------------------------------------------------------------------------------


@query("exactly_one_match", """with l as (select distinct lower(trim(parent)) as ref from publications where parent is not null and trim(parent) <> ''), r as (select id, count(*) as n, min(repository) as one_ from publications group by id)
select ref, case when n is null then 'MISSING' when n = 1 then 'RESOLVED' else 'AMBIGUOUS' end as status, coalesce(n, 0) as n_candidates, case when n = 1 then one_ end as repository from l left join r on id = ref""")
def exactly_one_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "publications")
    left = p.select(F.lower(F.trim("parent")).alias("ref")).where("ref <> ''").distinct()
    return M.exactly_one(left.withColumn("key", F.col("ref")), p.select(F.col("id").alias("key"), "repository"), ["key"], "ref", "repository")


@query("two_phase_match", f"""with {STATES_SQL}, b as (select o_custkey, n, priorities from before), a as (select o_custkey, n, priorities from after),
lb as (select * from b where o_custkey not in (select o_custkey from a)), la as (select * from a where o_custkey not in (select o_custkey from b)),
ob as (select n, priorities, min(o_custkey) as k from lb group by all having count(*) = 1), oa as (select n, priorities, min(o_custkey) as k from la group by all having count(*) = 1),
m as (select ob.k as before, oa.k as after from ob join oa using (n, priorities))
select b.o_custkey as before, a.o_custkey as after, 'EXACT' as status from b join a using (o_custkey) union all select before, after, 'FAMILY' from m
union all select o_custkey, null, 'REMOVED' from lb where o_custkey not in (select before from m) union all select null, o_custkey, 'ADDED' from la where o_custkey not in (select after from m)""")
def two_phase_match(spark: SparkSession, d: str) -> DataFrame:
    b, a = V.order_states(spark, d)
    return M.two_phase(b, a, "o_custkey", ["n", "priorities"])


@query("lane_changes", f"""with {STATES_SQL}, b as (select distinct priorities as lane, n from before), a as (select distinct priorities as lane, n from after), j as (select coalesce(b.lane, a.lane) as lane, b.n as bn, a.n as an from b full join a on b.lane = a.lane and b.n = a.n),
p as (select lane, count(*) filter (bn is not null and an is not null) as matched, count(*) filter (an is null) as only_before, count(*) filter (bn is null) as only_after from j group by lane)
select *, case when only_before = 0 and only_after = 0 then 'UNCHANGED' when only_before = 1 and only_after = 1 and matched = 0 then 'PAIRED' when matched > 0 or (only_before > 0 and only_after > 0) then 'OVERLOAD_SET_CHANGED' when only_before = 0 then 'ADDED' else 'REMOVED' end as verdict from p""")
def lane_changes(spark: SparkSession, d: str) -> DataFrame:
    b, a = V.order_states(spark, d)
    return M.lane_changes(b.withColumnRenamed("priorities", "lane"), a.withColumnRenamed("priorities", "lane"), ["lane"], "n")


@query("difference_codes", f"""with {STATES_SQL}, j as (select o_custkey, before.n as bn, after.n as an, before.priorities as bp, after.priorities as ap, before.states as bs, after.states as as_ from before join after using (o_custkey))
select o_custkey, 'COUNT' as code from j where bn is distinct from an union all select o_custkey, 'PRIORITIES' from j where bp is distinct from ap union all select o_custkey, 'STATES' from j where bs is distinct from as_""")
def difference_codes(spark: SparkSession, d: str) -> DataFrame:
    b, a = V.order_states(spark, d)
    pairs = b.alias("b").join(a.alias("a"), "o_custkey")
    codes = {"COUNT": (F.col("b.n"), F.col("a.n")), "PRIORITIES": (F.col("b.priorities"), F.col("a.priorities")), "STATES": (F.col("b.states"), F.col("a.states"))}
    return M.difference_codes(pairs, codes).select("o_custkey", "code")


@query("shape_field_diff", r"""with m as (select distinct manifest_id, repository, written_at, body from publication_manifests), p as (select *, lag(body) over (partition by repository order by written_at) as before from m),
g as (select manifest_id, body::json as a, before::json as b from p where json_valid(body) and json_valid(before)), o as (select * from g where json_type(a) = 'OBJECT' and json_type(b) = 'OBJECT'),
k as (select manifest_id, a, b, unnest(list_distinct(list_concat(json_keys(a), json_keys(b)))) as key from o), d as (select manifest_id, key from k where json_extract_string(a, '$."' || key || '"') is distinct from json_extract_string(b, '$."' || key || '"') or list_contains(json_keys(a), key) <> list_contains(json_keys(b), key))
select o.manifest_id, list_sort(coalesce(list(key) filter (key is not null), [])) as fields from o left join d using (manifest_id) group by o.manifest_id""")
def shape_field_diff(spark: SparkSession, d: str) -> DataFrame:
    """Fields that differ between the bodies of a manifest and the one before it in its repository."""
    from pyspark.sql import Window

    m = table(spark, d, "publication_manifests").select("manifest_id", "repository", "written_at", "body").distinct()
    before = F.lag("body").over(Window.partitionBy("repository").orderBy("written_at"))
    pairs = m.withColumn("before", before).where("before is not null")
    a, b = J.members(F.col("before")), J.members(F.col("body"))
    return pairs.where(a.isNotNull() & b.isNotNull()).select("manifest_id", J.differing_keys(a, b).alias("fields"))


@query("exact_or_family", """with refs as (select distinct context_id as ref, case when parent_context_id like 'context:%' then lower(trim(parent_context_id)) end as exact, case when parent_context_id like 'context:%' then null else session_id end as family from contexts),
decls as (select distinct context_id as exact, session_id as family, context_id as decl from contexts), e as (select exact, count(*) as n, min(decl) as only from decls group by exact), f as (select family, count(*) as n, min(decl) as only from decls group by family)
select ref, case when e.n is null then 'MISSING' when e.n = 1 then 'RESOLVED' else 'AMBIGUOUS' end as status, coalesce(e.n, 0) as n_candidates, case when e.n = 1 then e.only end as decl, 'EXACT' as basis from refs left join e on e.exact = refs.exact where refs.exact is not null
union all select ref, case when f.n is null then 'MISSING' when f.n = 1 then 'RESOLVED' else 'AMBIGUOUS' end, coalesce(f.n, 0), case when f.n = 1 then f.only end, 'FAMILY' from refs left join f on f.family = refs.family where refs.exact is null and refs.family is not null
union all select ref, 'MISSING', 0, null, 'NONE' from refs where exact is null and family is null""")
def exact_or_family(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contexts")
    known = F.coalesce(F.startswith("parent_context_id", F.lit("context:")), F.lit(False))
    refs = c.select(F.col("context_id").alias("ref"), F.when(known, F.lower(F.trim("parent_context_id"))).alias("exact"), F.when(~known, F.col("session_id")).alias("family")).distinct()
    decls = c.select(F.col("context_id").alias("exact"), F.col("session_id").alias("family"), F.col("context_id").alias("decl")).distinct()
    return M.exact_or_family(refs, decls, "ref", "exact", "family", "decl")


@query("range_containment_owner", """with s as (select distinct id, service, file, start_byte as f, end_byte as l from sources where service is not null and file is not null and start_byte is not null and end_byte >= start_byte), pts as (select id as point, service, file, f as pf, f as pl from s)
select point, case when count(s.id) = 0 then 'MISSING' when count(s.id) = 1 then 'RESOLVED' else 'AMBIGUOUS' end as status, count(s.id) as n_candidates, case when count(s.id) = 1 then min(s.id) end as id from (select distinct point, service, file, pf, pl from pts) p left join s on s.service = p.service and s.file = p.file and s.f <= pf and s.l >= pl group by point""")
def range_containment_owner(spark: SparkSession, d: str) -> DataFrame:
    """The records of a file that hold the first byte of a record, itself included."""
    s = table(spark, d, "sources").where("service is not null and file is not null and start_byte is not null and end_byte >= start_byte").select("id", "service", "file", F.col("start_byte").alias("first"), F.col("end_byte").alias("last")).distinct()
    pts = s.select(F.col("id").alias("point"), "service", "file", F.col("first").alias("p_first"), F.col("first").alias("p_last"))
    out = M.containing(pts, s, ["service", "file"], "point", "id", 4096)
    return out.distinct()


# --- versions ------------------------------------------------------------------------------------


@query("snapshot_diff", f"""with {STATES_SQL} select coalesce(b.o_custkey, a.o_custkey) as o_custkey, b.priorities as before, a.priorities as after,
 case when b.o_custkey is null then 'ADDED' when a.o_custkey is null then 'DELETED' when b.priorities is distinct from a.priorities then 'MODIFIED' when b.states is distinct from a.states then 'MODE_CHANGED' else 'UNCHANGED' end as status from before b full join after a on b.o_custkey = a.o_custkey""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    b, a = V.order_states(spark, d)
    return D.snapshot_diff(b, a, ["o_custkey"], "priorities", "states")


@query("merge_last_wins", """with t as (select c_custkey as k, c_name as v from customer), u as (select o_custkey as k, o_orderpriority as v, o_orderkey as n from orders), r as (select distinct c_custkey as k from customer where c_acctbal < 0),
last as (select k, v from (select *, row_number() over (partition by k order by n desc) as rn from u) where rn = 1)
select k, v from t where k not in (select k from r) and k not in (select k from last) union all select k, v from last""")
def merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    u = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("n"))
    return D.merge(t, u, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k")), ["k"], "n")


@query("replace_scope_guarded", """with t as (select p_partkey as k, p_brand as scope, p_name as v from part), rows as (select p_partkey as k, p_brand as scope, 'new' as v from part where p_brand = 'Brand#11' and p_size > 25)
select * from t where scope <> 'Brand#11' or scope is null union all select * from t where scope = 'Brand#11' and k not in (select k from rows) union all select * from rows""")
def replace_scope_guarded(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("scope"), F.col("p_name").alias("v"))
    rows = table(spark, d, "part").where("p_brand = 'Brand#11' and p_size > 25").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("scope"), F.lit("new").alias("v"))
    return D.replace_scope(t, "Brand#11", "scope", rows, ["k"], complete=False)


@query("replace_scope_complete", """with t as (select p_partkey as k, p_brand as scope, p_name as v from part), rows as (select p_partkey as k, p_brand as scope, 'new' as v from part where p_brand = 'Brand#11' and p_size > 25)
select * from t where scope <> 'Brand#11' or scope is null union all select * from rows""")
def replace_scope_complete(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("scope"), F.col("p_name").alias("v"))
    rows = table(spark, d, "part").where("p_brand = 'Brand#11' and p_size > 25").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("scope"), F.lit("new").alias("v"))
    return D.replace_scope(t, "Brand#11", "scope", rows, ["k"], complete=True)


STATE_SQL = f"""{STATES_SQL}, dep as (select b.o_custkey, b.priorities, case when a.o_custkey is null then 'UNAVAILABLE' when b.priorities is distinct from a.priorities then 'CHANGED' else 'CURRENT' end as state from before b left join after a on a.o_custkey = b.o_custkey)"""


@query("dependency_freshness", f"with {STATE_SQL} select o_custkey, priorities, state from dep")
def dependency_freshness(spark: SparkSession, d: str) -> DataFrame:
    b, a = V.order_states(spark, d)
    return D.dependency_states(b.select("o_custkey", "priorities"), a, "o_custkey", "priorities")


@query("fragment_freshness", f"""with {STATE_SQL}, uses as (select c_nationkey as nation, o_custkey from dep join customer on c_custkey = o_custkey), bad as (select nation, count(distinct o_custkey) as n from uses where o_custkey in (select o_custkey from dep where state <> 'CURRENT') group by nation)
select distinct uses.nation, case when bad.n is null then 'CURRENT' else 'STALE' end as status, coalesce(bad.n, 0) as affected from uses left join bad using (nation)""")
def fragment_freshness(spark: SparkSession, d: str) -> DataFrame:
    states = dependency_freshness(spark, d)
    uses = states.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("nation"), "o_custkey")
    return D.freshness(uses, states, "nation", "o_custkey")


@query("catalogue_delta", f"with {STATES_SQL} select o_custkey, 'REMOVED' as change from before where o_custkey not in (select o_custkey from after) union all select o_custkey, 'ADDED' from after where o_custkey not in (select o_custkey from before)")
def catalogue_delta(spark: SparkSession, d: str) -> DataFrame:
    b, a = V.order_states(spark, d)
    return D.catalogue_delta(b, a, "o_custkey")


@query("claim_states", """with c as (select distinct id as claim, text_digest from sources where id is not null), e as (select id as k, count(distinct snapshot) as n, min('sha256:' || sha256(text)) as now from sources where text is not null group by id), x as (select id as k, count(*) as n, min('sha256:' || sha256(text)) as now from (select distinct id, snapshot, text from sources where text is not null and id is not null) group by id)
select claim, case when n is null then 'EVIDENCE_MISSING' when n > 1 then 'EVIDENCE_AMBIGUOUS' when text_digest is distinct from now then 'SEMANTIC_DIGEST_CHANGED' else 'CURRENT' end as reason from c left join x on k = claim""")
def claim_states(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("id is not null")
    claims = s.select(F.col("id"), F.col("text_digest")).distinct()
    evidence = s.where("text is not null").select("id", "snapshot", "text").distinct().select("id", T.content_digest("text").alias("text_digest"))
    return D.claim_states(claims.withColumn("claim", F.col("id")), evidence, "id", "text_digest", "claim")


@query("candidate_delta", f"with {STATES_SQL} select coalesce(b.o_custkey, a.o_custkey) as o_custkey, case when b.o_custkey is null then 'ADDED' when a.o_custkey is null then 'REMOVED' when b.n is distinct from a.n then 'UPDATED' else 'UNCHANGED' end as status from before b full join after a on a.o_custkey = b.o_custkey")
def candidate_delta(spark: SparkSession, d: str) -> DataFrame:
    b, a = V.order_states(spark, d)
    return D.candidate_delta(b, a, "o_custkey", "n")


@query("shared_references", "with s as (select p_brand as k, min(p_type) as c from part group by p_brand) select p_partkey as owner, p_brand as k, case when c is not distinct from p_type then 'REFERENCE' else 'OWN' end as form from part left join s on k = p_brand")
def shared_references(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("owner"), F.col("p_brand").alias("k"), F.col("p_type").alias("c"))
    return D.share_equal(p, p.groupBy("k").agg(F.min("c").alias("c")), "k", "c", "owner")


@query("text_hunks")
def text_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Line differences between the bodies of neighbouring manifests."""
    from pyspark.sql import Window

    m = table(spark, d, "publication_manifests").select("manifest_id", "repository", "written_at", "body").distinct()
    pairs = m.withColumn("before", F.lag("body").over(Window.partitionBy("repository").orderBy("written_at"))).where("before is not null")
    return D.text_hunks(pairs, "manifest_id", "before", "body")


@query("object_dedupe", "select distinct 'sha256:' || sha256(text) as digest from sources where text is not null and 'sha256:' || sha256(text) not in (select 'sha256:' || sha256(text) from documents where text is not null)")
def object_dedupe(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("text is not null").select("text")
    have = table(spark, d, "documents").where("text is not null").select(T.content_digest("text").alias("digest"))
    return D.put_objects(have, s, T.content_digest("text")).select("digest")


@query("exact_removal", "select o_orderkey, o_custkey from orders where o_orderstatus <> 'F'")
def exact_removal(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    plan = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return D.remove_exact(o.select("o_orderkey", "o_custkey"), plan, ["o_orderkey", "o_custkey"])


@query("bounded_inventory", "select n_nationkey, n_name from nation")
def bounded_inventory(spark: SparkSession, d: str) -> DataFrame:
    return D.enumerate_bounded(table(spark, d, "nation").select("n_nationkey", "n_name"), 1000)


# --- aggregates ----------------------------------------------------------------------------------

VECTORS = """vectors as (select l_orderkey as k, l_linenumber as seq, case when l_returnflag = 'R' then 'UNSUPPORTED' else 'SUPPORTED' end as support, case when l_quantity > 40 then 'PARTIAL' when l_quantity < 2 then 'UNKNOWN' else 'COMPLETE' end as coverage,
 case when l_quantity < 2 then [] else [l_linestatus] end as scopes, case when l_quantity > 40 then ['B' || l_returnflag] else [] end as boundaries, case when l_discount > 0.08 then 'UNSURE' else 'VERIFIED' end as certainty, case when l_discount > 0.08 then ['C' || l_returnflag] else [] end as checks from lineitem)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    q, unsure = F.col("l_quantity"), F.col("l_discount") > 0.08
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_returnflag") == "R", "UNSUPPORTED").otherwise("SUPPORTED").alias("support"), F.when(q > 40, "PARTIAL").when(q < 2, "UNKNOWN").otherwise("COMPLETE").alias("coverage"),
        F.when(q < 2, none).otherwise(F.array("l_linestatus")).alias("scopes"), F.when(q > 40, F.array(F.concat(F.lit("B"), "l_returnflag"))).otherwise(none).alias("boundaries"), F.when(unsure, "UNSURE").otherwise("VERIFIED").alias("certainty"), F.when(unsure, F.array(F.concat(F.lit("C"), "l_returnflag"))).otherwise(none).alias("checks"),
    )


@query("completeness_meet", f"""with {VECTORS}, f as (select k, min(support = 'SUPPORTED') as sup, max(coverage = 'UNKNOWN') as unk, list_sort(list_distinct(flatten(list(scopes)))) as s, list_sort(list_distinct(flatten(list(boundaries)))) as b, max(certainty = 'UNSURE') as uns, list_sort(list_distinct(flatten(list(checks)))) as c,
 arg_min(case when coverage = 'COMPLETE' then scopes[1] end, case when coverage = 'COMPLETE' then seq end) as fs, min(case when coverage = 'PARTIAL' then seq end) as pa from vectors group by k),
o as (select v.k, min(seq) as oa from vectors v join f on f.k = v.k and v.coverage = 'COMPLETE' and v.scopes[1] <> f.fs group by v.k),
r as (select f.*, oa, case when unk then 'UNKNOWN' when pa is null and oa is null then 'COMPLETE' else 'PARTIAL' end as cov from f left join o using (k))
select k, case when sup then 'SUPPORTED' else 'UNSUPPORTED' end as support, cov as coverage, case when cov = 'UNKNOWN' then [] else s end as scopes,
 case when cov <> 'PARTIAL' then [] when oa is not null and (pa is null or oa < pa) then list_sort(list_concat(b, ['SCOPE_MISMATCH'])) else b end as boundaries, case when uns then 'UNSURE' else 'VERIFIED' end as certainty, case when uns then c else [] end as checks from r""")
def completeness_meet(spark: SparkSession, d: str) -> DataFrame:
    return A.meet(vectors(spark, d), "k", "seq")


@query("publishable", f"with {VECTORS} select k, seq, support = 'SUPPORTED' and coverage = 'COMPLETE' and certainty = 'VERIFIED' as publishable from vectors")
def publishable(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("k", "seq", A.publishable().alias("publishable"))


@query("member_status", "select o_custkey, count(distinct o_orderkey) as members, case when min((o_orderstatus <> 'O')::int) = 0 then 'INCOMPLETE' when max((o_orderpriority = '1-URGENT')::int) = 1 then 'CONDITIONAL_TASK' else 'COMPLETE_TASK' end as status from orders group by o_custkey")
def member_status(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("complete", F.col("o_orderstatus") != "O").withColumn("conditional", F.col("o_orderpriority") == "1-URGENT")
    return A.members_status(o, o, "o_custkey", "o_orderkey")


@query("unmatched_in_all", "select l_partkey from lineitem group by l_partkey having count(distinct l_returnflag) = 3")
def unmatched_in_all(spark: SparkSession, d: str) -> DataFrame:
    return A.in_all(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", 3)


@query("ambiguous_callables", "with t as (select service, file, text_digest, [id] as ids from sources where service is not null and file is not null and id is not null) select service, file, count(*) as occurrences, case when count(distinct text_digest) > 1 then 'AMBIGUOUS' else 'UNIQUE' end as status, list_sort(list_distinct(flatten(list(ids)))) as source_ids from t group by service, file")
def ambiguous_callables(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where("service is not null and file is not null and id is not null").withColumn("ids", F.array("id"))
    return A.ambiguous_groups(s, ["service", "file"], "text_digest", "ids")


KINDS = "case event_type when 'click' then 'CALL' when 'purchase' then 'CONSTRUCT' when 'view' then 'IF' else 'LOOP' end"


@query("process_candidates", f"""with e as (select user_id, {KINDS} as kind, event_type || ':' || length(props) as target, value > 50 as syntactic from events), l as (select distinct target from e where kind <> 'IF'),
p as (select user_id, count(distinct case when kind in ('CALL', 'CONSTRUCT') and l.target is not null then e.target end) as targets, sum((kind in ('IF', 'LOOP'))::int)::bigint as controls, sum((kind in ('CALL', 'CONSTRUCT') and syntactic)::int)::bigint as lexical_calls from e left join l on l.target = e.target group by user_id),
q as (select *, list_filter([case when targets >= 2 and controls > 0 then 'INTERNAL_ORCHESTRATION_CANDIDATE' end, case when lexical_calls >= 2 and controls > 0 then 'LEXICAL_ORCHESTRATION_CANDIDATE' end], lambda x: x is not null) as reasons from p) select * from q where len(reasons) > 0""")
def process_candidates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "CALL").when(F.col("event_type") == "purchase", "CONSTRUCT").when(F.col("event_type") == "view", "IF").otherwise("LOOP")
    e = table(spark, d, "events").select("user_id", kind.alias("kind"), F.concat("event_type", F.lit(":"), F.length("props").cast("string")).alias("target"), (F.col("value") > 50).alias("syntactic"))
    return A.process_candidates(e, e.where("kind <> 'IF'").select("target"), "user_id")


@query("flow_ordinal_gaps", """with x as (select o_orderkey, count(*) as n from lineitem right join orders on l_orderkey = o_orderkey group by o_orderkey), p as (select l_orderkey as o_orderkey, count(*) as present, count(distinct l_linenumber - 1) as dist, min(l_linenumber - 1) as lo, max(l_linenumber - 1) as hi from lineitem where l_returnflag <> 'R' group by l_orderkey)
select o_orderkey, n as expected, coalesce(present, 0) as present from x left join p using (o_orderkey) where not coalesce(coalesce(present, 0) = n and (n = 0 or (dist = n and lo = 0 and hi = n - 1)), false)""")
def flow_ordinal_gaps(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    expected = table(spark, d, "orders").select("o_orderkey").join(l.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("*").alias("n"))
    events = l.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") - 1).alias("ordinal"))
    return A.ordinal_gaps(events, "o_orderkey", "ordinal", expected, "n")


@query("inventory_counts", "select count(*) as objects, coalesce(sum(n_chars), 0)::bigint as bytes, coalesce(sum((n_chars < 0)::int), 0)::bigint as negative from documents")
def inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.inventory(table(spark, d, "documents"), "n_chars")


@query("allocation_proofs")
def allocation_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as statements on a few names, proven or not."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "click", "NEW").when(F.col("event_type") == "view", "COPY").when(F.col("event_type") == "purchase", "ENDPOINT").otherwise("WORKER")
    rows = e.select(F.col("user_id").cast("string").alias("owner"), F.col("event_id").alias("ordinal"), op.alias("op"), F.concat(F.lit("v"), F.length("props").cast("string")).alias("name"), F.concat(F.lit("v"), F.length(F.col("value").cast("int").cast("string")).cast("string")).alias("value"))
    return rows.groupBy("owner").applyInPandas(A.allocation_proof, "owner string, status string")


# --- pages ---------------------------------------------------------------------------------------


@query("page_by_bytes", """with i as (select source, doc_id, strlen(text) as size, row_number() over (partition by source order by doc_id) - 1 as index from documents where source is not null and text is not null), f as (select * from i where index < 20),
t as (select *, sum(case when size <= 4096 then size else 0 end) over (partition by source order by doc_id) as total from f), u as (select *, max((size <= 4096 and total > 12288)::int) over (partition by source order by doc_id) as full_ from t)
select source, doc_id, index::int as index, case when size <= 4096 then 'SENT' else 'OMITTED' end as state from u where full_ = 0""")
def page_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").where("source is not null and text is not null").select("source", "doc_id", F.octet_length("text").alias("size"))
    return G.page(items, "source", "doc_id", "size", item_bytes=4096, page_bytes=12288)


@query("all_pages", r"""with recursive i as (select source, doc_id, strlen(text) as size, row_number() over (partition by source order by doc_id) as no from documents where source is not null and text is not null), f(source, no, page, taken, used) as (select source, 0::bigint, 0, 0, 0::bigint from i where no = 1
 union all select i.source, i.no, case when full_ then page + 1 else page end, case when full_ then 1 else taken + 1 end, case when full_ then 0 else used end + case when x.size <= 49152 then x.size else 0 end from (select f.*, i.size, taken = 20 or (size <= 49152 and used + size > 57344 and taken > 0) as full_, i.no as next from f join i on i.source = f.source and i.no = f.no + 1) x join i on i.source = x.source and i.no = x.next)
select i.source, doc_id, page::bigint as page, case when i.size <= 49152 then 'SENT' else 'OMITTED' end as state from f join i on i.source = f.source and i.no = f.no""")
def all_pages(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").where("source is not null and text is not null").select("source", "doc_id", F.octet_length("text").alias("size"))
    return G.pages(items, "source", "doc_id", "size")


@query("skip_fit", r"""with recursive i as (select source, doc_id, strlen(text) as size, row_number() over (partition by source order by doc_id) as no from documents where source is not null and text is not null), f(source, no, room, taken) as (select source, 0::bigint, 8192::bigint, false from i where no = 1 union all select i.source, i.no, case when size <= room then room - size else room end, size <= room from f join i on i.source = f.source and i.no = f.no + 1)
select i.source, doc_id, size from f join i on i.source = f.source and i.no = f.no where taken""")
def skip_fit(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").where("source is not null and text is not null").select("source", "doc_id", F.octet_length("text").alias("size"))
    return G.skip_fit(items, "source", ["doc_id"], "size", 8192)


@query("byte_parts", r"""with recursive t as (select distinct id, text from sources where id is not null and text is not null and text <> ''), h as (select id, hex(encode(text)) as h, strlen(text) as n from t),
p(id, part, a, b) as (select id, 0, 0::bigint, 0::bigint from h union all select h.id, part + 1, b, case when b + 4096 >= n then n when not substr(h, 2 * (b + 4096) + 1, 1) between '8' and 'B' then b + 4096 when not substr(h, 2 * (b + 4095) + 1, 1) between '8' and 'B' then b + 4095 when not substr(h, 2 * (b + 4094) + 1, 1) between '8' and 'B' then b + 4094 else b + 4093 end from p join h on h.id = p.id where b < n)
select id, part::int as part, a::int as start_byte, b::int as end_byte from p where part > 0""")
def byte_parts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sources").where("id is not null and text is not null").select("id", "text").distinct()
    return G.byte_ranges(t, "id", "text", 4096)
