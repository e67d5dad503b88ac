"""Queries on declarations, boundaries, attached evidence and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import content_digest
from factloom.operators import graph as G
from factloom.operators import postings as P
from factloom.operators import scopes as S
from factloom.plans import views as V
from factloom.plans.graphs import SQL as GRAPH_SQL
from factloom.plans.graphs import flow_slice_nodes, outcome_masks
from factloom.plans.index import ASKED, LOOKUP_SQL, written
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


DECLARED = """d as (select p_partkey, case p_size % 3 when 0 then 'Declaration' when 1 then 'call' end as kind, case p_size % 4 when 0 then 'METHOD' when 1 then 'FIELD' when 2 then 'FUNCTION' end as decl,
 case p_size % 5 when 0 then 'function_definition' when 1 then 'class_body' when 2 then 'secondary_constructor' end as syntax, case when p_size % 2 = 0 then p_name end as identity from part)"""


@query("declaration_kinds", f"""with {DECLARED} select p_partkey, coalesce(lower(kind) = 'declaration', false) or (decl is not null and identity is not null) as declaration,
 coalesce(case when decl is not null then decl in ('METHOD', 'CONSTRUCTOR', 'FUNCTION') else syntax in ('function_definition', 'function_declaration', 'method_declaration', 'constructor_declaration', 'secondary_constructor') end, false) as callable from d""")
def declaration_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    of = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_size") % n + 1).cast("int"))
    decl, syntax = of(4, ["METHOD", "FIELD", "FUNCTION", None]), of(5, ["function_definition", "class_body", "secondary_constructor", None, None])
    identity = F.when(F.col("p_size") % 2 == 0, F.col("p_name"))
    return p.select("p_partkey", S.is_declaration(of(3, ["Declaration", "call", None]), decl, identity).alias("declaration"), S.is_callable(decl, syntax).alias("callable"))


@query("public_boundaries", """with e as (select o_orderkey, case o_orderkey % 4 when 0 then 'HTTP_ENDPOINT' when 1 then 'SOURCE_ROUTE' when 2 then 'SOURCE_DECLARATION' else 'LISTENER' end as kind, o_orderstatus = 'F' as unproven, o_orderstatus = 'P' as endpoint, o_custkey % 3 as c from orders)
select o_orderkey, not (kind = 'HTTP_ENDPOINT' and unproven) and (not starts_with(kind, 'SOURCE_') or (c <> 2 and not (endpoint and c = 0))) as public from e""")
def public_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Entry points made of orders: what they declare has a controller, none, or says nothing of it."""
    o = table(spark, d, "orders")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("HTTP_ENDPOINT", "SOURCE_ROUTE", "SOURCE_DECLARATION", "LISTENER")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    c = F.col("o_custkey") % 3
    declared = F.when(c != 2, F.array(F.struct(F.when(F.col("o_orderstatus") == "P", "HTTP_ENDPOINT").otherwise("LISTENER").alias("kind"), F.when(c == 0, False).alias("controller"))))
    boundaries = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("OTHER"), F.lit(S.UNPROVEN)))
    return o.select("o_orderkey", S.is_public_boundary(kind, boundaries, declared).alias("public"))


@query("service_scope", """select o_orderkey from orders where o_custkey % 10 = 1 or o_orderpriority in ('1-URGENT', '2-HIGH') or (o_orderpriority = '3-MEDIUM' and (o_orderkey % 10 = 1 or o_totalprice > 200000))""")
def service_scope(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    s = lambda c: F.concat(F.lit("s"), (F.col(c) % 10).cast("string"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "DOMAIN_ENTITY").when(F.col("o_orderpriority") == "2-HIGH", "ENTITY_SCOPE").when(F.col("o_orderpriority") == "3-MEDIUM", "DECLARED_INTERACTION").otherwise("FLOW")
    return o.where(S.in_service_scope("s1", s("o_custkey"), kind, s("o_orderkey"), F.when(F.col("o_totalprice") > 200000, "s1"))).select("o_orderkey")


@query("owned_flows", """with f as (select o_orderkey as flow, o_custkey % 20 as service, o_orderpriority as symbol, case when o_orderkey % 3 = 0 then o_custkey end as owner_id from orders), c as (select c_custkey as declaration, c_custkey % 20 as service, element_at, c_acctbal from (select *, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][c_custkey % 5 + 1] as element_at from customer))
select flow, declaration from f join c on f.service = c.service and symbol = element_at where case when owner_id is not null then owner_id = declaration else c_acctbal >= 9000 end""")
def owned_flows(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    flows = table(spark, d, "orders").select(F.col("o_orderkey").alias("flow"), (F.col("o_custkey") % 20).alias("service"), F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("owner_id"))
    decls = table(spark, d, "customer").select(F.col("c_custkey").alias("declaration"), (F.col("c_custkey") % 20).alias("service"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("symbol"), F.when(F.col("c_acctbal") < 9000, F.col("c_name")).alias("identity"))
    return S.owned(flows, decls)


@query("classpath_slots", """with r as (select l_orderkey as compilation, (l_linenumber + l_partkey % 2)::bigint as slot, 'jar' || l_partkey as artifact from lineitem), t as (select compilation from r group by compilation having count(distinct slot) < count(*))
select compilation, slot, artifact, case when compilation in (select compilation from t) then 'SLOT_REPEATED' else 'OK' end as status from r""")
def classpath_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("compilation"), F.struct((F.col("l_linenumber") + F.col("l_partkey") % 2).cast("long").alias("slot"), F.concat(F.lit("jar"), F.col("l_partkey").cast("string")).alias("artifact")).alias("a"))
    return S.artifact_slots(rows.groupBy("compilation").agg(F.collect_list("a").alias("artifacts")), "compilation", F.col("artifacts"))


@query("library_links", """with calls as (select c_custkey as call, c_nationkey as consumer, c_custkey % 60 as target from customer), bindings as (select n_name as binding, n_nationkey as consumer, n_regionkey as library from nation), decls as (select s_suppkey as declaration, s_nationkey % 4 as library, s_suppkey % 60 as identity from supplier),
u as (select library, identity, min(declaration) as declaration from decls group by all having count(*) = 1)
select binding, call, declaration, 'CANDIDATE_CONTINUATION' as status from calls join bindings using (consumer) join u on u.library = bindings.library and identity = target union all select binding, null, null, 'NOT_LINKED' from bindings where library not in (select library from decls)""")
def library_links(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "customer").select(F.col("c_custkey").alias("call"), F.col("c_nationkey").alias("consumer"), (F.col("c_custkey") % 60).alias("target"))
    bindings = table(spark, d, "nation").select(F.col("n_name").alias("binding"), F.col("n_nationkey").alias("consumer"), F.col("n_regionkey").alias("library"))
    decls = table(spark, d, "supplier").select(F.col("s_suppkey").alias("declaration"), (F.col("s_nationkey") % 4).alias("library"), (F.col("s_suppkey") % 60).alias("identity"))
    return S.library_links(calls, bindings, decls)


@query("inherited_methods", """with t as (select n_nationkey % 24 as type, case when n_nationkey % 6 = 0 then [n_regionkey, 99] when n_nationkey % 5 <> 1 then [n_regionkey] end as supers from nation), k as (select type, any_value(supers) as supers from t group by type having count(*) = 1),
m as (select s_suppkey as method, s_nationkey as owner, s_suppkey % 9 as name, s_suppkey % 2 as arity from supplier), o as (select m.*, unnest(case when len(coalesce(supers, [])) = 0 then [null] else supers end) as base_type from m left join k on type = owner where method % 3 = 0),
x as (select o.method, bool_and(coalesce(k.type is not null, false)) as whole, count(distinct b.method) as n, min(b.method) as base from o left join k on k.type = base_type left join m b on b.owner = base_type and b.name = o.name and b.arity = o.arity group by o.method)
select method, case when whole and n = 1 then base end as base, case when not whole or n = 0 then 'UNRESOLVED' when n > 1 then 'AMBIGUOUS' else 'INHERITED' end as status from x""")
def inherited_methods(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    types = table(spark, d, "nation").select((n % 24).alias("type"), F.when(n % 6 == 0, F.array(F.col("n_regionkey"), F.lit(99).cast("long"))).when(n % 5 != 1, F.array(F.col("n_regionkey").cast("long"))).alias("supertypes"))
    k = F.col("s_suppkey")
    methods = table(spark, d, "supplier").select(k.alias("method"), F.col("s_nationkey").alias("owner"), (k % 9).alias("name"), (k % 2).alias("arity"), (k % 3 == 0).alias("overrides"))
    return S.inherited(methods, types)


@query("attached_notes", """with n as (select distinct context_id as note, unnest(terms) as t from contexts), s as (select unnest(terms) as t from contexts group by 1 having count(*) > 3), a as (select note, list_sort(coalesce(list(t) filter (t in (select t from s)), [])) as attached, list_sort(coalesce(list(t) filter (t not in (select t from s)), [])) as missing from n where t is not null group by note)
select distinct context_id as note, coalesce(attached, []) as attached, coalesce(missing, []) as missing from contexts left join a on note = context_id""")
def attached_notes(spark: SparkSession, d: str) -> DataFrame:
    """The terms of contexts as targets of notes; subjects are the terms that more than three rows have."""
    c = table(spark, d, "contexts")
    subjects = c.select(F.explode("terms").alias("subject")).groupBy("subject").count().where("count > 3").select("subject")
    return S.attach_notes(c.select(F.col("context_id").alias("note"), "terms"), subjects, "note", "terms", "subject")


@query("impact_windows", """with g as (select l_returnflag as lane, l_orderkey as anchor, max(l_partkey) as size, count(distinct l_linenumber) as n_findings from lineitem group by all), t as (select *, row_number() over (partition by lane order by anchor) as turn from g), f as (select * from t order by turn, lane limit 12),
o as (select *, row_number() over (order by turn, lane) as position, sum(size) over (order by turn, lane) as total from f), q as (select *, max((total > 12000)::int) over (order by turn, lane) as over_ from o) select lane, anchor, size::bigint as size, n_findings, position::int as position from q where over_ = 0""")
def impact_windows(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("lane"), F.col("l_orderkey").alias("anchor"), F.col("l_partkey").cast("long").alias("size"), "l_linenumber")
    return S.turn_windows(l, "lane", ["anchor"], "size", "l_linenumber", 12, 12000)


@query("batch_payloads", """with r as (select source, doc_id, 'x' as x, sha256(text) as digest from documents where text is not null and source is not null and doc_id is not null)
select source, doc_id, digest, case when row_number() over (partition by digest order by source, doc_id) = 1 then 'SENT' else 'REFERENCE' end as form from r""")
def batch_payloads(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null and source is not null and doc_id is not null")
    return S.batch_payloads(t, ["source", "doc_id"], "text")


@query("proof_references", "select text_digest as reference from sources where text_digest is not null union select snapshot from sources where snapshot is not null union select evidence_digest from contexts where evidence_digest is not null union select input_digest from publications where input_digest is not null")
def proof_references(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return S.references([(s, "text_digest"), (s, "snapshot"), (table(spark, d, "contexts"), "evidence_digest"), (table(spark, d, "publications"), "input_digest")])


@query("attached_graphs", """select c_custkey as callable, case when o_custkey = c_custkey then o_orderkey end as graph, case when o_orderkey is null then 'NONE' when o_custkey = c_custkey then 'ATTACHED' else 'OWNER_DIFFERS' end as status from customer left join orders on o_orderkey = c_custkey * 4""")
def attached_graphs(spark: SparkSession, d: str) -> DataFrame:
    callables = table(spark, d, "customer").select(F.col("c_custkey").alias("callable"), F.col("c_custkey").alias("owner"), (F.col("c_custkey") * 4).alias("graph"))
    return S.attach_local(callables, table(spark, d, "orders").select(F.col("o_orderkey").alias("graph"), F.col("o_custkey").alias("owner")))


@query("rechecked_objects", """with o as (select distinct id as object, text_digest as digest, text from sources where id is not null), l as (select distinct context_id as object, evidence_digest as refers from contexts)
select object, 'DIGEST_DIFFERS' as problem from o where digest is distinct from 'sha256:' || sha256(text) union select object, 'REFERS_TO_NOTHING' from l where refers is not null and refers not in (select object from o)""")
def rechecked_objects(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "sources").where("id is not null").select(F.col("id").alias("object"), F.col("text_digest").alias("digest"), "text").distinct()
    return S.recheck(o, content_digest("text"), table(spark, d, "contexts").select(F.col("context_id").alias("object"), F.col("evidence_digest").alias("refers")))


@query("context_build", f"""{LOOKUP_SQL}, r as (select fact_key, count(distinct term) as n_terms, count(distinct case when by_alias = 0 then term end) as by_name from hits group by fact_key), e as (select fact_key, strlen(any_value(intent)) as size from (select fact_key, intent from facts where intent is not null) group by fact_key),
b as (select r.*, size from r join e using (fact_key) order by n_terms desc, by_name desc, fact_key limit 40), o as (select *, row_number() over (order by n_terms desc, by_name desc, fact_key) as position, sum(size) over (order by n_terms desc, by_name desc, fact_key) as total from b)
select position::int as position, fact_key, n_terms, by_name, size::int as size from o where total <= 1024""")
def context_build(spark: SparkSession, d: str) -> DataFrame:
    """The facts that the index finds for the asked terms, best first, with their intents, as far as 1,024 bytes go."""
    evidence = V.facts(spark, d).where("intent is not null").groupBy("fact_key").agg(F.octet_length(F.min("intent")).alias("size"))
    return S.context(P.lookup(written(spark, d), P.term_table(spark, ASKED)), evidence, "size", 40, 1024)


SLICE = GRAPH_SQL["flow_slice"].split(", e as (")[0]


@query("call_envelope", f"{SLICE}, m as ({GRAPH_SQL['outcome_masks'].replace('with s as', 'with s as', 1)}) select h.node, position::int as position, coalesce(mask, 0) as mask from held h left join m on m.node = h.node")
def call_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The nodes within the limits of a flow, each with the outcomes it can reach."""
    near = flow_slice_nodes(spark, d)
    return near.select("node", "position").join(outcome_masks(spark, d), "node", "left").select("node", F.col("position").cast("int").alias("position"), F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))


@query("question_packet", f"{SLICE} select o_orderkey, o_custkey, o_orderstatus from orders where 'o' || o_orderkey in (select node from held) and o_orderstatus <> 'P'")
def question_packet(spark: SparkSession, d: str) -> DataFrame:
    """The orders within the limits of a flow that a purpose admits."""
    near = flow_slice_nodes(spark, d).select("node")
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").withColumn("node", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    return o.join(near, "node", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("linked_calls", f"""with {V.EDGES_SQL}, n as (select target, count(distinct source) as n, min(source) as one from edges where kind = 'READS' group by target)
select e.source, e.target, case when n.n is null then 'UNRESOLVED' when n.n = 1 then 'LINKED' else 'AMBIGUOUS' end as status, case when n.n = 1 then n.one end as linked from edges e left join n on n.target = 's' || substr(e.target, 2) where e.kind = 'REFERENCES'""")
def linked_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls to the one source that reads what they name."""
    e = V.edges(spark, d)
    calls = e.where("kind = 'REFERENCES'").select("source", "target", F.concat(F.lit("s"), F.substring("target", 2, 99)).alias("name"))
    return G.linked(calls, e.where("kind = 'READS'").select(F.col("target").alias("name"), F.col("source").alias("declaration")))
