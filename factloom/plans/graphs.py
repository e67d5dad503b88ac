"""Queries on graphs, lattices, contracts, constraints, sinks and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import contracts as C
from factloom.operators import graph as G
from factloom.operators import lattice as L
from factloom.operators import validation as N
from factloom.plans import views as V
from factloom.plans.views import EDGES_SQL, STATES_SQL
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


#: Publications and contexts under the record that they name as their parent.
PARENTS_SQL = r"""recs as (select distinct 'P' || id as node, 'P' || regexp_replace(lower(trim(parent, ' ' || chr(9) || chr(10) || chr(13))), '^(publication:|context:)', '') as up from publications
  union select distinct 'C' || regexp_replace(context_id, '^context:', ''), 'C' || regexp_replace(lower(trim(parent_context_id, ' ' || chr(9) || chr(10) || chr(13))), '^(publication:|context:)', '') from contexts),
tree as (select node as target, up as source from recs where up in (select node from recs))"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.hierarchy import nodes

    rows = nodes(table(spark, d, "publications"), "P", "id", "parent", "loaded_at").unionByName(nodes(table(spark, d, "contexts"), "C", "context_id", "parent_context_id", "loaded_at"))
    rows = rows.select(F.concat("kind", "key").alias("target"), F.concat("kind", "pkey").alias("source"))
    return rows.where("source is not null").join(rows.select(F.col("target").alias("source")), "source", "left_semi").select("source", "target")


def records(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators.hierarchy import nodes

    rows = nodes(table(spark, d, "publications"), "P", "id", "parent", "loaded_at").unionByName(nodes(table(spark, d, "contexts"), "C", "context_id", "parent_context_id", "loaded_at"))
    return rows.select(F.concat("kind", "key").alias("node"))


BFS = """recursive r(node, depth) as (select 'c' || c_custkey, 0 from customer where c_acctbal > 9900 union select target, depth + 1 from r join edges on source = node where depth < 3)"""


@query("bfs_depth", f"with {EDGES_SQL}, {BFS} select node, min(depth)::int as depth from r group by node".replace("with edges", "with recursive edges").replace(", recursive r", ", r"))
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "customer").where("c_acctbal > 9900").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return G.bfs(V.edges(spark, d).select("source", "target"), roots, 3)


@query("flow_slice", fr"""with recursive {EDGES_SQL}, r(node, depth) as (select 'c1', 0 union select target, depth + 1 from r join edges on source = node where depth < 4), b as (select node, min(depth) as depth from r group by node), near as (select node, row_number() over (order by depth, node) as position from b),
held as (select * from near where position <= 200), e as (select source, target, position, case when target in (select node from held) then 'RESOLVED' else 'BOUNDARY' end as status from edges join held on node = source) select source, target, status from e order by position, target limit 400""")
def flow_slice(spark: SparkSession, d: str) -> DataFrame:
    """Edges reached from one customer within the limits of a flow."""
    return G.slice_from(V.edges(spark, d), "c1", depth=4, nodes=200, max_edges=400)[1]


def flow_slice_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.slice_from(V.edges(spark, d), "c1", depth=4, nodes=200, max_edges=400)[0]


@query("reverse_closure", f"""with recursive {PARENTS_SQL}, r(node) as (select distinct 'P' || id from publications where documentation_language = 'ru' union select target from r join tree on source = node) select node from r""")
def reverse_closure(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "publications").where("documentation_language = 'ru'").select(F.concat(F.lit("P"), "id").alias("node")).distinct()
    uses = tree(spark, d).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return G.reverse_closure(uses, changed).select("node")


@query("update_plan", f"""with {STATES_SQL}, ch as (select 'c' || coalesce(b.o_custkey, a.o_custkey) as path from before b full join after a on a.o_custkey = b.o_custkey where b.priorities is distinct from a.priorities),
o as (select distinct 'o' || o_orderkey as path from orders where 'c' || o_custkey in (select path from ch)), p as (select distinct 'p' || l_partkey as path from lineitem where 'o' || l_orderkey in (select path from o))
select path, 'CHANGED' as reason from ch union all select path, 'INVALIDATED' from o union all select path, 'INVALIDATED' from p""")
def update_plan(spark: SparkSession, d: str) -> DataFrame:
    b, a = V.order_states(spark, d)
    name = lambda df: df.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), F.col("priorities").alias("digest"))
    uses = V.edges(spark, d).where("source like 'c%' or source like 'o%'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return G.plan_update(name(b), name(a), uses, "path", "digest")


@query("outcome_masks", """with s as (select 's' || s_suppkey as node, 1::bigint << n_regionkey as mask from supplier join nation on n_nationkey = s_nationkey), p as (select 'p' || l_partkey as node, bit_or(mask) as mask from (select distinct l_partkey, l_suppkey from lineitem) join s on node = 's' || l_suppkey group by 1),
o as (select 'o' || l_orderkey as node, bit_or(mask) as mask from lineitem join p on node = 'p' || l_partkey group by 1), c as (select 'c' || o_custkey as node, bit_or(mask) as mask from orders join o on node = 'o' || o_orderkey group by 1)
select node, mask::bigint as mask from (select * from s union all select * from p union all select * from o union all select * from c)""")
def outcome_masks(spark: SparkSession, d: str) -> DataFrame:
    down = V.edges(spark, d).where("source not like 's%' and source not like 'n%'").select("source", "target")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return G.outcome_masks(down, s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.col("n_regionkey").alias("bit")))


@query("topo_levels", """select distinct 'n' || c_nationkey as node, 0 as level from customer union select 'c' || c_custkey, 1 from customer union select 'o' || o_orderkey, 2 from orders where o_custkey in (select c_custkey from customer)
 union select 'p' || l_partkey, 3 from lineitem union select 's' || l_suppkey, 4 from lineitem""")
def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    return G.topological_levels(V.edges(spark, d).where("kind <> 'WRITES'"))


TRADE_SQL = """trade as (select distinct c_nationkey as source, s_nationkey as target from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey where c_nationkey >= s_nationkey or s_acctbal < 2000)"""


@query("mutual_components", f"""with recursive {TRADE_SQL}, r(a, b) as (select source, target from trade union select a, target from r join trade on source = b), nodes as (select source as node from trade union select target from trade)
select n.node::varchar as node, least(n.node, coalesce((select min(x.b) from r x join r y on y.a = x.b and y.b = x.a where x.a = n.node), n.node))::varchar as component from nodes n""")
def mutual_components(spark: SparkSession, d: str) -> DataFrame:
    """Nations that trade with each other in a circle, named by the least of them."""
    t = lambda n: table(spark, d, n)
    e = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    e = e.where("c_nationkey >= s_nationkey or s_acctbal < 2000").select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).distinct()
    return G.components_mutual(e).select(F.col("node").cast("string").alias("node"), F.col("component").cast("string").alias("component"))


@query("path_claims", "select l_orderkey || ':' || l_partkey || ':' || l_suppkey as claim, not bool_or(l_returnflag = 'R') as valid from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey, l_partkey, l_suppkey")
def path_claims(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    l = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    l = l.groupBy("o_custkey", "l_orderkey", "l_partkey", "l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("wrong"))
    hops = [key("c", "o_custkey"), key("o", "l_orderkey"), key("p", "l_partkey"), key("s", "l_suppkey")]
    edge = lambda a, b: F.concat(a, F.lit(">"), b)
    refs = F.array(*[edge(a, b) for a, b in zip(hops, hops[1:])])
    rows = l.select(F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey").alias("claim"), F.posexplode(refs).alias("pos", "edge"), hops[0].alias("subject"), F.when(F.col("wrong"), hops[0]).otherwise(hops[3]).alias("object"))
    return G.path_claims(rows, V.edges(spark, d).select(edge(F.col("source"), F.col("target")).alias("edge"), "source", "target").distinct())


def _steps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("owner"), (F.row_number().over(w) - 1).alias("ordinal"), "event_type", "value", "props")


@query("local_order")
def local_order(spark: SparkSession, d: str) -> DataFrame:
    """The control graph of each user's events: does the second come before the last, and always so?"""
    steps = _steps(spark, d)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal", ignore_index=True)
        n = len(pdf)
        nodes = pd.DataFrame({"node": pdf["ordinal"], "role": ["ENTRY" if i == 0 else "DEAD" if v < 1 else "STEP" for i, v in enumerate(pdf["value"])]})
        jumps = [(i, min(i + 2, n - 1), "FLOW") for i in range(n - 1) if pdf["event_type"][i] == "click"]
        edges = pd.DataFrame([(i, i + 1, "FLOW") for i in range(n - 1)] + jumps, columns=["source", "target", "kind"])
        reach, dominate, why = G.local_order(nodes, edges, min(1, n - 1), n - 1)
        return pd.DataFrame({"owner": [pdf["owner"][0]], "may_reach": [reach], "dominates": [dominate], "reason": [why]})

    return steps.groupBy("owner").applyInPandas(run, "owner string, may_reach boolean, dominates boolean, reason string")


@query("back_edges")
def back_edges(spark: SparkSession, d: str) -> DataFrame:
    """Cycles in the graph of each user's event types, in order of first sight."""
    w = Window.partitionBy("owner").orderBy("ordinal")
    e = _steps(spark, d).withColumn("target", F.lead("event_type").over(w)).where("target is not null")
    e = e.groupBy(F.col("owner").alias("graph"), F.col("event_type").alias("source"), "target").agg(F.min("ordinal").cast("long").alias("ordinal"))
    return e.groupBy("graph").applyInPandas(G.back_edges, "graph string, source string, target string, ordinal long")


@query("orphan_objects", f"""with recursive {PARENTS_SQL}, objs as (select node as digest from recs where node in (select 'P' || id from publications where released) or node like 'C%'), r(digest) as (select 'P' || id from publications where released union select source from r join tree on target = digest)
select digest, 'LIVE' as state from objs where digest in (select digest from r) union select digest, 'DEAD' from objs where digest not in (select digest from r) union select digest, 'DANGLING' from r where digest not in (select digest from objs)""")
def orphan_objects(spark: SparkSession, d: str) -> DataFrame:
    """What released publications refer to: kept, unused, or not kept though referred to."""
    roots = table(spark, d, "publications").where("released").select(F.concat(F.lit("P"), "id").alias("digest")).distinct()
    objs = roots.unionByName(records(spark, d).where("node like 'C%'").select(F.col("node").alias("digest")))
    return G.reachable_objects(objs, tree(spark, d).select(F.col("target").alias("source"), F.col("source").alias("target")), roots)


@query("nullness_fixpoint")
def nullness_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Equations from each user's events; the last one is asked for."""
    steps = _steps(spark, d)
    node = lambda n: F.concat(F.lit("v"), n.cast("string"))
    o = F.col("ordinal")
    op = F.when(o < 2, F.when(F.col("value") > 50, "NULL").otherwise("NON_NULL")).when(F.col("event_type") == "click", "JOIN").when(F.col("event_type") == "view", "COPY").when(F.col("event_type") == "purchase", "COALESCE").otherwise("NON_NULL")
    values = steps.select("owner", node(o).alias("id"), op.alias("op"), F.array(node(F.greatest(o - 1, F.lit(0))), node(F.greatest(o - 2, F.lit(0)))).alias("operands"), F.array().cast("array<string>").alias("guards"))
    targets = steps.groupBy("owner").agg(F.concat(F.lit("v"), F.max("ordinal").cast("string")).alias("target"))
    return L.nullness(values, targets)


@query("value_spread", """with c as (select 'c' || c_custkey as id, case when c_acctbal < 0 then 1 else 2 end as bits from customer), o as (select 'o' || o_orderkey as id, bit_or(bits) as bits from orders join c on id = 'c' || o_custkey group by 1),
p as (select 'p' || l_partkey as id, bit_or(bits) as bits from lineitem join o on id = 'o' || l_orderkey group by 1), s as (select 's' || l_suppkey as id, bit_or(bits) as bits from (select distinct l_partkey, l_suppkey from lineitem) join p on id = 'p' || l_partkey group by 1),
k as (select * from c union all select * from o union all select * from p union all select * from s) select id, bits::int as bits from k union all select 'x' || n_nationkey, 3 from nation""")
def value_spread(spark: SparkSession, d: str) -> DataFrame:
    """What customers' balances say, handed down to orders, parts and suppliers; nations get nothing."""
    flows = V.edges(spark, d).where("source not like 'n%' and kind <> 'WRITES'").select("source", "target").distinct()
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_acctbal") < 0, 1).otherwise(2).alias("bits"))
    rest = flows.select(F.col("target").alias("id")).distinct().join(c.select("id"), "id", "left_anti").withColumn("bits", F.lit(0))
    alone = table(spark, d, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(0).alias("bits"))
    return L.spread(c.unionByName(rest).unionByName(alone), flows)


# --- contracts -----------------------------------------------------------------------------------

_ENTRY_SQL = """entries as (select p_partkey as entry, case when p_size < 10 then ['get', 'post'] when p_size < 40 then ['GET'] else [] end as methods, case when p_size > 45 or p_size < 5 then ['/parts/' || replace(p_type, ' ', '/'), '/x/' || p_brand] else ['/parts/' || replace(p_type, ' ', '/')] end as paths from part)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    s, path = F.col("p_size"), F.concat(F.lit("/parts/"), F.replace("p_type", F.lit(" "), F.lit("/")))
    methods = F.when(s < 10, F.array(F.lit("get"), F.lit("post"))).when(s < 40, F.array(F.lit("GET"))).otherwise(none)
    paths = F.when((s > 45) | (s < 5), F.array(path, F.concat(F.lit("/x/"), "p_brand"))).otherwise(F.array(path))
    return table(spark, d, "part").select(F.col("p_partkey").alias("entry"), methods.alias("methods"), paths.alias("paths"))


ROUTES_SQL = f"""{_ENTRY_SQL}, e as (select entry, case when len(methods) > 1 and len(paths) > 1 then ['METHOD_PATH_CORRELATION_UNAVAILABLE', 'NO_COMPARABLE_ROUTE_PAIR'] when len(methods) = 0 then ['HTTP_METHOD_UNSPECIFIED'] else [] end as g,
 case when len(methods) > 1 and len(paths) > 1 or len(methods) = 0 then [''] else methods end as ms, case when len(methods) > 1 and len(paths) > 1 then [''] else paths end as ps from entries),
x as (select entry, g, upper(unnest(ms)) as method, ps from e), y as (select distinct entry, g, method, unnest(ps) as path from x),
routes as (select entry, method, path, case when starts_with(path, '/') and not contains(path, '#') then path end as key,
 list_sort(list_distinct(list_concat(g, list_filter([case when method not in ('GET','PUT','POST','DELETE','OPTIONS','HEAD','PATCH','TRACE') then 'HTTP_METHOD_UNKNOWN' end, case when not starts_with(path, '/') or contains(path, '#') then 'PATH_SEMANTICS_UNSUPPORTED' end], lambda v: v is not null)))) as gaps from y)"""


@query("declared_routes", f"with {ROUTES_SQL} select entry, method, path, key, gaps from routes")
def declared_routes(spark: SparkSession, d: str) -> DataFrame:
    return C.routes(_entries(spark, d)).select("entry", "method", "path", "key", "gaps")


@query("route_reconcile", f"""with {ROUTES_SQL}, c as (select distinct p_type as contract, 'GET' as method, '/parts/' || replace(p_type, ' ', '/') as path from part union all select distinct 'again ' || p_type, 'GET', '/parts/' || replace(p_type, ' ', '/') from part where p_type like 'E%' union all select distinct p_brand, 'PUT', '/x/' || p_brand from part),
ck as (select *, case when not contains(path, '#') then path end as key from c), nr as (select method, key, count(*) as nr from routes where len(gaps) = 0 group by all), nc as (select method, key, count(*) as nc from ck where key is not null group by all)
select 'CONTRACT_TO_SOURCE' as direction, contract as id, ck.method, path, case when ck.key is null then 'UNSUPPORTED_INCOMPLETE' when nc > 1 then 'AMBIGUOUS' when nr is null then 'CONTRACT_ONLY_UNPROVEN' when nr > 1 then 'AMBIGUOUS' else 'MATCHED' end as status, coalesce(nr, 0) as matches from ck left join nr on nr.method = ck.method and nr.key = ck.key left join nc on nc.method = ck.method and nc.key = ck.key
union all select 'SOURCE_TO_CONTRACT', entry::varchar, r.method, path, case when len(gaps) > 0 then 'UNSUPPORTED_INCOMPLETE' when nc is null then 'DECLARED_ROUTE_ONLY' when nc > 1 or nr > 1 then 'AMBIGUOUS' else 'MATCHED' end, coalesce(nc, 0) from routes r left join nr on nr.method = r.method and nr.key = r.key left join nc on nc.method = r.method and nc.key = r.key""")
def route_reconcile(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    path = F.concat(F.lit("/parts/"), F.replace("p_type", F.lit(" "), F.lit("/")))
    c = p.select(F.col("p_type").alias("contract"), F.lit("get").alias("method"), path.alias("path")).distinct()
    c = c.unionByName(p.where("p_type like 'E%'").select(F.concat(F.lit("again "), "p_type").alias("contract"), F.lit("GET").alias("method"), path.alias("path")).distinct())
    c = c.unionByName(p.select(F.col("p_brand").alias("contract"), F.lit("put").alias("method"), F.concat(F.lit("/x/"), "p_brand").alias("path")).distinct())
    routes = C.routes(_entries(spark, d)).withColumn("entry", F.col("entry").cast("string"))
    return C.reconcile(c, routes)


@query("merged_parameters", "select p_brand as operation, p_type as name, p_name as value, 'OPERATION' as level from (select p_brand, p_type, min(p_name) as p_name from part where p_size > 25 group by all) union all select p_brand, p_type, v, 'PATH' from (select p_brand, p_type, max(p_name) as v from part group by all) where (p_brand, p_type) not in (select p_brand, p_type from part where p_size > 25)")
def merged_parameters(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("operation"), F.col("p_type").alias("name"), F.col("p_name").alias("value"), "p_size")
    keys = ["operation", "name"]
    return C.merge_parameters(p.groupBy(*keys).agg(F.max("value").alias("value")), p.where("p_size > 25").groupBy(*keys).agg(F.min("value").alias("value")), keys)


LINES_SQL = "lines as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return l.withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey"))


@query("nth_call_site", f"""with {LINES_SQL}, d as (select distinct l_orderkey as owner, l_linenumber - 1 as ordinal, max(l_partkey) as expected from lines group by all union all select o_orderkey, 99, 0 from orders), c as (select l_orderkey as owner, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as ordinal, l_partkey as target from lines)
select d.owner, d.ordinal::int as ordinal, expected, target, case when target is null then 'MISSING' when target = expected then 'MATCH' else 'DIFFERENT' end as status from d left join c on c.owner = d.owner and c.ordinal = d.ordinal""")
def nth_call_site(spark: SparkSession, d: str) -> DataFrame:
    l = _lines(spark, d)
    declared = l.groupBy(F.col("l_orderkey").alias("owner"), (F.col("l_linenumber") - 1).alias("ordinal")).agg(F.max("l_partkey").alias("expected"))
    declared = declared.unionByName(table(spark, d, "orders").select(F.col("o_orderkey").alias("owner"), F.lit(99).alias("ordinal"), F.lit(0).cast("long").alias("expected")))
    return C.nth_call(l.select(F.col("l_orderkey").alias("owner"), "place", F.col("l_partkey").alias("target")), declared, "owner", "place")


# --- constraints ---------------------------------------------------------------------------------


@query("event_stream_check", """with n as (select o_custkey, count(*) as n from orders group by all) select o_custkey as attempt, 'NOT_COMPLETED' as problem from n join customer on c_custkey = o_custkey where c_acctbal < 0 union all select o_custkey, 'COUNT_DIFFERS' from n join customer on c_custkey = o_custkey where c_acctbal >= 0 and c_nationkey = 3""")
def event_stream_check(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as shards of a stream; some never complete, some miscount."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    shards = o.select(F.col("o_custkey").alias("attempt"), seq.alias("seq"), F.lit("SHARD").alias("kind"), F.col("o_orderkey").alias("first_key"), F.col("o_orderkey").alias("last_key"), F.lit(1).cast("long").alias("rows"))
    ends = o.where("c_acctbal >= 0").groupBy("o_custkey", "c_nationkey").agg(F.count("*").alias("n"))
    ends = ends.select(F.col("o_custkey").alias("attempt"), F.col("n").cast("int").alias("seq"), F.lit("COMPLETE").alias("kind"), F.lit(None).cast("long").alias("first_key"), F.lit(None).cast("long").alias("last_key"), F.when(F.col("c_nationkey") == 3, F.col("n") + 1).otherwise(F.col("n")).alias("rows"))
    return N.event_stream(shards.unionByName(ends), "attempt")


@query("key_order_check", f"with {LINES_SQL}, r as (select l_orderkey, l_linenumber, l_partkey, lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as before from lines) select l_orderkey, l_linenumber, l_partkey, before from r where l_partkey <= before")
def key_order_check(spark: SparkSession, d: str) -> DataFrame:
    return N.sorted_unique(_lines(spark, d), "l_orderkey", "place", "l_partkey").select("l_orderkey", "place.l_linenumber", "l_partkey", "before")


@query("duplicate_keys", "select id, count(*) as n from publications group by id having count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return N.duplicate_keys(table(spark, d, "publications"), ["id"])


@query("branch_check", r"""with s as (select user_id::varchar as owner, row_number() over (partition by user_id order by ts, event_id) - 1 as ordinal, event_type, value, props from events), k as (select owner, ordinal, case event_type when 'click' then 'IF' when 'view' then 'ELSE' when 'purchase' then 'END' else 'CALL' end as kind, props from s), d as (select *, coalesce(sum(case kind when 'IF' then 1 when 'END' then -1 else 0 end) over (partition by owner order by ordinal rows between unbounded preceding and 1 preceding), 0) as outer_ from k),
l as (select *, case kind when 'IF' then outer_ + 1 when 'ELSE' then outer_ end as level from d), q as (select *, (select arg_max(x.kind, x.ordinal) from l x where x.owner = l.owner and x.level = l.level and x.ordinal < l.ordinal) as before_ from l),
p as (select owner, ordinal, case when kind = 'IF' and trim(coalesce(props, '')) = '' then 'IF_CONDITION_MISSING' when kind = 'ELSE' and (outer_ <= 0 or coalesce(before_, '') <> 'IF') then 'ELSE_WITHOUT_OPEN_IF_OR_DUPLICATE_ELSE' when kind = 'END' and outer_ <= 0 then 'END_WITHOUT_OPEN_IF' end as problem from q),
f as (select owner, arg_min(problem, ordinal) as problem from p where problem is not null group by owner) select owner, problem from f union all select owner, 'IF_WITHOUT_END' from k where owner not in (select owner from f) group by owner having sum(case kind when 'IF' then 1 when 'END' then -1 else 0 end) > 0""")
def branch_check(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "IF").when(F.col("event_type") == "view", "ELSE").when(F.col("event_type") == "purchase", "END").otherwise("CALL")
    return N.branches(_steps(spark, d).select("owner", "ordinal", kind.alias("kind"), F.col("props").alias("text")), "owner")


@query("control_graph_check", """with n as (select l_orderkey as graph, l_linenumber as node, max((l_linenumber = 1 or l_returnflag = 'R')::int) as entry from lineitem group by all)
select graph, 'NOT_ONE_ENTRY' as problem from n group by graph having sum(entry) <> 1 union select graph, 'EDGE_WITHOUT_NODE' from n union select graph, 'NODE_REPEATED' from n where entry < 0""")
def control_graph_check(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("node")).agg(F.bool_or((F.col("l_linenumber") == 1) | (F.col("l_returnflag") == "R")).alias("e"))
    l = l.select("graph", "node", F.when(F.col("e"), "ENTRY").otherwise("STEP").alias("role"))
    edges = l.select("graph", F.col("node").alias("source"), (F.col("node") + 1).alias("target"))
    return N.control_graph(l, edges, "graph")


@query("closed_schema_check", """with m as (select distinct manifest_id, body from publication_manifests), k as (select *, case when json_valid(body) then json_type(body::json) end as t from m),
p as (select manifest_id, case when t is null or t <> 'OBJECT' then 'UNREADABLE' when len(list_filter(json_keys(body::json), lambda x: x not in ('schema', 'id', 'ordinal', 'parent', 'inputDigest', 'released', 'documentationLanguage', 'evidencePackages', 'files'))) > 0 then 'UNKNOWN_FIELD'
 when json_extract_string(body::json, '$.schema') is null or json_extract_string(body::json, '$.id') is null or json_extract_string(body::json, '$.ordinal') is null then 'MISSING_FIELD' end as problem from k) select manifest_id, problem from p where problem is not null""")
def closed_schema_check(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "publication_manifests").select("manifest_id", "body").distinct()
    return N.closed_schema(m, "body", ["schema", "id", "ordinal"], ["parent", "inputDigest", "released", "documentationLanguage", "evidencePackages", "files"]).select("manifest_id", "problem")


# --- sources, sinks and streams ------------------------------------------------------------------


@query("mermaid_graph", """with l as (select 0 as part, '' as key, 'flowchart LR' as line union all select 1, 'n' || n_nationkey, '  n' || n_nationkey || '["' || n_name || '"]' from nation union all select 1, 'r' || r_regionkey, '  r' || r_regionkey || '["' || r_name || '"]' from region
 union all select 2, 'r' || n_regionkey || '>n' || n_nationkey, '  r' || n_regionkey || case when n_nationkey > 12 then ' -.->|' else ' -->|' end || '"has"| n' || n_nationkey from nation) select row_number() over (order by part, key, line) - 1 as line_no, line from l""")
def mermaid_graph(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.render import mermaid

    n = table(spark, d, "nation")
    nodes = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label")).unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("label")))
    edges = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target"), F.lit("has").alias("label"), F.when(F.col("n_nationkey") > 12, "UNKNOWN").otherwise("DECLARED").alias("authority"))
    return mermaid(nodes, edges)


@query("flow_trees", r"""with s as (select user_id::varchar as owner, row_number() over (partition by user_id order by ts, event_id) - 1 as ordinal, event_type, value, props from events), k as (select owner, ordinal, event_type as label, case event_type when 'click' then 'IF' when 'purchase' then 'END' else 'ACTION' end as kind from s), a as (select *, sum(case kind when 'IF' then 1 when 'END' then -1 else 0 end) over (partition by owner order by ordinal) as total from k),
b as (select *, total - least(min(total) over (partition by owner order by ordinal), 0) as depth from a), c as (select *, coalesce(lag(depth) over (partition by owner order by ordinal), 0) as before_ from b)
select owner, string_agg(repeat('  ', before_::int) || case when kind = 'IF' then '[D] if (' || label || ') then' else label end, chr(10) order by ordinal) as tree from c where kind <> 'END' group by owner""")
def flow_trees(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.render import flow_tree

    kind = F.when(F.col("event_type") == "click", "IF").when(F.col("event_type") == "purchase", "END").otherwise("ACTION")
    return flow_tree(_steps(spark, d).select("owner", "ordinal", kind.alias("kind"), F.col("event_type").alias("label")), "owner")


@query("markdown_by_member", r"""with c as (select distinct session_id, context_id, intent from contexts where intent is not null), r as (select *, row_number() over (partition by session_id order by context_id) as turn from c), p as (select * from r order by turn, session_id limit 50)
select string_agg('- **' || session_id || '** ' || trim(regexp_replace(intent, '\s+', ' ', 'g')), chr(10) order by turn, session_id) as page from p""")
def markdown_by_member(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.render import markdown

    c = table(spark, d, "contexts").select("session_id", "context_id", "intent").where("intent is not null").distinct()
    return markdown(c, "session_id", "context_id", "intent", 50)


@query("ddl_tables")
def ddl_tables(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.ddl import statements

    s = table(spark, d, "sources").where("id like '%:sql:%' and text is not null").select("id", "text").distinct()
    return statements(s, "id", "text")


@query("contract_documents", """with p as (select distinct p_brand as file, '/parts/' || replace(p_type, ' ', '/') as path from part)
select file, 'GET' as method, path, path as path_key, 'get' as operation_id, ['query:q', 'path:id'] as parameters from p union all select file, 'POST', path, path, null, ['path:id'] from p""")
def contract_documents(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.openapi import operations

    paths = table(spark, d, "part").select("p_brand", F.concat(F.lit("/parts/"), F.replace("p_type", F.lit(" "), F.lit("/"))).alias("path")).distinct()
    item = F.concat(F.lit('"'), "path", F.lit('":{"parameters":[{"name":"id","in":"path"}],"get":{"operationId":"get","parameters":[{"name":"q","in":"query"}]},"post":{}}'))
    docs = paths.groupBy(F.col("p_brand").alias("file")).agg(F.concat(F.lit('{"openapi":"3.0.0","paths":{'), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("}}")).alias("text"))
    return operations(docs, "file", "text")


def _yaml_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Contracts of brands in YAML, that refer to each other's parts, themselves and a common document."""
    head, tail = "openapi: 3.0.3\npaths:\n", "components:\n  parameters:\n    q: {name: q, in: query, schema: {$ref: '#/components/schemas/S'}}\n  schemas:\n    S: {type: object, properties: {self: {$ref: '#/components/schemas/S'}, gone: {$ref: '#/components/schemas/Gone'}}}\n"
    paths = table(spark, d, "part").select("p_brand", F.replace("p_type", F.lit(" "), F.lit("/")).alias("t")).distinct()
    one = F.concat(F.lit("  /parts/"), "t", F.lit(":\n    get:\n      operationId: get\n      parameters:\n        - $ref: '#/components/parameters/q'\n      responses:\n        '200': {$ref: '../common.yaml#/ok'}\n        '400': {$ref: 'https://example.org/e.yaml#/x'}\n"))
    docs = paths.groupBy("p_brand").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(one)), ""), F.lit(tail)).alias("text"))
    docs = docs.select(F.concat(F.lit("api/"), "p_brand").alias("file"), "text")
    return docs.unionByName(spark.createDataFrame([("common.yaml", "ok:\n  description: fine\n"), ("broken.yaml", "a: [1"), ("empty.yaml", "")], "file string, text string"))


@query("yaml_operations", """select distinct 'api/' || p_brand as file, 'GET' as method, '/parts/' || replace(p_type, ' ', '/') as path, '/parts/' || replace(p_type, ' ', '/') as path_key, 'get' as operation_id, ['query:q'] as parameters from part""")
def yaml_operations(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.openapi import operations

    return operations(_yaml_contracts(spark, d), "file", "text")


@query("contract_states", """select distinct 'api/' || p_brand as file, 'DECLARED_OPENAPI' as status from part union select 'common.yaml', 'REGISTERED_REFERENCE_DOCUMENT' union select 'broken.yaml', 'INVALID_CONTRACT_JSON_YAML' union select 'empty.yaml', 'CONTRACT_SOURCE_UNAVAILABLE'""")
def contract_states(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.openapi import documents

    return documents(_yaml_contracts(spark, d), "file", "text").select("file", "status")


@query("contract_references", """with o as (select distinct 'api/' || p_brand as file, '/parts/' || replace(p_type, ' ', '/') as path from part), r as (select unnest(['#/components/parameters/q', '#/components/schemas/S', '#/components/schemas/Gone', 'common.yaml#/ok', 'https://example.org/e.yaml#/x']) as ref, unnest(['RESOLVED', 'RESOLVED', 'MISSING', 'RESOLVED', 'EXTERNAL']) as status)
select file, 'GET' as method, path, case when starts_with(ref, '#') then file || ref else ref end as reference, status from o, r""")
def contract_references(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.openapi import references

    return references(_yaml_contracts(spark, d), "file", "text")


@query("symbols_of_sources")
def symbols_of_sources(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.syntax import symbols

    s = V.sources(spark, d).where("text is not null and file is not null").select("id", "file", "text").distinct()
    return symbols(s, "id", "file", "text")


@query("static_resources", "select distinct id, file from sources where regexp_matches(lower(file), '\\.(properties|yml|yaml|json|toml)$')")
def static_resources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").where(F.lower("file").rlike(r"\.(properties|yml|yaml|json|toml)$")).select("id", "file").distinct()


@query("build_inputs", "select distinct id, file from sources where file is not null and split_part(file, '/', -1) in ('pom.xml', 'build.gradle', 'package.json')")
def build_inputs(spark: SparkSession, d: str) -> DataFrame:
    from factloom.sources.files import is_build_file

    return table(spark, d, "sources").where("file is not null").where(is_build_file("file")).select("id", "file").distinct()


@query("stream_hourly_counts", "select event_type, time_bucket(interval 1 hour, ts) as start, count(*) as n from events group by all")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    from factloom.streaming.facts import hourly_counts

    return hourly_counts(spark, f"{d}/events.parquet")


@query("stream_fact_append", "select event_id, user_id, event_type, 'sha256:' || sha256(props) as digest from events where props is not null")
def stream_fact_append(spark: SparkSession, d: str) -> DataFrame:
    from factloom.streaming.facts import append_facts

    return append_facts(spark, f"{d}/events.parquet")


@query("stream_sessions", """with e as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 30 minutes or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts) as n from e) select user_id, count(*) as rows, max(ts) as last_ts from s group by user_id, n""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    from factloom.streaming.facts import attempt_states

    return attempt_states(spark, f"{d}/events.parquet")
