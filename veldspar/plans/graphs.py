"""Graph queries: on the code graph, and on graphs derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions.keys import norm_id, trimmed
from veldspar.operators import graph, hierarchy
from veldspar.operators.ranking import top_with_rest
from veldspar.plans.register import Book
from veldspar.session import checkpointed
from veldspar.sources.tables import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def sql_id(c: str) -> str:
    return f"nullif(lower(trim({c}, {_WS})), '')"


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): each customer nation with the two supplier nations of most lineitems."""
    lines = (
        table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
        .join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey")
        .join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
        .where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )
    return checkpointed(top_with_rest(lines, ["src"], [F.desc("n"), F.col("dst")], 2).select("src", "dst"))


TRADE = """trade as materialized (select src, dst from (select src, dst, row_number() over (partition by src order by count(*) desc, dst) r from
 (select c_nationkey src, s_nationkey dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey)
 group by src, dst) where r <= 2)"""


def calls(spark: SparkSession, d: str, *types: str) -> DataFrame:
    """(src, dst) of the code graph's edges of the given types."""
    e = table(spark, d, "edges").where(F.upper(trimmed("type")).isin(*(types or ("CALLS",))))
    return e.select(norm_id("src").alias("src"), norm_id("dst").alias("dst"))


def sql_calls(*types: str) -> str:
    names = ", ".join(f"'{t}'" for t in types or ("CALLS",))
    return f"calls as materialized (select distinct {sql_id('src')} src, {sql_id('dst')} dst from edges where upper(trim(type)) in ({names}) and {sql_id('src')} is not null and {sql_id('dst')} is not null)"


def current_nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per node id: its last version."""
    n = table(spark, d, "nodes").select(norm_id("id").alias("id"), F.struct("last_indexed", "ord").alias("v"), F.struct(*columns).alias("n")).where("id is not null")
    return n.groupBy("id").agg(F.max_by("n", "v").alias("n")).select("id", "n.*")


def sql_nodes(*columns: str) -> str:
    cols = ", ".join(columns)
    return f"cur as materialized (select i id, {cols} from (select {sql_id('id')} i, {cols}, row_number() over (partition by {sql_id('id')} order by last_indexed desc, ord desc) r from nodes) where r = 1 and i is not null)"


def hottest(edges: DataFrame, column: str = "dst") -> DataFrame:
    """(origin): the node with most rows, the least of several."""
    return edges.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1).select(F.col(column).alias("origin"))


@query(f"with recursive {TRADE}, up(target, node, d) as (select distinct dst, dst, 0 from trade union select up.target, t.src, d + 1 from up join trade t on t.dst = up.node where d < 4) select target, count(distinct node) as blast_count from up where node <> target group by 1")
def g_blast_radius(spark, d):
    """Distinct nations that reach each supplier nation within four hops."""
    e = trade_edges(spark, d)
    far = graph.distances(e, e.select(F.col("dst").alias("origin")).distinct(), 4, reverse=True)
    return far.where("hops > 0").groupBy(F.col("origin").alias("target")).agg(F.count(F.lit(1)).alias("blast_count"))


_START = "(select dst from (select {e} dst from edges where upper(trim(type)) = 'CALLS') where dst is not null group by 1 order by count(*) desc, dst limit 1)".format(e=sql_id("dst"))


@query(f"with recursive {sql_calls()}, w(node, d) as (select {_START}, 0 union select c.src, d + 1 from w join calls c on c.dst = w.node where d < 4) select node, min(d) as hops from w group by 1")
def g_bfs_reverse(spark, d):
    """Hops from the most called node back to its callers."""
    e = checkpointed(calls(spark, d))
    return graph.distances(e, hottest(e), 4, reverse=True).select("node", "hops")


@query(
    f"with recursive {sql_calls('CALLS', 'EXTENDS', 'INSTANTIATES')}, s as (select src from (select {sql_id('src')} src from edges where upper(trim(type)) in ('CALLS', 'EXTENDS', 'INSTANTIATES')) where src is not null group by 1 order by count(*) desc, src limit 1), w(node, d) as (select src, 0 from s union select c.dst, d + 1 from w join calls c on c.src = w.node where d < 3) select node, min(d) as hops from w group by 1"
)
def g_bfs_forward(spark, d):
    e = checkpointed(calls(spark, d, "CALLS", "EXTENDS", "INSTANTIATES"))
    return graph.distances(e, hottest(e, "src"), 3).select("node", "hops")


_SURE = f"sure as materialized (select distinct {sql_id('src')} src, {sql_id('dst')} dst from edges where upper(trim(type)) in ('CALLS', 'IMPORTS', 'EXTENDS', 'INSTANTIATES') and coalesce(confidence, '') <> 'AMBIGUOUS' and {sql_id('src')} is not null and {sql_id('dst')} is not null)"


def _sure_edges(spark, d):
    e = table(spark, d, "edges").where(F.upper(trimmed("type")).isin("CALLS", "IMPORTS", "EXTENDS", "INSTANTIATES") & (F.coalesce("confidence", F.lit("")) != "AMBIGUOUS"))
    return checkpointed(graph.pairs(e.select(norm_id("src").alias("src"), norm_id("dst").alias("dst"))))


@query(f"with recursive {_SURE}, w(origin, node, d) as (select dst, dst, 0 from sure union select origin, s.src, d + 1 from w join sure s on s.dst = w.node where d < 2) select origin, node, min(d) as hops from w where node <> origin group by 1, 2")
def g_reverse_dependents(spark, d):
    """Dependents within two hops, over certain edges, of every node that has any, hot ones too."""
    e = _sure_edges(spark, d)
    return graph.distances(e, e.select(F.col("dst").alias("origin")).distinct(), 2, reverse=True).where("hops > 0").select("origin", "node", "hops")


@query(f"with recursive {TRADE}, w(node, d) as (select 0, 0 union select t.src, d + 1 from w join trade t on t.dst = w.node where d < 25) select node, min(d) + 1 as n_nodes from w group by 1")
def g_shortest_path(spark, d):
    """Length of a shortest path on which a nation reaches nation 0."""
    return graph.shortest_paths(trade_edges(spark, d), 0, 25).select("node", F.size("path").alias("n_nodes"))


_PATHS = f"with recursive {TRADE}, p(path) as (select [src] from (select distinct src from trade) union all select list_append(path, t.dst) from p join trade t on t.src = path[-1] where len(path) < 4 and not list_contains(path, t.dst))"


@query(_PATHS + ", q as (select row_number() over () i, path from p where len(path) = 4), u as (select i, unnest(path) n, unnest(range(1, 5)) k from q), s as (select i, string_agg(r_name, '>' order by k) shape from u join nation on n_nationkey = n join region on r_regionkey = n_regionkey group by 1) select shape, count(*) as n from s group by 1")
def g_path_shapes(spark, d):
    """Paths of four nations collapsed to the sequence of their regions."""
    e = trade_edges(spark, d)
    p = graph.simple_paths(e, e.select(F.col("src").alias("node")), 3).where("hops = 3").select(F.col("path").alias("i"), F.posexplode("path").alias("at", "n_nationkey"))
    role = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    named = p.join(role, "n_nationkey").groupBy("i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "r_name"))), lambda s: s["r_name"]), ">").alias("shape"))
    return named.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))




def _module(c="file"):
    from veldspar.functions.text import path_segments

    return path_segments(F.col(c))[0]


def module_imports(spark, d):
    """(repo, src, dst, n): import edges between top-level directories of a repository."""
    n = current_nodes(spark, d, "repo", "file").where("file is not null").select("id", "repo", _module().alias("m"))
    e = calls(spark, d, "IMPORTS")
    a, b = n.withColumnsRenamed({"id": "src", "m": "ms", "repo": "rs"}), n.withColumnsRenamed({"id": "dst", "m": "md", "repo": "rd"})
    return e.join(a, "src").join(b, "dst").where("rs = rd and ms <> md").groupBy(F.col("rs").alias("repo"), F.col("ms").alias("src"), F.col("md").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


SQL_MODULE_IMPORTS = f"""{sql_nodes('repo', 'file')},
mod as (select id, repo, regexp_extract(regexp_replace(replace(file, chr(92), '/'), '^(\\./|/)+', ''), '^[^/]*') m from cur where file is not null),
imp as materialized (select a.repo, a.m src, b.m dst, count(*) n from (select {sql_id('src')} s, {sql_id('dst')} t from edges where upper(trim(type)) = 'IMPORTS') e join mod a on a.id = s join mod b on b.id = t where a.repo = b.repo and a.m <> b.m group by 1, 2, 3)"""


@query(f"with {SQL_MODULE_IMPORTS} select repo, src as from_module, dst as to_module, n from imp order by n desc, repo, src, dst limit 25")
def a_coupling(spark, d):
    """The 25 pairs of modules with most imports between them."""
    return module_imports(spark, d).orderBy(F.desc("n"), "repo", "src", "dst").limit(25).select("repo", F.col("src").alias("from_module"), F.col("dst").alias("to_module"), "n")


_LINKED = f"with recursive {sql_calls('CALLS', 'INSTANTIATES', 'EXTENDS', 'INHERITS', 'OVERRIDES')}, {sql_calls('EXTENDS').replace('calls as', 'up as')}, {sql_calls('CONTAINS', 'DEFINES').replace('calls as', 'owns as')}, {sql_nodes('label', 'name', 'param_count')}, above(a, b) as (select src, dst from up union select above.a, up.dst from above join up on up.src = above.b), ov as (select a.id src, b.id dst from cur a join owns oa on oa.dst = a.id join above on above.a = oa.src and above.b <> oa.src join owns ob on ob.src = above.b join cur b on b.id = ob.dst where a.label = 'Function' and b.label = 'Function' and a.name = b.name and a.param_count = b.param_count)"


@query(_LINKED + """, every as (select src, dst from calls union select src, dst from ov), s as materialized (select src a, dst b from every where src <> dst union select dst, src from every where src <> dst),
w(node, c) using key (node) as (select a, a from s group by 1 union select s.b, min(w.c) from w join s on s.a = w.node where not exists (select 1 from recurring.w r where r.node = s.b and r.c <= w.c) group by 1)
select component, count(*) as n_nodes from (select node, min(c) component from w group by 1) group by 1""")
def g_components(spark, d):
    """Connected components over calls, instantiations, inheritance and overrides, with their sizes.

    Overrides are those stated as edges and those that j_overrides derives.
    """
    derived = j_overrides(spark, d).select(F.col("sub_method").alias("src"), F.col("super_method").alias("dst"))
    return graph.components(calls(spark, d, "CALLS", "INSTANTIATES", "EXTENDS", "INHERITS", "OVERRIDES").unionByName(derived)).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"with recursive {TRADE}, s as (select src a, dst b from trade union select dst, src from trade), w(node, c) as (select distinct a, a from s union select s.b, w.c from w join s on s.a = w.node) select node, min(c) as component from w group by 1")
def g_components_trade(spark, d):
    return graph.components(trade_edges(spark, d))


@query("select 'order' as kind, cast(o_orderkey as bigint) as id, r_name as region, 3 as hops from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey union all select 'customer', c_custkey, r_name, 2 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def g_ancestor(spark, d):
    """The region above each order and customer, by climbing the containment tree."""
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    link = lambda t, child, cc, parent, pc: table(spark, d, t).select(F.lit("CONTAINS").alias("type"), key(parent, pc).alias("src"), key(child, cc).alias("dst"), F.lit(None).cast("string").alias("repo"))
    edges = link("orders", "order", "o_orderkey", "customer", "o_custkey").unionByName(link("customer", "customer", "c_custkey", "nation", "c_nationkey")).unionByName(link("nation", "nation", "n_nationkey", "region", "n_regionkey"))
    names = table(spark, d, "region").select(key("region", "r_regionkey").alias("root_id"), "r_name")
    tree = hierarchy.hierarchy(edges).where("split(node_id, ':')[0] in ('order', 'customer')")
    part = F.split("node_id", ":")
    return tree.join(F.broadcast(names), "root_id").select(part[0].alias("kind"), part[1].cast("bigint").alias("id"), F.col("r_name").alias("region"), F.col("depth").cast("int").alias("hops"))


@query("select r_regionkey as root, 'nation' as kind, count(*) as n from region join nation on n_regionkey = r_regionkey group by 1 union all select r_regionkey, 'customer', count(*) from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1")
def g_descendants(spark, d):
    """All nations and customers below each region."""
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edges = (
        table(spark, d, "customer").select(key("nation", "c_nationkey").alias("src"), key("customer", "c_custkey").alias("dst"))
        .unionByName(table(spark, d, "nation").select(key("region", "n_regionkey").alias("src"), key("nation", "n_nationkey").alias("dst")))
        .withColumn("type", F.lit("CONTAINS"))
    )
    pairs = hierarchy.descendants(hierarchy.hierarchy(edges)).where("ancestor_id like 'region:%'")
    return pairs.groupBy(F.split("ancestor_id", ":")[1].cast("int").alias("root"), F.split("node_id", ":")[0].alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("with p as (select distinct string_split(fqn, '.') l from nodes where label in ('Package', 'File') and fqn is not null and fqn <> '') select distinct array_to_string(l[1:i], '.') as node, case when i > 1 then array_to_string(l[1:i - 1], '.') end as parent from (select l, unnest(range(1, len(l) + 1)) i from p)")
def g_package_tree(spark, d):
    """Every dotted prefix of the packages' and files' names below the next shorter one."""
    return graph.prefix_tree(table(spark, d, "nodes").where("label in ('Package', 'File')").select("fqn"), "fqn", ".")


@query(f"with {sql_calls()}, {sql_calls('CONTAINS', 'DEFINES').replace('calls as', 'holds as')}, {sql_nodes('name', 'label')}, t as (select id from cur where name = 'queue'), x as (select c.dst id from calls c join t on t.id = c.src union select c.src from calls c join t on t.id = c.dst union select h.src from holds h join t on t.id = h.dst) select cur.id, cur.name, cur.label from x join cur using (id) where x.id not in (select id from t)")
def g_expand(spark, d):
    """Callers, callees and containers around the nodes of one name."""
    n = current_nodes(spark, d, "name", "label")
    t = n.where("name = 'queue'").select("id")
    e, h = calls(spark, d), calls(spark, d, "CONTAINS", "DEFINES")
    near = e.join(t.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).unionByName(e.join(t.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"))).unionByName(h.join(t.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")))
    return near.distinct().join(t, "id", "left_anti").join(n, "id").select("id", "name", "label")


@query(
    f"with recursive {TRADE}, k as (select n_nationkey n, case when (select count(*) from trade where dst = n_nationkey) >= 5 then 3 else 2 end depth from nation), w(origin, node, d) as (select n, n, 0 from k union select origin, t.src, d + 1 from w join trade t on t.dst = w.node join k on k.n = origin where d < depth) select origin, count(distinct node) - 1 as n_reached from w group by 1"
)
def g_adaptive_depth(spark, d):
    """Reach of each nation, deeper where more trade with it."""
    e = trade_edges(spark, d)
    fan = e.groupBy(F.col("dst").alias("origin")).agg(F.count(F.lit(1)).alias("n"))
    starts = table(spark, d, "nation").select(F.col("n_nationkey").alias("origin")).join(fan, "origin", "left").select("origin", F.when(F.col("n") >= 5, 3).otherwise(2).alias("depth"))
    return graph.adaptive_distances(e, starts).groupBy("origin").agg((F.count(F.lit(1)) - 1).alias("n_reached"))


@query(f"with {sql_calls()}, f as (select dst id, count(*) n from (select {sql_id('dst')} dst from edges where upper(trim(type)) = 'CALLS') where dst is not null group by 1), o as (select src id, count(*) n from (select {sql_id('src')} src from edges where upper(trim(type)) = 'CALLS') where src is not null group by 1), r as (select distinct src id from calls where src = dst), {sql_nodes('label')} select cur.id, coalesce(f.n, 0) as fan_in, coalesce(o.n, 0) as fan_out, r.id is not null as recursive from cur left join f using (id) left join o using (id) left join r on r.id = cur.id where label = 'Function'")
def a_call_metrics(spark, d):
    """Calls into and out of each function, and whether it calls itself."""
    e = calls(spark, d)
    both = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), (F.col("src") == F.col("dst")).alias("r")).unionByName(e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(False).alias("r")))
    m = both.where("id is not null").groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.max("r").alias("recursive"))
    f = current_nodes(spark, d, "label").where("label = 'Function'").select("id")
    return f.join(m, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("recursive", F.lit(False)).alias("recursive"))


@query(f"with recursive {sql_calls('EXTENDS').replace('calls as', 'up as')}, {sql_calls('CONTAINS', 'DEFINES').replace('calls as', 'owns as')}, {sql_nodes('label', 'name', 'param_count')}, above(a, b) as (select src, dst from up union select above.a, up.dst from above join up on up.src = above.b) select distinct a.id as sub_method, b.id as super_method from cur a join owns oa on oa.dst = a.id join above on above.a = oa.src and above.b <> oa.src join owns ob on ob.src = above.b join cur b on b.id = ob.dst where a.label = 'Function' and b.label = 'Function' and a.name = b.name and a.param_count = b.param_count")
def j_overrides(spark, d):
    """Methods that override one of the same name and parameter count in any class above."""
    n = current_nodes(spark, d, "label", "name", "param_count").where("label = 'Function'").select("id", "name", F.col("param_count").alias("n_params"))
    own = graph.pairs(calls(spark, d, "CONTAINS", "DEFINES")).select(F.col("src").alias("owner"), F.col("dst").alias("id"))
    return graph.transitive_overrides(calls(spark, d, "EXTENDS"), n.join(own, "id"))


@query(f"with {sql_calls()}, h1 as (select dst origin, src caller from calls), h2 as (select c.dst caller, count(*) n from calls c group by 1) select origin, count(*) as n_callers, sum(coalesce(h2.n, 0)) as n_second from h1 left join h2 using (caller) group by 1")
def a_hop2(spark, d):
    """Callers of each node and the sum of their own callers."""
    e = graph.pairs(calls(spark, d))
    second = e.groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(second, "src", "left").groupBy(F.col("dst").alias("origin")).agg(F.count(F.lit(1)).alias("n_callers"), F.sum(F.coalesce("n", F.lit(0))).alias("n_second"))


@query(f"with {sql_nodes('repo', 'package')}, {sql_calls('CALLS', 'IMPORTS', 'INSTANTIATES', 'EXTENDS')}, e as (select {sql_id('src')} s, {sql_id('dst')} t, ord from edges where upper(trim(type)) in ('CALLS', 'IMPORTS', 'INSTANTIATES', 'EXTENDS')) select a.repo, a.package as src_package, b.package as dst_package, min(e.ord) as first_ord, count(distinct e.ord) as n from e join cur a on a.id = s join cur b on b.id = t where a.repo = b.repo and a.package <> b.package group by 1, 2, 3")
def a_component_uses(spark, d):
    """Which packages use which, with the first edge as evidence."""
    n = current_nodes(spark, d, "repo", "package").where("package is not null")
    e = table(spark, d, "edges").where(F.upper(trimmed("type")).isin("CALLS", "IMPORTS", "INSTANTIATES", "EXTENDS")).select(norm_id("src").alias("src"), norm_id("dst").alias("dst"), "ord").distinct()
    return e.join(n.withColumnsRenamed({"id": "src", "repo": "r1", "package": "src_package"}), "src").join(n.withColumnsRenamed({"id": "dst", "repo": "r2", "package": "dst_package"}), "dst").where("r1 = r2 and src_package <> dst_package").groupBy(F.col("r1").alias("repo"), "src_package", "dst_package").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"))


@query(f"with {sql_calls()}, {sql_nodes('label', 'name', 'is_test')} select cur.id, cur.name from cur where label = 'Function' and not coalesce(is_test, false) and name not in ('main', '__init__') and id not in (select dst from calls)")
def j_deadcode(spark, d):
    """Functions that nothing calls, tests and entry points aside."""
    n = current_nodes(spark, d, "label", "name", "is_test").where("label = 'Function' and not coalesce(is_test, false) and name not in ('main', '__init__')")
    return n.join(graph.pairs(calls(spark, d)).select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", "name")


@query(f"with {sql_nodes('name')}, e as (select distinct ord, {sql_id('src')} s, {sql_id('dst')} t, upper(trim(type)) ty from edges) select 'out' as direction, e.ty as type, cur.id as node_id, cur.name, x.id as far_id from e join cur on cur.id = e.s join cur x on x.id = e.t where cur.name = 'queue' union all select 'in', e.ty, cur.id, cur.name, x.id from e join cur on cur.id = e.t join cur x on x.id = e.s where cur.name = 'queue'")
def j_node_detail(spark, d):
    """All edges of the nodes of one name, with the far node."""
    n = current_nodes(spark, d, "name")
    t = n.where("name = 'queue'").select(F.col("id").alias("node_id"), "name")
    e = table(spark, d, "edges").select("ord", norm_id("src").alias("src"), norm_id("dst").alias("dst"), F.upper(trimmed("type")).alias("type")).distinct()
    far = n.select(F.col("id").alias("far_id"))
    one = lambda a, b, name: e.withColumnRenamed(a, "node_id").join(t, "node_id").withColumnRenamed(b, "far_id").join(far, "far_id").select(F.lit(name).alias("direction"), "type", "node_id", "name", "far_id")
    return one("src", "dst", "out").unionByName(one("dst", "src", "in"))


@query(f"with {sql_calls()} select src, count(*) as n_callees, min(dst) as first_callee from calls group by 1")
def j_adjacent(spark, d):
    return graph.pairs(calls(spark, d)).groupBy("src").agg(F.count(F.lit(1)).alias("n_callees"), F.min("dst").alias("first_callee"))


@query(f"with {sql_calls()}, {sql_nodes('label')}, c as (select dst id, list_sort(list(src))[:40] callers, count(*) n from calls group by 1) select cur.id, coalesce(n, 0) as n, array_to_string(callers, ',') as callers from cur left join c using (id) where label = 'Class'")
def j_optional_collect(spark, d):
    """Each class with its callers, at most forty, classes without any too."""
    c = graph.pairs(calls(spark, d))
    w = W.partitionBy("dst").orderBy("src")
    top = c.withColumn("r", F.row_number().over(w)).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("r") <= 40, F.col("src")))), ",").alias("callers"))
    return current_nodes(spark, d, "label").where("label = 'Class'").select("id").join(top, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "callers")
