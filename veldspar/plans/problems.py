"""Queries of the general problems: hierarchies, dangling references, hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions.keys import norm_id
from veldspar.operators import hierarchy as hi
from veldspar.operators import references as rf
from veldspar.operators import skew
from veldspar.sources.tables import table

#: Share of a table's rows from which on a key counts as heavy.
HEAVY_SHARE = 0.01


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hi.find_cycles(table(spark, d, "edges")).select("cycle_id", "node_id")


def _current_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select(norm_id("id").alias("id"), "last_indexed", "ord", "name").groupBy("id").agg(F.max_by("name", F.struct("last_indexed", "ord")).alias("name"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """A row per node and parent: its path of names, depth and root through that parent."""
    tree = hi.hierarchy(table(spark, d, "edges"), _current_names(spark, d))
    return tree.select("node_id", "parent_id", "primary", "root_id", "depth", "path", "on_cycle", "below_cycle")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Descendants over all links, through every parent and through cycles."""
    return hi.all_descendants(table(spark, d, "edges"))


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    return rf.dangling(table(spark, d, "edges"), table(spark, d, "refs"), table(spark, d, "nodes"), table(spark, d, "shared_nodes"), table(spark, d, "removed_nodes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).select("tbl", "field", "row_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references per table, field and month."""
    return _dangling(spark, d).groupBy("tbl", "field", F.date_format("t", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))


def p3_current(spark: SparkSession, d: str) -> DataFrame:
    """Ids that edges refer to and that do not exist after all changes."""
    refs = table(spark, d, "edges").select(norm_id("dst").alias("key"), "ord").where("key is not null").groupBy("key", "ord").agg(F.lit(1).alias("delta"))
    here = table(spark, d, "nodes").select(norm_id("id").alias("key")).unionByName(table(spark, d, "shared_nodes").select(norm_id("id").alias("key"))).distinct().withColumn("delta", F.lit(1))
    gone = table(spark, d, "removed_nodes").select(norm_id("id").alias("key")).distinct().withColumn("delta", F.lit(-1))
    return rf.orphan_keys(rf.maintained(None, refs, here.unionByName(gone), ["key"])).select("key", "n_references")


def _edge_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").select(norm_id("dst").alias("node_id"), norm_id("src").alias("caller"))


def _caller_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "callers").select(norm_id("node_id").alias("node_id"), norm_id("changed_node_id").alias("caller"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, rows in (("edges", _edge_rows(spark, d)), ("callers", _caller_rows(spark, d))):
        total = table(spark, d, name).select(F.count(F.lit(1)).alias("_total"))
        heavy = skew.balanced_key_stats(rows, "node_id", "caller").crossJoin(F.broadcast(total)).where(F.col("n_rows") >= HEAVY_SHARE * F.col("_total"))
        part = heavy.select(F.lit(name).alias("tbl"), "node_id")
        out = part if out is None else out.unionByName(part)
    return out


def p6_key_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows and callers of each node that edges point to, with the node's name."""
    return skew.balanced_key_stats(_edge_rows(spark, d), "node_id", "caller", side=_current_names(spark, d).withColumnRenamed("id", "node_id").where("node_id is not null")).select(
        "node_id", "name", "n_rows", "n_members", "n_side_rows"
    )


def p6_caller_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.balanced_key_stats(_caller_rows(spark, d), "node_id", "caller").select("node_id", "n_rows", "n_members")


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p3_found, p3_report, p3_current, p6_found, p6_key_stats, p6_caller_stats)}

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _id(c: str) -> str:
    return f"nullif(lower(trim({c}, {_WS})), '')"


_DANGLING = f"""
with arrived as (select {_id('id')} k, min(last_indexed) a from (select id, last_indexed from nodes union all select id, last_indexed from shared_nodes) group by 1),
gone as (select {_id('id')} k, min(removed_at) r from removed_nodes group by 1),
span as (select arrived.k, a, r from arrived left join gone using (k) where arrived.k is not null),
ids as (select distinct 'edges' tbl, 'dst' field, ord row_id, {_id('dst')} k, seen_at t from edges
  union all select distinct 'refs', 'src', ref_id, {_id('src')}, seen_at from refs),
named as (select n.repo, x.nm, n.last_indexed a, gone.r from nodes n left join gone on gone.k = {_id('n.id')}, lateral (select unnest([trim(n.name, {_WS}), trim(n.fqn, {_WS})]) nm) x),
lib as (select x.nm, last_indexed a from shared_nodes s, lateral (select unnest([s.name, s.fqn]) nm) x),
tn as (select distinct ref_id row_id, repo, nullif(trim(target_name, {_WS}), '') k, seen_at t from refs),
orphans as (
  select tbl, field, row_id, t from ids where k is not null and not exists (select 1 from span where span.k = ids.k and a <= t and (r is null or r > t))
  union all
  select 'refs', 'target_name', row_id, t from tn where k is not null
    and not exists (select 1 from named where named.repo = tn.repo and nm = tn.k and a <= t and (r is null or r > t))
    and not exists (select 1 from lib where lib.nm = tn.k and lib.a <= t))
"""

_KEY_STATS = "select {k} node_id, count(*) n_rows, count(distinct {m}) n_members from {t} where {k} is not null group by 1"
_CURRENT = f"(select {_id('id')} id, max_by(name, (last_indexed, ord)) name from nodes group by 1)"

ORACLES = {
    "p3_found": _DANGLING + "select tbl, field, row_id from orphans",
    "p3_report": _DANGLING + "select tbl, field, strftime(t, '%Y-%m') as month, count(*) as n_orphans from orphans group by 1, 2, 3",
    "p3_current": f"""select key, count(*) n_references from (select distinct {_id('dst')} as key, ord from edges) where key is not null
        and key not in (select {_id('id')} from nodes union select {_id('id')} from shared_nodes except select {_id('id')} from removed_nodes) group by 1""",
    "p6_found": " union all ".join(
        f"select '{t}' as tbl, {_id(c)} as node_id from {t} where {_id(c)} is not null group by 2 having count(*) >= {HEAVY_SHARE} * (select count(*) from {t})" for t, c in (("edges", "dst"), ("callers", "node_id"))
    ),
    "p6_key_stats": f"select s.node_id, n.name, s.n_rows, s.n_members, case when n.id is null then 0 else s.n_rows end n_side_rows from ({_KEY_STATS.format(k=_id('dst'), m=_id('src'), t='edges')}) s left join {_CURRENT} n on n.id = s.node_id",
    "p6_caller_stats": _KEY_STATS.format(k=_id("node_id"), m=_id("changed_node_id"), t="callers"),
}

_LINKS = f"""links as (select distinct p, c from (
  select case upper(trim(type)) when 'CONTAINS' then {_id('src')} else {_id('dst')} end p, case upper(trim(type)) when 'CONTAINS' then {_id('dst')} else {_id('src')} end c
  from edges where upper(trim(type)) in ('CONTAINS', 'BELONGS_TO')) where p is not null and c is not null)"""
ORACLES["p2_descendants"] = f"""with recursive {_LINKS},
down(anc, node, d) using key (anc, node) as (select p, c, 1 from links union select down.anc, l.c, down.d + 1 from down join links l on l.p = down.node
  where not exists (select 1 from recurring.down r where r.anc = down.anc and r.node = l.c))
select anc as ancestor_id, node as node_id, cast(d as bigint) as distance from down where anc <> node"""
# reaches[v] by recursion with a set: the pairs (v, what v reaches) of the nodes that lie on some closed walk
ORACLES["p2_found"] = f"""with recursive {_LINKS},
core as (select c node from links intersect select p from links),
inner_links as (select p, c from links where p in (select node from core) and c in (select node from core)),
multi as (select c from links group by 1 having count(*) > 1),
walk as (select c v, c anc from inner_links union select walk.v, l.p from walk join inner_links l on l.c = walk.anc),
back as (select distinct w.v from walk w join inner_links l on l.c = w.v where exists (select 1 from walk x where x.v = l.p and x.anc = w.v)),
mates as (select a.v, a.anc from walk a join walk b on a.v = b.anc and a.anc = b.v where a.v in (select v from back))
select min(anc) as cycle_id, v as node_id from mates group by v"""

ORACLES["p2_hierarchy"] = f"""with recursive {_LINKS}, nm as {_CURRENT},
one as materialized (select c, min(p) p from links group by 1),
walk as (select c v, p a from one union select walk.v, one.p from walk join one on one.c = walk.a),
cyc as materialized (select distinct v from walk where v = a),
every as (select p n from links union select c from links),
up(node, anc, d, path) as (select n, n, 0::bigint, coalesce(nm.name, n) from every left join nm on nm.id = n
  union all select up.node, one.p, d + 1, coalesce(nm.name, one.p) || '/' || path from up join one on one.c = up.anc left join nm on nm.id = one.p where up.anc not in (select v from cyc)),
tree as materialized (select node, anc root_id, d depth, path, node in (select v from cyc) on_cycle, node not in (select v from cyc) and anc in (select v from cyc) below_cycle
  from up where anc not in (select c from one) or anc in (select v from cyc))
select node as node_id, one.p as parent_id, true as primary, root_id, depth, path, on_cycle, below_cycle from tree left join one on one.c = node
union all select l.c, l.p, false, t.root_id, t.depth + 1, t.path || '/' || coalesce(nm.name, l.c), n.on_cycle, t.below_cycle or t.on_cycle
from links l join one on one.c = l.c and one.p <> l.p join tree t on t.node = l.p join tree n on n.node = l.c left join nm on nm.id = l.c"""
