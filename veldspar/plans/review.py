"""Changes under review: what they touch, who depends on it, and what is said about it.

The changed lines are those of ``chunks.added_lines``; a definition is changed
if it is the innermost one around such a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions import text as tx
from veldspar.functions.keys import norm_id, trimmed
from veldspar.operators import graph, impact
from veldspar.operators.ranking import cascade
from veldspar.plans.graphs import calls, current_nodes, sql_calls, sql_id, sql_nodes
from veldspar.plans.register import Book
from veldspar.session import checkpointed
from veldspar.sources.tables import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

_N = lambda: F.count(F.lit(1))
_CLEAN = "regexp_replace(replace({c}, chr(92), '/'), '^(\\./|/)+', '')"
_NODES = sql_nodes("repo", "label", "name", "fqn", "file", "start_line", "end_line", "is_test", "route", "component_role", "signature", "docstring", "lang")
_ND = f"{_NODES}, nd as materialized (select * replace ({_CLEAN.format(c='file')} as file) from cur)"
_CHG = f"""{_ND}, ln as (select distinct repo, file_path f, unnest(added_lines) l from chunks),
inner_most as (select ln.repo, f, l, arg_min(id, (end_line - start_line, id)) id, arg_min(start_line, (end_line - start_line, id)) s from ln join nd on nd.repo = ln.repo and nd.file = f and l between start_line and end_line and label in ('Function', 'Class') group by 1, 2, 3),
chg as materialized (select id, min(repo) repo, case when max((l <= s + 5)::int) = 1 then 'signature' else 'behavior' end change_type, count(distinct l) n_lines from inner_most group by 1)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    n = current_nodes(spark, d, "repo", "label", "name", "fqn", "file", "start_line", "end_line", "is_test", "route", "component_role", "signature", "docstring", "lang")
    return n.withColumn("file", tx.clean_path(F.col("file")))


def changed(spark: SparkSession, d: str) -> DataFrame:
    """(id, repo, change_type, n_lines): the innermost definitions around changed lines.

    A line up to five below the start changes the signature.
    """
    lines = table(spark, d, "chunks").select("repo", F.col("file_path").alias("file"), F.explode("added_lines").alias("l")).distinct()
    n = nodes(spark, d).where("label in ('Function', 'Class')").select("id", "repo", "file", "start_line", "end_line")
    hit = lines.join(n, ["repo", "file"]).where("l between start_line and end_line")
    inner = hit.groupBy("repo", "file", "l").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "id", F.col("start_line").alias("s"))).alias("x"))
    return checkpointed(inner.groupBy(F.col("x.id").alias("id")).agg(F.min("repo").alias("repo"), F.when(F.max((F.col("l") <= F.col("x.s") + 5).cast("int")) == 1, "signature").otherwise("behavior").alias("change_type"), F.count_distinct("l").alias("n_lines")))


@query(f"with {_CHG} select id as node_id, change_type, n_lines from chg")
def o_changes(spark, d):
    """Definitions that the changed lines lie in, and how they change."""
    return changed(spark, d).select(F.col("id").alias("node_id"), "change_type", "n_lines")


@query("select distinct repo, file_path as path from chunks where len(added_lines) > 0")
def diff_changed_files(spark, d):
    """Files with added lines."""
    return table(spark, d, "chunks").where("size(added_lines) > 0").select("repo", F.col("file_path").alias("path")).distinct()


@query(f"with {_CHG}, {sql_calls()}, c as (select chg.id as changed, a.id as caller from chg join nd b on b.id = chg.id join calls on calls.dst = chg.id join nd a on a.id = calls.src where chg.change_type = 'signature' and a.file is distinct from b.file and a.id not in (select id from chg)) select changed, caller, rank from (select *, row_number() over (partition by changed order by caller) rank from c) where rank <= 12")
def j_external_callers(spark, d):
    """Callers from other files, not changed themselves, of what changed its signature; twelve each."""
    c, n = changed(spark, d), nodes(spark, d).select("id", "file")
    e = graph.pairs(calls(spark, d)).join(c.where("change_type = 'signature'").select(F.col("id").alias("dst")), "dst")
    e = e.join(c.select(F.col("id").alias("src")), "src", "left_anti")
    far = e.join(n.withColumnsRenamed({"id": "src", "file": "fs"}), "src").join(n.withColumnsRenamed({"id": "dst", "file": "fd"}), "dst").where("not (fs <=> fd)")
    return far.select(F.col("dst").alias("changed"), F.col("src").alias("caller")).withColumn("rank", F.row_number().over(W.partitionBy("changed").orderBy("caller"))).where("rank <= 12")


@query(f"with recursive {_CHG}, {sql_calls()}, w(origin, node, d) as (select id, id, 0 from chg union select origin, calls.src, d + 1 from w join calls on calls.dst = w.node where d < 3), a as (select distinct origin, nd.id from w join nd on nd.id = w.node where d > 0 and nd.is_test and nd.id <> origin), b as (select chg.id origin, t.id from chg join nd f on f.id = chg.id join nd t on t.repo = f.repo and t.is_test and t.label = 'Function' and contains('_' || t.name || '_', '_' || f.name || '_') where length(f.name) >= 4 and t.id <> f.id) select origin as changed, id as test from a union select * from b")
def j_covering_tests(spark, d):
    """Tests that reach a changed definition within three calls, or bear its name between underscores."""
    c, n = changed(spark, d), checkpointed(nodes(spark, d).select("id", "repo", "label", "name", "is_test"))
    tests = n.where("is_test")
    near = graph.distances(calls(spark, d), c.select(F.col("id").alias("origin")), 3, reverse=True).where("hops > 0 and node <> origin")
    a = near.join(tests.select(F.col("id").alias("node")), "node").select(F.col("origin").alias("changed"), F.col("node").alias("test"))
    # every run of a test's name parts is a key, so the names meet in an equi-join
    parts = F.split("name", "_")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.transform(F.sequence(i, F.size("p")), lambda j: F.array_join(F.slice(F.col("p"), i, j - i + 1), "_"))))
    by_name = tests.where("label = 'Function' and name <> ''").select("repo", F.col("id").alias("test"), parts.alias("p")).select("repo", "test", F.explode(F.array_distinct(runs)).alias("name"))
    b = c.select("id").join(n.select("id", "repo", "name"), "id").where("length(name) >= 4").select(F.col("id").alias("changed"), "repo", "name").join(by_name, ["repo", "name"]).where("test <> changed").select("changed", "test")
    return a.unionByName(b).distinct()


_REL = "('CALLS', 'INSTANTIATES', 'EXTENDS', 'REFERENCES', 'USES')"


@query(f"with {_CHG}, e as (select distinct ord, {sql_id('src')} s, {sql_id('dst')} t, upper(trim(type)) rel, confidence, evidence_file, evidence_line from edges where upper(trim(type)) in {_REL}) select chg.id as changed, nd.id as caller, rel as relation, coalesce(nullif(evidence_file, ''), nd.file) as file, coalesce(nullif(evidence_line, 0), nd.start_line) as line from chg join e on e.t = chg.id join nd on nd.id = e.s where lower(coalesce(confidence, '')) <> 'ambiguous'")
def j_evidence(spark, d):
    """Where each caller of a changed definition says so: the edge's line, else the caller's start."""
    e = table(spark, d, "edges").where(F.upper(trimmed("type")).isin("CALLS", "INSTANTIATES", "EXTENDS", "REFERENCES", "USES") & (F.lower(F.coalesce("confidence", F.lit(""))) != "ambiguous"))
    e = e.select("ord", norm_id("src").alias("src"), norm_id("dst").alias("changed"), F.upper(trimmed("type")).alias("relation"), "evidence_file", "evidence_line").distinct()
    n = nodes(spark, d).select(F.col("id").alias("src"), F.col("file").alias("nf"), "start_line")
    j = e.join(changed(spark, d).select(F.col("id").alias("changed")), "changed").join(n, "src")
    return j.select("changed", F.col("src").alias("caller"), "relation", F.coalesce(F.nullif("evidence_file", F.lit("")), "nf").alias("file"), F.coalesce(F.nullif("evidence_line", F.lit(0)), "start_line").alias("line"))


_DEP = f"dep as materialized (select distinct changed_qualname q, {sql_id('node_id')} id, {_CLEAN.format(c='file')} file from callers where node_id is not null)"
_FND = "fnd as materialized (select distinct ord, repo, trim(owning_fqn) q, " + _CLEAN.format(c="file") + " file, line from findings where owning_fqn is not null)"


@query(f"with {_ND}, {_DEP}, {_FND}, c as (select fnd.ord, dep.id, case when dep.file = fnd.file and fnd.line between nd.start_line and nd.end_line then 0 when dep.file = fnd.file and count(*) filter (dep.file = fnd.file) over (partition by ord) = 1 then 1 when count(*) over (partition by ord) = 1 then 2 end r from fnd join dep using (q) left join nd on nd.id = dep.id), b as (select *, min(r) over (partition by ord) m from c where r is not null) select ord, min(id) as dependent, ['span', 'file', 'only'][min(r) + 1] as how from b where r = m group by 1")
def j_choose_dependent(spark, d):
    """The dependent that a finding is about: by its span, the only one of the file, or the only one."""
    dep = table(spark, d, "callers").where("node_id is not null").select(F.col("changed_qualname").alias("q"), norm_id("node_id").alias("id"), tx.clean_path(F.col("file")).alias("dfile")).distinct()
    f = table(spark, d, "findings").where("owning_fqn is not null").select("ord", "repo", F.trim("owning_fqn").alias("q"), tx.clean_path(F.col("file")).alias("ffile"), "line").distinct()
    n = nodes(spark, d).select("id", "start_line", "end_line")
    same = F.coalesce(F.col("dfile") == F.col("ffile"), F.lit(False))
    w = W.partitionBy("ord")
    c = f.join(dep, "q").join(n, "id", "left").withColumn("_same", F.sum(same.cast("int")).over(w)).withColumn("_all", _N().over(w))
    best = cascade(c, ["ord"], [("span", same & F.col("line").between(F.col("start_line"), F.col("end_line"))), ("file", same & (F.col("_same") == 1)), ("only", F.col("_all") == 1)])
    return best.groupBy("ord").agg(F.min("id").alias("dependent"), F.min("strategy").alias("how"))


_W = "case upper(trim(type)) when 'CALLS' then 1.0 when 'EXTENDS' then 0.9 when 'INSTANTIATES' then 0.8 else 0.4 end"
_S = "case confidence when 'EXTRACTED' then 1.0 when 'INFERRED' then 0.6 when 'AMBIGUOUS' then 0.2 else 0.6 end"


def _level(a: str, seen: str) -> str:
    key = "(-struct_extract_at(k, 1), -struct_extract_at(k, 2), t)"
    return f"(select s n, arg_min(t, {key}) p, arg_min({a}.o, {key}) o from e join {a} on t = {a}.n where s not in (select n from {seen}) group by 1)"


_IMPACT = f"""with recursive {_CHG}, e as materialized (select {sql_id('src')} s, {sql_id('dst')} t, max(({_S}, {_W})) k from edges where upper(trim(type)) in ('CALLS', 'EXTENDS', 'INSTANTIATES', 'IMPORTS') group by 1, 2 having s is not null and t is not null and s <> t),
l0 as materialized (select id n, null::varchar p, id o from chg), l1 as materialized {_level('l0', 'l0')}, s1 as materialized (select n from l0 union all select n from l1), l2 as materialized {_level('l1', 's1')}, s2 as materialized (select n from s1 union all select n from l2), l3 as materialized {_level('l2', 's2')},
tr as (select n, o, 1 d from l1 union all select n, o, 2 from l2 union all select n, o, 3 from l3),
ch as materialized (select tr.n node, tr.o origin, d, case when chg.change_type = 'signature' then 3.0 else 1.0 end + greatest(0.0, 3.0 - d) + least(3.0, d * 0.5) + case when regexp_matches(lower(nd.name), 'auth|token|session') then 2.0 else 0.0 end + case when nd.route is not null then 3.0 else 0.0 end - case when nd.is_test then 2.0 else 0.0 end score, coalesce(nd.route is not null, false) entry
  from tr join chg on chg.id = tr.o left join nd on nd.id = tr.n),
link as materialized (select distinct {sql_id('src')} a, {sql_id('dst')} b from edges where upper(trim(type)) in ('CALLS', 'INSTANTIATES', 'EXTENDS', 'OVERRIDES') and {sql_id('src')} in (select id from chg) and {sql_id('dst')} in (select id from chg)),
sym as (select a, b from link union select b, a from link), cc(x, c) as (select id, id from chg union select sym.b, cc.c from cc join sym on sym.a = cc.x), cl as materialized (select x id, min(c) cluster from cc group by 1),
sz as (select cluster, count(*) n_changed from cl group by 1), bc as (select cluster, count(*) n_consumers, max(score) best, max(entry::int) entry from ch join cl on cl.id = ch.origin group by 1)"""
_BAND = "case when coalesce(best, -1) >= 7 then 'high' when coalesce(entry, 0) = 1 or coalesce(best, -1) >= 4 then 'medium' else 'low' end"


def chains(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, origin, node, depth, score, entry): consumers of changes, with the cluster of the change."""
    c = changed(spark, d)
    e = table(spark, d, "edges").withColumn("type", F.upper(trimmed("type"))).withColumn("src", norm_id("src")).withColumn("dst", norm_id("dst"))
    x = F.col("confidence")
    step = e.where(F.col("type").isin(*impact.WEIGHTS)).select("type", "src", "dst", F.when(x == "EXTRACTED", 1.0).when(x == "INFERRED", 0.6).when(x == "AMBIGUOUS", 0.2).otherwise(0.6).alias("score"))
    tree = impact.impact_tree(step, c.select(F.col("id").alias("node")), 3).where("depth > 0").select("node", "origin", "depth")
    n = nodes(spark, d).select(F.col("id").alias("node"), "name", "route", "is_test")
    kind = c.select(F.col("id").alias("origin"), "change_type")
    score = impact.chain_score(F.col("change_type"), F.col("depth"), F.lower("name").rlike("auth|token|session"), F.col("route").isNotNull(), F.col("is_test"), F.lit(False), F.lit(False))
    scored = tree.join(kind, "origin").join(n, "node", "left").select("origin", "node", "depth", score.alias("score"), F.coalesce(F.col("route").isNotNull(), F.lit(False)).alias("entry"))
    return scored.join(clusters(spark, d, c).select(F.col("node").alias("origin"), "cluster"), "origin")


def clusters(spark: SparkSession, d: str, c: DataFrame) -> DataFrame:
    """(node, cluster): changed definitions that call, make, extend or override each other."""
    ids = c.select(F.col("id").alias("node"))
    e = calls(spark, d, "CALLS", "INSTANTIATES", "EXTENDS", "OVERRIDES").join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return checkpointed(graph.components(e, ids).withColumnRenamed("component", "cluster"))


@query(_IMPACT + " select cluster, origin, node, score, rank, n_consumers - least(n_consumers, 15) as n_rest from (select cl.cluster, ch.*, row_number() over (partition by cl.cluster order by score desc, node) rank, count(*) over (partition by cl.cluster) n_consumers from ch join cl on cl.id = ch.origin) where rank <= 15")
def g_impact(spark, d):
    """The fifteen best chains of each cluster of changes, and how many more there are."""
    w = W.partitionBy("cluster")
    ranked = chains(spark, d).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "node"))).withColumn("n", _N().over(w)).where("rank <= 15")
    return ranked.select("cluster", "origin", "node", "score", "rank", F.greatest(F.col("n") - 15, F.lit(0)).alias("n_rest"))


def _bands(spark: SparkSession, d: str) -> DataFrame:
    c = changed(spark, d)
    size = clusters(spark, d, c).groupBy("cluster").agg(_N().alias("n_changed"))
    best = chains(spark, d).groupBy("cluster").agg(_N().alias("n_consumers"), F.max("score").alias("best"), F.bool_or("entry").alias("entry"))
    score, entry = F.coalesce("best", F.lit(-1.0)), F.coalesce("entry", F.lit(False))
    band = F.when(score >= 7, "high").when(entry | (score >= 4), "medium").otherwise("low")
    return size.join(best, "cluster", "left").select("cluster", "n_changed", F.coalesce("n_consumers", F.lit(0)).alias("n_consumers"), score.alias("best"), band.alias("risk"))


@query(_IMPACT + f" select sz.cluster, n_changed, coalesce(n_consumers, 0) as n_consumers, {_BAND} as risk from sz left join bc using (cluster)")
def a_cluster_risk(spark, d):
    """How grave a cluster is, by its best chain and whether it reaches an entry point."""
    return _bands(spark, d).select("cluster", "n_changed", "n_consumers", "risk")


@query(_IMPACT + " select sz.cluster, coalesce(best, -1.0) as best, row_number() over (order by coalesce(best, -1.0) desc, sz.cluster) as pos from sz left join bc using (cluster)")
def o_clusters(spark, d):
    """Clusters by their best chain, those without any last."""
    from veldspar.operators.ranking import numbered_in_order

    return numbered_in_order(_bands(spark, d).select("cluster", "best"), [F.desc("best"), F.col("cluster")])


@query(f"with recursive {_CHG}, {sql_calls()}, w(origin, node, d) as (select id, id, 0 from chg union select origin, calls.src, d + 1 from w join calls on calls.dst = w.node where d < 2) select w.origin as changed, string_agg(distinct nd.file, ',' order by nd.file) as files, count(distinct w.node) as n_dependents from w join nd on nd.id = w.node where w.node <> w.origin and nd.file is not null group by 1")
def g_file_chains(spark, d):
    """Files of the dependents of each changed definition within two calls."""
    near = graph.distances(calls(spark, d), changed(spark, d).select(F.col("id").alias("origin")), 2, reverse=True).where("node <> origin")
    j = near.join(nodes(spark, d).where("file is not null").select(F.col("id").alias("node"), "file"), "node")
    return j.groupBy(F.col("origin").alias("changed")).agg(F.array_join(F.sort_array(F.collect_set("file")), ",").alias("files"), F.count_distinct("node").alias("n_dependents"))


# findings

_REC = "rec as materialized (select distinct ord, repo, trim(owning_fqn) q, subcategory, source, file, line, title, message, category, provenance, confidence from findings)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").select("ord", "repo", F.trim("owning_fqn").alias("q"), "subcategory", "source", "file", "line", "title", "message", "category", "provenance", "confidence").distinct()


_INJECTION = ("sql_injection", "command_injection")


@query(f"with {_REC}, p as (select distinct q, subcategory from rec where source = 'graph_proven' and subcategory in {_INJECTION} and q is not null) select ord from rec where not (coalesce(source, '') <> 'graph_proven' and subcategory in {_INJECTION} and exists (select 1 from p where p.q = rec.q and p.subcategory = rec.subcategory)) or subcategory is null")
def u_cross_category(spark, d):
    """Findings but those that a proven one of the same function and class of injection makes superfluous."""
    r = _records(spark, d)
    proven = r.where((F.col("source") == "graph_proven") & F.col("subcategory").isin(*_INJECTION)).select("q", "subcategory").distinct()
    weak = (F.coalesce("source", F.lit("")) != "graph_proven") & F.col("subcategory").isin(*_INJECTION)
    return r.where(~F.coalesce(weak, F.lit(False))).select("ord").unionByName(r.where(weak).join(proven, ["q", "subcategory"], "left_anti").select("ord"))


_NORM = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


@query(f"with {_REC}, v as (select {_NORM.format(c='title')} t, file, line from rec where upper(confidence) = 'HIGH') select ord from rec where {_NORM.format(c='title')} in (select t from v where t is not null) or exists (select 1 from v where v.file = rec.file and v.line = rec.line) or (select count(*) from v) = 0")
def u_verified(spark, d):
    """Findings whose title or place the confident ones bear out; all of them if there is none."""
    r = _records(spark, d).withColumn("t", F.trim(F.regexp_replace(F.lower("title"), r"\s+", " ")))
    v = checkpointed(r.where(F.upper("confidence") == "HIGH").select("t", "file", "line").distinct())
    if v.isEmpty():
        return r.select("ord")
    by_title = r.join(v.where("t is not null").select("t").distinct(), "t", "left_semi").select("ord")
    return by_title.unionByName(r.join(v.select("file", "line").distinct(), ["file", "line"], "left_semi").select("ord")).distinct()


@query("select distinct f.ord from findings f join (select distinct repo, file_path p from chunks) c on c.repo = f.repo and (f.file = c.p or ends_with(f.file, '/' || c.p) or regexp_extract(replace(f.file, chr(92), '/'), '[^/]*$') = regexp_extract(c.p, '[^/]*$'))")
def p_in_file(spark, d):
    """Findings in a reviewed file, by its path's end or its base name."""
    base = lambda c: F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/"), -1)
    # a path's end implies the same base name, so the base name alone is the key
    c = table(spark, d, "chunks").where("file_path is not null").select("repo", base(F.col("file_path")).alias("base")).distinct()
    return table(spark, d, "findings").where("file is not null").select("ord", "repo", base(F.col("file")).alias("base")).join(c, ["repo", "base"], "left_semi").select("ord").distinct()


@query(f"with {_ND}, f as (select distinct owning_fqn q, regexp_extract(owning_fqn, '[^.#]*$') field from findings where owning_fqn is not null), c as (select distinct node_id, changed_qualname, source from callers where source is not null) select c.node_id, c.changed_qualname, regexp_matches(source, '\\b' || regexp_extract(changed_qualname, '[A-Za-z0-9_]*$') || '\\b') or contains(source, '.' || regexp_extract(changed_qualname, '[A-Za-z0-9_]*$')) as refers from c where regexp_extract(changed_qualname, '[A-Za-z0-9_]*$') <> ''")
def p_field_refs(spark, d):
    """Whether a caller's line names what was changed, as a word or behind a dot."""
    c = table(spark, d, "callers").where("source is not null").select("node_id", "changed_qualname", "source").distinct().withColumn("f", F.regexp_extract("changed_qualname", r"[A-Za-z0-9_]*$", 0)).where("f <> ''")
    word = F.expr(r"regexp_like(source, concat('\\b\\Q', f, '\\E\\b'))")
    return c.select("node_id", "changed_qualname", (word | F.col("source").contains(F.concat(F.lit("."), F.col("f")))).alias("refers"))


@query(f"with {sql_nodes('label', 'kind', 'name', 'fqn', 'modifiers')} select id, case when label = 'Class' and regexp_matches(coalesce(fqn, ''), '(Model|Table|Entity)$') then 'table' when label = 'Class' and regexp_matches(name, '(Service|Repository|Component)$') then 'service' when label = 'Class' then 'class' when label = 'Function' and regexp_matches(name, '^(on|handle)_') then 'event' when label = 'Function' and kind = 'method' then 'method' when label = 'Function' then 'function' else lower(label) end as rule_kind from cur")
def p_kind_rules(spark, d):
    """Kinds by name: tables, services, event handlers, methods."""
    n = current_nodes(spark, d, "label", "kind", "name", "fqn")
    cls, fn = F.col("label") == "Class", F.col("label") == "Function"
    kind = (
        F.when(cls & F.coalesce("fqn", F.lit("")).rlike("(Model|Table|Entity)$"), "table").when(cls & F.col("name").rlike("(Service|Repository|Component)$"), "service").when(cls, "class")
        .when(fn & F.col("name").rlike("^(on|handle)_"), "event").when(fn & (F.col("kind") == "method"), "method").when(fn, "function").otherwise(F.lower("label"))
    )
    return n.select("id", kind.alias("rule_kind"))


@query(f"with {sql_nodes('name', 'fan_in', 'loc')} select id, name, round(coalesce(fan_in * 1.0, loc * 1.0, 0.0) / 60.0, 4) as score from cur")
def p_brief(spark, d):
    """A row's score for a trace: the first that it has, rounded."""
    n = current_nodes(spark, d, "name", "fan_in", "loc")
    return n.select("id", "name", F.round(F.coalesce(F.col("fan_in") * 1.0, F.col("loc") * 1.0, F.lit(0.0)) / 60.0, 4).alias("score"))


@query(f"with {sql_nodes('lang')}, e as (select distinct ord, upper(trim(type)) ty, {sql_id('src')} s, extractor from edges), x as (select distinct ty, lang from e join cur on cur.id = e.s where extractor = 'scip' and ty in ('CALLS', 'OVERRIDES')) select e.ord from e left join cur on cur.id = e.s where not (coalesce(extractor, '') <> 'scip' and exists (select 1 from x where x.ty = e.ty and x.lang = cur.lang))")
def p_swap_out(spark, d):
    """Edges, without the guessed ones of a type and language for which there is a precise index."""
    n = current_nodes(spark, d, "lang").select(F.col("id").alias("s"), "lang")
    e = table(spark, d, "edges").select("ord", F.upper(trimmed("type")).alias("ty"), norm_id("src").alias("s"), "extractor").distinct().join(n, "s", "left")
    exact = F.coalesce(F.col("extractor") == "scip", F.lit(False))
    x = e.where(exact & F.col("ty").isin("CALLS", "OVERRIDES") & F.col("lang").isNotNull()).select("ty", "lang").distinct()
    return e.where(exact).select("ord").unionByName(e.where(~exact).join(x, ["ty", "lang"], "left_anti").select("ord"))


@query(f"with {_FND}, ex as (select f.ord, f.repo, f.file, f.line, f.line + 3 hi from fnd f join (select distinct ord from findings where source = 'graph_proven') g using (ord)), ac as (select f.* from fnd f join (select distinct ord from findings where source = 'llm_judged') g using (ord)), m as (select ex.ord e, ac.ord a, row_number() over (partition by ex.ord order by abs(ac.line - ex.line), ac.ord) r from ex join ac on ac.repo = ex.repo and ac.file = ex.file and ac.line between ex.line - 3 and ex.line + 3) select ex.ord as expected, m.a as matched from ex left join m on m.e = ex.ord and r = 1")
def j_eval_match(spark, d):
    """Proven findings as expectations, with the nearest judged finding within three lines."""
    f = table(spark, d, "findings").where("owning_fqn is not null").select("ord", "repo", tx.clean_path(F.col("file")).alias("file"), "line", "source").distinct()
    ex = f.where("source = 'graph_proven'").select(F.col("ord").alias("expected"), "repo", "file", F.col("line").alias("at"))
    ac = f.where("source = 'llm_judged'").select(F.col("ord").alias("a"), "repo", "file", "line")
    # lines in bands of four: a match lies in the same band or the next one to either side
    near = ex.withColumn("band", F.explode(F.array(F.expr("at div 4 - 1"), F.expr("at div 4"), F.expr("at div 4 + 1")))).join(ac.withColumn("band", F.expr("line div 4")), ["repo", "file", "band"]).where("line between at - 3 and at + 3")
    best = near.groupBy("expected").agg(F.min(F.struct(F.abs(F.col("line") - F.col("at")).alias("x"), "a"))["a"].alias("matched"))
    return ex.select("expected").join(best, "expected", "left")


@query(f"with {_FND}, c as (select distinct changed_qualname q, node_id, {_CLEAN.format(c='file')} file, line, broken from callers) select q, node_id, file, line from c where coalesce(broken, false) and not exists (select 1 from fnd where fnd.q = c.q and fnd.file = c.file)")
def u_synthesize(spark, d):
    """Broken calls that no finding on the changed function covers in their file."""
    c = table(spark, d, "callers").where("broken").select(F.col("changed_qualname").alias("q"), "node_id", tx.clean_path(F.col("file")).alias("file"), "line").distinct()
    f = table(spark, d, "findings").where("owning_fqn is not null").select(F.trim("owning_fqn").alias("q"), tx.clean_path(F.col("file")).alias("file")).distinct()
    return c.join(f, ["q", "file"], "left_anti").select("q", "node_id", "file", "line")


@query(f"with recursive {_ND}, {sql_calls()}, own as (select distinct f.ord, nd.id from findings f join nd on nd.repo = f.repo and nd.fqn = trim(f.owning_fqn)), st as (select distinct id from own), w(origin, node, d) as (select id, id, 0 from st union select origin, calls.src, d + 1 from w join calls on calls.dst = w.node where d < 2), b as (select origin, count(distinct node) - 1 n, max((nd.component_role = 'endpoint_handler')::int) ep from w left join nd on nd.id = w.node group by 1) select own.ord, own.id as node_id, b.n as blast_count, coalesce(b.ep, 0) = 1 as endpoint_reachable from own join b on b.origin = own.id")
def a_score(spark, d):
    """Findings with the callers of their function within two calls, and whether an endpoint is among them."""
    n = checkpointed(nodes(spark, d).select("id", "repo", "fqn", "component_role"))
    own = checkpointed(table(spark, d, "findings").select("ord", "repo", F.trim("owning_fqn").alias("fqn")).distinct().join(n.select("repo", "fqn", "id"), ["repo", "fqn"]).select("ord", "id").distinct())
    far = graph.distances(calls(spark, d), own.select(F.col("id").alias("origin")).distinct(), 2, reverse=True)
    b = far.join(n.select(F.col("id").alias("node"), "component_role"), "node", "left").groupBy(F.col("origin").alias("id")).agg((_N() - 1).alias("blast_count"), F.coalesce(F.bool_or(F.col("component_role") == "endpoint_handler"), F.lit(False)).alias("endpoint_reachable"))
    return own.join(b, "id").select("ord", F.col("id").alias("node_id"), "blast_count", "endpoint_reachable")
