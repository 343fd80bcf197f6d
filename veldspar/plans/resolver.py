"""The resolver's cascades over nodes, edges and refs, and links between languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import text as tx
from veldspar.functions.keys import norm_id, trimmed
from veldspar.operators import resolve
from veldspar.plans.graphs import calls, current_nodes, sql_calls, sql_id, sql_nodes
from veldspar.plans.register import Book
from veldspar.session import checkpointed
from veldspar.sources.tables import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    n = current_nodes(spark, d, "repo", "label", "name", "fqn", "file", "package", "kind", "param_count")
    return checkpointed(n.withColumn("file", tx.clean_path(F.col("file"))))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent): the least node that contains or defines another."""
    e = calls(spark, d, "CONTAINS", "DEFINES").where("src is not null and dst is not null")
    return checkpointed(e.groupBy(F.col("dst").alias("child")).agg(F.min("src").alias("parent")))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "refs").select("ref_id", F.upper(trimmed("type")).alias("type"), "repo", norm_id("src").alias("src"), trimmed("target_name").alias("target"), "recv", "recv_type", "import_fqn", "kind_hint", tx.clean_path(F.col("ref_file")).alias("ref_file"), "call_arity")
    return checkpointed(r.distinct())


_CLEAN = "regexp_replace(replace({c}, chr(92), '/'), '^(\\./|/)+', '')"
_BASE = f"""{sql_nodes('repo', 'label', 'name', 'fqn', 'file', 'package', 'kind', 'param_count')},
nd as materialized (select * replace ({_CLEAN.format(c='file')} as file) from cur),
par as materialized (select c, min(p) p from (select {sql_id('dst')} c, {sql_id('src')} p from edges where upper(trim(type)) in ('CONTAINS', 'DEFINES')) where c is not null and p is not null group by 1),
rf as materialized (select distinct ref_id, upper(trim(type)) as type, repo, {sql_id('src')} src, nullif(trim(target_name, {_WS}), '') target, recv, recv_type, import_fqn, kind_hint, {_CLEAN.format(c='ref_file')} ref_file, call_arity from refs),
sc as materialized (select repo, ref_file f, list(distinct import_fqn) filter (import_fqn is not null and coalesce(kind_hint, '') <> 'import_wildcard') fqns, list(distinct regexp_extract(target, '[^.#]*$')) filter (target is not null and coalesce(kind_hint, '') <> 'import_wildcard') simples,
  list(distinct import_fqn) filter (import_fqn is not null and kind_hint = 'import_wildcard') wilds from rf where type = 'IMPORTS' and ref_file is not null group by 1, 2),
pk as (select repo, file, max(package) package from nd where label = 'File' and file is not null group by 1, 2),
sr as materialized (select rf.*, s.file src_file, par.p src_parent, pk.package src_package, fqns, simples, wilds from rf left join nd s on s.id = rf.src left join par on par.c = rf.src left join pk on pk.repo = rf.repo and pk.file = s.file left join sc on sc.repo = rf.repo and sc.f = s.file)"""
_OWNER = "case when ends_with({a}fqn, '.' || {a}name) then left({a}fqn, length({a}fqn) - length({a}name) - 1) else '' end"
_HIT = "len(list_filter(fqns, lambda x: {a}fqn = x or starts_with({a}fqn, x || '.') or ends_with({a}fqn, '.' || x))) > 0"
_VISIBLE = f"""case when count(*) over (partition by ref_id) = 1 then 0 when k.file = src_file then 1 when list_contains(fqns, k.fqn) then 2 when {_HIT.format(a='k.')} then 3
  when src_package <> '' and {_OWNER.format(a='k.')} = src_package then 4 when list_contains(wilds, {_OWNER.format(a='k.')}) then 5 when list_contains(simples, k.name) then 6 else 7 end"""
_TYPE_NAMES = "['unique', 'same_file', 'imports_qualified_exact', 'imports_qualified', 'same_package', 'imports_wildcard', 'imports', 'name']"


@query(f"with {_BASE}, c as (select ref_id, k.id, {_VISIBLE} r from sr join nd k on k.repo = sr.repo and k.label = 'Class' and k.name = regexp_extract(sr.target, '[^.#]*$') where sr.type in ('OF_TYPE', 'EXTENDS', 'IMPLEMENTS', 'INSTANTIATES', 'AUTOWIRED')), b as (select *, min(r) over (partition by ref_id) m from c) select ref_id, id, {_TYPE_NAMES}[r + 1] as strategy, count(*) over (partition by ref_id) as n_candidates from b where r = m")
def j_type_cascade(spark, d):
    """References to types with the classes that their source sees first."""
    return resolve.resolved_types(_refs(spark, d), _nodes(spark, d), _parents(spark, d), ("OF_TYPE", "EXTENDS", "IMPLEMENTS", "INSTANTIATES", "AUTOWIRED"))


def _sql_recv(c: str, name: str) -> str:
    return f"{name} as materialized (select distinct ref_id, cls from (select ref_id, cls, r, min(r) over (partition by ref_id) m from (select ref_id, k.id cls, {_VISIBLE} r from sr join nd k on k.repo = sr.repo and k.label = 'Class' and k.name = sr.{c} where sr.type = 'CALLS' and sr.target is not null and {c} not in ('self', 'cls', ''))) where r = m)"


_CALLS = f"""with recursive {_BASE},
fp as materialized (select c, p from par where c in (select id from nd where label = 'Function')), climb(n, a, path) as (select c, p, [c] from fp union all select n, fp.p, list_append(path, a) from climb join fp on fp.c = a where not list_contains(path, fp.p)),
own as materialized (select n, a from climb where a in (select id from nd where label = 'Class')),
{_sql_recv('recv_type', 'typed')}, {_sql_recv('recv', 'called')},
df as materialized (select nd.*, par.p parent from nd left join par on par.c = nd.id where label in ('Function', 'Class')),
p0 as (select sr.*, df.id, df.label, df.name, df.fqn, df.file, df.kind, df.param_count, df.parent from sr join df on df.repo = sr.repo and (df.name = sr.target or df.fqn = sr.target) where sr.type = 'CALLS' and sr.target is not null),
p1 as (select *, max((label = 'Function')::int) over (partition by ref_id) fn from p0),
p2 as (select p1.*, t.cls is not null typed, o.a is not null own, m.cls is not null called from p1 left join typed t on t.ref_id = p1.ref_id and t.cls = parent left join own o on o.n = p1.src and o.a = parent and recv in ('self', 'cls') left join called m on m.ref_id = p1.ref_id and m.cls = parent where fn = 0 or label = 'Function'),
c as (select ref_id, id, call_arity, param_count, case when parent = src_parent then 0 when file = src_file then 1 when list_contains(fqns, {_OWNER.format(a='')}) then 2 when {_HIT.format(a='')} then 3 when list_contains(simples, name) then 4
  when kind = 'method' and typed then 5 when kind = 'method' and (own or called) then 6 else 7 end r from p2),
b as (select * from (select *, min(r) over (partition by ref_id) m from c) where r = m),
f as (select *, max((call_arity >= 0 and coalesce(call_arity = param_count, false))::int) over (partition by ref_id) fits from b),
g as (select *, ['same_scope', 'same_file', 'imports_qualified_exact', 'imports_qualified', 'imports', 'receiver_type_hint', 'receiver_type', 'name'][r + 1] strategy from f where coalesce(fits, 0) = 0 or (call_arity >= 0 and call_arity = param_count))"""


@query(_CALLS + " select ref_id, id, strategy, count(*) over (partition by ref_id) as n_candidates from g")
def j_call_cascade(spark, d):
    """Calls with the functions of the first rule that finds any: scope, file, imports, receiver, name, then arity."""
    return resolve.resolved_calls(_refs(spark, d), _nodes(spark, d), _parents(spark, d))


_KINDS = "case when n = 0 and not known then 'external' when n = 0 then 'unresolved' when n = 1 then 'resolved' else 'ambiguous' end"


@query(_CALLS.replace("with recursive ", "with recursive ", 1) + f""", tc as (select ref_id, id from (select *, min(r) over (partition by ref_id) m from (select ref_id, k.id, {_VISIBLE} r from sr join nd k on k.repo = sr.repo and k.label = 'Class' and k.name = regexp_extract(sr.target, '[^.#]*$') where sr.type = 'OF_TYPE')) where r = m),
ic as (select ref_id, nd.id from rf join nd on nd.repo = rf.repo and nd.label in ('File', 'Package', 'Class', 'Function') and nd.fqn = coalesce(rf.import_fqn, rf.target) where type = 'IMPORTS'),
hit as (select ref_id, id from g union all select * from tc union all select * from ic), every as (select repo, name x from nd union select repo, fqn from nd)
select type, kind, count(*) as n from (select rf.type, {_KINDS.replace('known', 'e.x is not null')} kind from (select ref_id, type, repo, target from rf where target is not null) rf left join (select ref_id, count(*) c from hit group by 1) h using (ref_id) left join every e on e.repo = rf.repo and e.x = rf.target, lateral (select coalesce(c, 0) n)) group by 1, 2""")
def j_resolve(spark, d):
    """Every reference resolved by the rule of its type: certain, ambiguous, missed or external."""
    r, n, p = _refs(spark, d), _nodes(spark, d), _parents(spark, d)
    imports = r.where("type = 'IMPORTS'").withColumn("fqn", F.coalesce("import_fqn", "target")).join(n.where("label in ('File', 'Package', 'Class', 'Function')").select("repo", "fqn", "id"), ["repo", "fqn"]).select("ref_id", "id")
    hits = resolve.resolved_calls(r, n, p).select("ref_id", "id").unionByName(resolve.resolved_types(r, n, p, ("OF_TYPE",)).select("ref_id", "id")).unionByName(imports)
    every = n.select("repo", F.explode(F.array_distinct(F.array("name", "fqn"))).alias("target")).where("target is not null").distinct().withColumn("_known", F.lit(True))
    counted = r.where("target is not null").select("ref_id", "type", "repo", "target").join(hits.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n")), "ref_id", "left").join(every, ["repo", "target"], "left")
    c = F.coalesce("n", F.lit(0))
    kind = F.when((c == 0) & F.col("_known").isNull(), "external").when(c == 0, "unresolved").when(c == 1, "resolved").otherwise("ambiguous")
    return counted.groupBy("type", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {sql_nodes('repo', 'label', 'name')}, {sql_calls('READS', 'WRITES').replace('calls as', 'rw as')}, {sql_calls('CONTAINS', 'DEFINES').replace('calls as', 'own as')}, r as (select distinct ref_id, repo, {sql_id('src')} src, regexp_extract(nullif(trim(target_name, {_WS}), ''), '[^.#]*$') name from refs), par as (select dst c, min(src) p from own group by 1), sib as (select r.ref_id, cur.id, 'enclosing' how from r join par on par.c = r.src join own on own.src = par.p and own.dst <> r.src join cur on cur.id = own.dst and cur.name = r.name), gl as (select r.ref_id, cur.id, 'repository' how from r join cur on cur.repo = r.repo and cur.name = r.name and cur.label = 'Class' where r.ref_id not in (select ref_id from sib)) select how, count(*) as n, count(distinct ref_id) as n_refs from (select * from sib union all select * from gl) group by 1")
def j_field_access(spark, d):
    """Names looked up first among what the source's own parent holds, else in the repository."""
    r = table(spark, d, "refs").select("ref_id", "repo", norm_id("src").alias("src"), tx.tail_name(trimmed("target_name")).alias("name")).distinct()
    own = calls(spark, d, "CONTAINS", "DEFINES").where("src is not null and dst is not null").distinct()
    n = current_nodes(spark, d, "repo", "label", "name")
    par = own.groupBy(F.col("dst").alias("src")).agg(F.min("src").alias("p"))
    inside = own.select(F.col("src").alias("p"), F.col("dst").alias("id")).join(n.select("id", "name"), "id")
    sib = checkpointed(r.join(par, "src").join(inside, ["p", "name"]).where("id <> src").select("ref_id", "id"))
    glob = r.join(sib.select("ref_id").distinct(), "ref_id", "left_anti").join(n.where("label = 'Class'").select("repo", "name", "id"), ["repo", "name"]).select("ref_id", "id")
    both = sib.withColumn("how", F.lit("enclosing")).unionByName(glob.withColumn("how", F.lit("repository")))
    return both.groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ref_id").alias("n_refs"))


@query(f"with {_BASE}, p as (select rf.ref_id, rf.src, nd.id, nd.file, s.file src_file, list_contains(sc.simples, nd.name) or list_contains(sc.fqns, nd.fqn) bound, len(coalesce(sc.simples, [])) > 0 and list_contains(sc.simples, regexp_extract(rf.target, '[^.#]*$')) has from rf join nd on nd.repo = rf.repo and nd.name = regexp_extract(rf.target, '[^.#]*$') and nd.label in ('Function', 'Class') left join nd s on s.id = rf.src left join sc on sc.repo = rf.repo and sc.f = s.file where rf.type = 'CALLS' and nd.id <> coalesce(rf.src, '')), q as (select *, case when file = src_file then 0 when coalesce(bound, false) then 1 when coalesce(has, false) then 9 else 2 end r from p), b as (select *, min(r) over (partition by ref_id) m from q) select src, id as dst, case when m = 2 and n > 1 then 'AMBIGUOUS' else 'EXTRACTED' end as confidence, max(n) as n_candidates from (select *, count(*) over (partition by ref_id) n from b where r = m and m < 9) group by 1, 2, 3")
def j_nx_resolve(spark, d):
    """Call edges: same file, else what the file imports, else every bearer of the name, ambiguous if several.

    A name that the file imports but that no candidate is proven to be is dropped.
    """
    from veldspar.operators.ranking import cascade

    r, n = _refs(spark, d), _nodes(spark, d)
    scope = resolve.import_scope(r)
    src = n.select(F.col("id").alias("src"), F.col("file").alias("src_file"))
    c = r.where("type = 'CALLS'").select("ref_id", "repo", "src", tx.tail_name(F.col("target")).alias("name")).join(n.where("label in ('Function', 'Class')").select("repo", "name", "id", "fqn", "file"), ["repo", "name"]).where(F.col("id") != F.coalesce("src", F.lit("")))
    c = c.join(src, "src", "left").join(scope.withColumnRenamed("f", "src_file"), ["repo", "src_file"], "left")
    named = F.array_contains("simples", F.col("name"))
    best = cascade(c, ["ref_id"], [("same_file", F.col("file") == F.col("src_file")), ("import", named | F.array_contains("fqns", F.col("fqn"))), ("name", ~F.coalesce(named, F.lit(False)))])
    sure = F.when((F.col("strategy") == "name") & (F.col("n_candidates") > 1), "AMBIGUOUS").otherwise("EXTRACTED")
    return best.groupBy("src", F.col("id").alias("dst"), sure.alias("confidence")).agg(F.max("n_candidates").alias("n_candidates"))


@query(f"with {_BASE}, p as (select rf.ref_id, rf.src, nd.id, case when nd.file = s.file then 0 else 1 end r from rf join nd on nd.repo = rf.repo and nd.name = regexp_extract(rf.target, '[^.#]*$') and nd.label in ('Function', 'Class') left join nd s on s.id = rf.src where rf.type = 'CALLS'), b as (select *, min(r) over (partition by ref_id) m from p) select src, id as dst, count(*) as n from b where r = m group by 1, 2")
def j_nx_resolve_v0(spark, d):
    """The plainer rule: bearers of the name in the same file, else all."""
    from veldspar.operators.ranking import keep_if_any

    r, n = _refs(spark, d), _nodes(spark, d)
    src = n.select(F.col("id").alias("src"), F.col("file").alias("src_file"))
    c = r.where("type = 'CALLS'").select("ref_id", "repo", "src", tx.tail_name(F.col("target")).alias("name")).join(n.where("label in ('Function', 'Class')").select("repo", "name", "id", "file"), ["repo", "name"]).join(src, "src", "left")
    return keep_if_any(c, ["ref_id"], F.col("file") == F.col("src_file")).groupBy("src", F.col("id").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {sql_nodes('name', 'repo', 'label')}, {sql_calls()}, r as (select distinct ref_id, repo, {sql_id('src')} src, regexp_extract(nullif(trim(target_name, {_WS}), ''), '[^.#]*$') name from refs where upper(trim(type)) = 'CALLS'), c as (select r.ref_id, r.src, cur.id, calls.src is not null linked from r join cur on cur.repo = r.repo and cur.name = r.name and cur.label = 'Function' left join calls on calls.src = r.src and calls.dst = cur.id), b as (select *, max(linked::int) over (partition by ref_id) anyl from c) select ref_id, id, linked from b where anyl = 0 or linked")
def j_callee_narrow(spark, d):
    """Callees of a name: those that a call edge confirms, if there is one."""
    from veldspar.operators.ranking import keep_if_any

    r = table(spark, d, "refs").where(F.upper(trimmed("type")) == "CALLS").select("ref_id", "repo", norm_id("src").alias("src"), tx.tail_name(trimmed("target_name")).alias("name")).distinct()
    n = current_nodes(spark, d, "name", "repo", "label").where("label = 'Function'").select("repo", "name", "id")
    e = calls(spark, d).where("src is not null and dst is not null").distinct().select("src", F.col("dst").alias("id"), F.lit(True).alias("linked"))
    c = r.join(n, ["repo", "name"]).join(e, ["src", "id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return keep_if_any(c, ["ref_id"], F.col("linked")).select("ref_id", "id", "linked")


@query(f"with {sql_nodes('repo', 'file', 'lang', 'name')}, own as (select repo, relpath, max_by(text, last_indexed) text from files where text is not null group by 1, 2), raw as (select distinct repo, relpath, unnest(regexp_extract_all(text, '(?i)@\\w+\\.(?:get|post|put|delete|patch)\\([\"'']([^\"'']*)', 1)) route from own), one as (select route, count(*) n, min(repo || ':' || relpath) target from raw group by 1 having count(*) = 1), cl as (select distinct repo || ':' || relpath caller, unnest(regexp_extract_all(text, '(?i)(?:fetch|axios\\.\\w+|requests\\.\\w+|http\\.\\w+)\\([\"'']([^\"'']*)', 1)) route from own) select cl.caller, one.target, cl.route from cl join one using (route) where cl.caller <> one.target and regexp_extract(cl.caller, '[^.]*$') <> regexp_extract(one.target, '[^.]*$')")
def j_cross_lang(spark, d):
    """Calls of a route from a file of another language, where exactly one file serves the route."""
    f = table(spark, d, "files").where("text is not null").groupBy("repo", "relpath").agg(F.max_by("text", "last_indexed").alias("text")).select(F.concat_ws(":", "repo", "relpath").alias("f"), "text")
    f = checkpointed(f.where("text rlike '(?i)@\\\\w+[.](get|post|put|delete|patch)[(]|(fetch|axios[.]\\\\w+|requests[.]\\\\w+|http[.]\\\\w+)[(]'"))
    routes = f.select(F.col("f").alias("target"), F.explode(F.regexp_extract_all("text", F.lit(r"(?i)@\w+\.(?:get|post|put|delete|patch)\([\"']([^\"']*)"), F.lit(1))).alias("route")).distinct()
    one = routes.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    users = f.select(F.col("f").alias("caller"), F.explode(F.regexp_extract_all("text", F.lit(r"(?i)(?:fetch|axios\.\w+|requests\.\w+|http\.\w+)\([\"']([^\"']*)"), F.lit(1))).alias("route")).distinct()
    ext = lambda c: F.element_at(F.split(c, r"\."), -1)
    return users.join(one, "route").where((F.col("caller") != F.col("target")) & (ext("caller") != ext("target"))).select("caller", "target", "route")
