"""An audit of repositories: languages, routes, secrets, roles, shapes, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions import text as tx
from veldspar.functions.keys import norm_id, trimmed
from veldspar.operators import graph
from veldspar.plans.context import _CUR
from veldspar.plans.graphs import SQL_MODULE_IMPORTS, calls, current_nodes, module_imports, sql_calls, sql_id, sql_nodes
from veldspar.plans.register import Book
from veldspar.plans.review import _CHG, _ND, changed, nodes
from veldspar.session import checkpointed
from veldspar.sources.tables import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

_N = lambda: F.count(F.lit(1))
_EXT = {"py": "python", "pyi": "python", "java": "java", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "tsx": "typescript", "go": "go"}
_SQL_LANG = "case regexp_extract(relpath, '[^.]*$') " + " ".join(f"when '{e}' then '{v}'" for e, v in _EXT.items()) + " end"


def _current(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").where("text is not null").groupBy("repo", "relpath").agg(F.max_by("text", "last_indexed").alias("t"))


def _language(path):
    ext = F.element_at(F.split(path, r"\."), -1)
    out = None
    for e, v in _EXT.items():
        out = F.when(ext == e, v) if out is None else out.when(ext == e, v)
    return out


@query(f"with {_CUR} select repo, {_SQL_LANG} as lang, count(*) as n_files, sum(len(string_split(t, chr(10)))) as n_lines from curf where {_SQL_LANG} is not null and not regexp_matches(relpath, '(^|/)(node_modules|vendor|dist|build|\\.git)/') group by 1, 2")
def src_lang_counts(spark, d):
    """Files and lines per repository and language, ignored folders aside."""
    f = _current(spark, d).withColumn("lang", _language(F.col("relpath"))).where("lang is not null and relpath not rlike '(^|/)(node_modules|vendor|dist|build|[.]git)/'")
    return f.groupBy("repo", "lang").agg(_N().alias("n_files"), F.sum(F.size(F.split("t", "\n", -1))).alias("n_lines"))


@query(f"with {_CUR}, {_ND} select nd.id, array_to_string(string_split(t, chr(10))[greatest(start_line, 1):end_line], chr(10)) as part from nd join curf on curf.repo = nd.repo and curf.relpath = nd.file where label = 'Function' and start_line > 0 and end_line >= start_line and not contains(nd.file, '..') and not starts_with(nd.file, '/')")
def src_guarded_slice(spark, d):
    """The lines of each function from its file, for paths inside the repository only."""
    n = nodes(spark, d).where("label = 'Function' and start_line > 0 and end_line >= start_line and not contains(file, '..') and not startswith(file, '/')").select("id", "repo", F.col("file").alias("relpath"), "start_line", "end_line")
    return _current(spark, d).join(n, ["repo", "relpath"]).select("id", tx.line_slice(F.col("t"), F.col("start_line"), F.col("end_line")).alias("part"))


_ROUTE = r"@\w+\.(get|post|put|delete|patch|route)\([\"''](/[^\"'']*)[\"'']"
_CLIENT = r"(?:requests|httpx|axios|http)\.(get|post|put|delete|patch)\([\"'']([^\"'']+)[\"'']"
_BOTH_TEXTS = "(select 'd' || doc_id k, text from documents where text is not null union all select repo || ':' || relpath, t from curf)"


def _all_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), "text")
    return docs.unionByName(_current(spark, d).where("repo is not null").select(F.concat_ws(":", "repo", "relpath").alias("k"), F.col("t").alias("text")))


def _sql_found(kind: str, rx: str) -> str:
    return f"select k, '{kind}' as kind, upper(unnest(regexp_extract_all(text, '{rx}', 1))) m, unnest(regexp_extract_all(text, '{rx}', 2)) route from tx"


@query(f"with {_CUR}, tx as {_BOTH_TEXTS}, f as ({_sql_found('route', _ROUTE)} union all {_sql_found('client', _CLIENT)}) select kind, case when m = 'ROUTE' then 'GET' else m end as method, route, count(*) as n, count(distinct k) as n_texts from f where k is not null group by 1, 2, 3")
def x_route_regex(spark, d):
    """Route definitions and client calls in documents and files."""
    def find(kind: str, rx: str) -> DataFrame:
        at = lambda i: F.regexp_extract_all("text", F.lit(rx.replace("''", "'")), F.lit(i))
        both = F.arrays_zip(at(1).alias("m"), at(2).alias("r"))
        return _all_texts(spark, d).select("k", F.lit(kind).alias("kind"), F.explode(both).alias("x")).select("k", "kind", F.upper("x.m").alias("m"), F.col("x.r").alias("route"))

    f = find("route", _ROUTE).unionByName(find("client", _CLIENT))
    return f.groupBy("kind", F.when(F.col("m") == "ROUTE", "GET").otherwise(F.col("m")).alias("method"), "route").agg(_N().alias("n"), F.count_distinct("k").alias("n_texts"))


# The shapes of keys that providers hand out.
_KEYS = {
    "aws": r"\b(AKIA[0-9A-Z]{16})\b", "github": r"\b(gh[pousr]_[A-Za-z0-9]{36})\b", "slack": r"\b(xox[baprs]-[A-Za-z0-9-]{10,})", "google": r"\b(AIza[0-9A-Za-z_-]{35})\b", "private_key": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)",
    "assigned": r"(?i)(?:password|passwd|secret|token|api_key|apikey)\s*[=:]\s*[\"'']([^\"''\s]{8,})[\"'']",
}
_LONG = r"\b([A-Za-z0-9+/_=-]{24,})"
_ENTROPY = "-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v) * log2(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v))))"
_SQL_KEYS = " union all ".join(f"select k, '{n}' kind, unnest(regexp_extract_all(text, '{rx}', 1)) v from tx" for n, rx in _KEYS.items())


@query(f"with {_CUR}, tx as (select * from {_BOTH_TEXTS} where k is not null), a as ({_SQL_KEYS}), b as (select distinct k, unnest(regexp_extract_all(text, '{_LONG}', 1)) v from tx), e as (select k, 'entropy' kind, v from b where regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and {_ENTROPY} > 3.8) select k as place, kind, v as value, case when regexp_matches(lower(v), 'example|sample|dummy|test|changeme') then 'low' when kind = 'entropy' then 'medium' else 'high' end as grade from (select distinct k, kind, v from a union select k, kind, v from e)")
def x_secrets(spark, d):
    """What looks like a credential: keys of providers and assignments high, long tokens of high entropy medium, samples low."""
    t = _all_texts(spark, d)
    shaped = None
    for n, rx in _KEYS.items():
        part = t.select("k", F.lit(n).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(rx.replace("''", "'")), F.lit(1))).alias("v"))
        shaped = part if shaped is None else shaped.unionByName(part)
    tokens = t.select("k", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_LONG), F.lit(1)))).alias("v")).where("v rlike '[0-9]' and v rlike '[A-Za-z]'")
    loose = tokens.where(tx.shannon_entropy(F.col("v")) > 3.8).select("k", F.lit("entropy").alias("kind"), "v")
    grade = F.when(F.lower("v").rlike("example|sample|dummy|test|changeme"), "low").when(F.col("kind") == "entropy", "medium").otherwise("high")
    return shaped.unionByName(loose).distinct().select(F.col("k").alias("place"), "kind", F.col("v").alias("value"), grade.alias("grade"))


_SKIP, _TEST = r"(^|/)(vendor|dist|build|legacy|node_modules|third_party|migrations|__pycache__)/", r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|[._-](test|spec)\.\w+$"
_DULL = r"\.(min\.js|lock|svg|map|snap|md|txt)$|(^|/)(package-lock\.json|setup\.cfg|__init__\.py)$"


@query(f"select distinct repo, relpath, regexp_matches(relpath, '{_SKIP}') as excluded, regexp_matches(relpath, '{_TEST}') as is_test, not regexp_matches(relpath, '{_SKIP}') and not regexp_matches(relpath, '{_TEST}') and not regexp_matches(relpath, '{_DULL}') as worth_review from files where relpath is not null")
def p_path_filter(spark, d):
    """Excluded folders, tests, and what is left to review."""
    r = F.col("relpath")
    return table(spark, d, "files").where("relpath is not null").select("repo", "relpath", r.rlike(_SKIP).alias("excluded"), r.rlike(_TEST).alias("is_test"), (~r.rlike(_SKIP) & ~r.rlike(_TEST) & ~r.rlike(_DULL)).alias("worth_review")).distinct()


_WORDS = {"auth": "auth|token|session|login|password|permission", "money": "billing|pricing|payment|invoice|ledger", "data": "delete|drop|migrate|export|encrypt"}


@query(f"with {_ND} " + " union all ".join(f"select id, '{k}' as vocabulary, regexp_matches(lower(coalesce(name, '')), '{w}') as by_name from nd where regexp_matches(lower(coalesce(name, '')), '{w}') or (label in ('Function', 'Class') and regexp_matches(lower(coalesce(file, '')), '(^|/)({w})(/|_|\\.)'))" for k, w in _WORDS.items()))
def p_sensitive(spark, d):
    """Nodes that three vocabularies call sensitive, by name, or by path for functions and classes."""
    n = nodes(spark, d).select("id", "label", F.lower(F.coalesce("name", F.lit(""))).alias("n"), F.lower(F.coalesce("file", F.lit(""))).alias("f"))
    out = None
    for k, w in _WORDS.items():
        part = n.where(F.col("n").rlike(w) | (F.col("label").isin("Function", "Class") & F.col("f").rlike(rf"(^|/)({w})(/|_|\.)"))).select("id", F.lit(k).alias("vocabulary"), F.col("n").rlike(w).alias("by_name"))
        out = part if out is None else out.unionByName(part)
    return out


_SUFFIX = (("Controller|Resource|Handler|View", "controller"), ("Service|Manager|Facade", "service"), ("Repository|Store|Dao|Mapper", "repository"), ("Entity|Model|Shape|Record", "entity"), ("Config|Configuration|Settings", "config"), ("Util|Utils|Helper", "util"))
_SEGMENT = (("api|web|controllers?", "controller"), ("services?|domain", "service"), ("repo|repository|store|db", "repository"), ("model|models|entity", "entity"), ("config", "config"), ("util|utils|common", "util"))
_CLASS_ROLE = "case " + " ".join(f"when regexp_matches(name, '({s})$') then '{r}'" for s, r in _SUFFIX) + " " + " ".join(f"when regexp_matches(coalesce(package, ''), '(^|\\.)({s})(\\.|$)') then '{r}'" for s, r in _SEGMENT) + " else 'component' end"
_PAR = f"par as (select {sql_id('dst')} c, min({sql_id('src')}) p from edges where upper(trim(type)) in ('CONTAINS', 'DEFINES') group by 1)"


@query(f"with {sql_nodes('label', 'name', 'package', 'route')}, {_PAR}, cl as (select id, {_CLASS_ROLE} role, case when {' or '.join(f'''regexp_matches(name, '({s})$')''' for s, _ in _SUFFIX)} then 'HIGH' else 'MEDIUM' end conf from cur where label = 'Class') select id, role, conf as confidence from cl union all select f.id, case when f.route is not null or o.role = 'controller' then 'endpoint_handler' else coalesce(o.role, 'component') end, case when f.route is not null then 'HIGH' else 'MEDIUM' end from cur f left join par on par.c = f.id left join cl o on o.id = par.p where f.label = 'Function'")
def p_roles(spark, d):
    """Roles of classes by suffix, then by package; functions take that of their class, handlers of routes stand out."""
    n = checkpointed(current_nodes(spark, d, "label", "name", "package", "route"))
    role, sure = None, F.lit(False)
    for s, r in _SUFFIX:
        hit = F.coalesce(F.col("name").rlike(f"({s})$"), F.lit(False))
        role, sure = (F.when(hit, r) if role is None else role.when(hit, r)), sure | hit
    for s, r in _SEGMENT:
        role = role.when(F.coalesce("package", F.lit("")).rlike(rf"(^|\.)({s})(\.|$)"), r)
    cls = n.where("label = 'Class'").select("id", role.otherwise("component").alias("role"), F.when(sure, "HIGH").otherwise("MEDIUM").alias("confidence"))
    par = calls(spark, d, "CONTAINS", "DEFINES").where("dst is not null").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("p"))
    fn = n.where("label = 'Function'").join(par, "id", "left").join(cls.select(F.col("id").alias("p"), "role"), "p", "left")
    routed = F.col("route").isNotNull()
    return cls.unionByName(fn.select("id", F.when(routed | F.coalesce(F.col("role") == "controller", F.lit(False)), "endpoint_handler").otherwise(F.coalesce("role", F.lit("component"))).alias("role"), F.when(routed, "HIGH").otherwise("MEDIUM").alias("confidence")))


_SHAPES = f"""{sql_nodes('repo', 'component_role', 'kind')}, {sql_calls()}, st as (select cur.id from cur where component_role = 'controller'), e as (select src, dst from calls where src <> dst),
p(path) as (select [id] from st union all select list_append(path, e.dst) from p join e on e.src = path[-1] where len(path) < 4 and not list_contains(path, e.dst)),
q as materialized (select row_number() over () i, path from p where len(path) > 1), u as (select i, unnest(path) n, unnest(range(1, 9)) k, len(path) l from q)"""


@query(f"with recursive {_SHAPES}, v as (select i, string_agg(coalesce(component_role, nullif(kind, ''), '-'), '>' order by k) shape, min(n) filter (k = 1) head from u join cur on cur.id = n where k <= l group by 1), s as (select shape, count(*) n, list_sort(list(distinct head))[:3] ex from v group by 1) select shape, n, array_to_string(ex, ',') as examples from s")
def a_shape_counts(spark, d):
    """Sequences of roles along the calls from controllers, with three examples each."""
    n = current_nodes(spark, d, "component_role", "kind")
    role = n.select(F.col("id").alias("n"), F.coalesce("component_role", F.nullif("kind", F.lit("")), F.lit("-")).alias("role"))
    p = graph.simple_paths(calls(spark, d), n.where("component_role = 'controller'").select(F.col("id").alias("node")), 3)
    u = p.select(F.col("path").alias("i"), F.posexplode("path").alias("k", "n")).join(role, "n")
    v = u.groupBy("i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "role"))), lambda s: s["role"]), ">").alias("shape")).select("shape", F.col("i")[0].alias("head"))
    few = v.distinct().withColumn("r", F.row_number().over(W.partitionBy("shape").orderBy("head"))).where("r <= 3").groupBy("shape").agg(F.array_join(F.sort_array(F.collect_list("head")), ",").alias("examples"))
    return v.groupBy("shape").agg(_N().alias("n")).join(few, "shape")


@query("with c as (select target_name t, count(*) n from (select distinct ref_id, target_name from refs) where target_name is not null group by 1), k as (select t, n, row_number() over (order by n desc, t) h, count(*) over () total from c) select t as target, n from k where h <= ceil(0.2 * least(total, 100) * 4) or h > total - ceil(0.2 * least(total, 100))")
def w_head_tail(spark, d):
    """A sample of the referenced names: four fifths the commonest, one fifth the rarest."""
    c = checkpointed(table(spark, d, "refs").select("ref_id", F.col("target_name").alias("target")).distinct().where("target is not null").groupBy("target").agg(_N().alias("n")))
    total = c.count()
    tail = -(-min(total, 100) // 5)
    head = -(-min(total, 100) * 4 // 5)
    return c.orderBy(F.desc("n"), "target").limit(head).unionByName(c.orderBy(F.asc("n"), F.desc("target")).limit(tail)).distinct()


@query(f"with {SQL_MODULE_IMPORTS}, ie as materialized (select repo || ':' || src a, repo || ':' || dst b from imp), w(a, b) as (select a, b from ie union select w.a, ie.b from w join ie on ie.a = w.b), k as (select w.a, w.b from w join w x on x.a = w.b and x.b = w.a) select min(b) as cycle, a as module from k group by 2".replace("with ", "with recursive ", 1))
def g_import_cycles(spark, d):
    """Modules that import each other, through any number of others, by the least of the group."""
    from veldspar.operators.hierarchy import find_cycles

    e = module_imports(spark, d).select(F.lit("CONTAINS").alias("type"), F.concat_ws(":", "repo", "src").alias("src"), F.concat_ws(":", "repo", "dst").alias("dst"), "repo")
    return find_cycles(e).select(F.col("cycle_id").alias("cycle"), F.col("node_id").alias("module"))


_MET = f"""{_CHG}, {sql_calls()}, hits as (select distinct chg.repo, calls.src from chg join calls on calls.dst = chg.id), fan as (select chg.repo, count(*) n from chg join calls on calls.dst = chg.id group by 1),
sens as (select chg.repo, count(*) n from chg join nd using (id) where regexp_matches(lower(coalesce(nd.name, '')), '{_WORDS["auth"]}') group by 1), cov as (select distinct chg.id from chg join calls on calls.dst = chg.id join nd t on t.id = calls.src where t.is_test),
met as materialized (select c.repo, n_changed, coalesce(h.n, 0) n_callers, coalesce(f.n, 0) fan_in, coalesce(s.n, 0) n_sensitive, n_untested from (select chg.repo, count(*) n_changed, count(*) filter (chg.id not in (select id from cov)) n_untested from chg group by 1) c left join (select repo, count(*) n from hits group by 1) h on h.repo = c.repo left join fan f on f.repo = c.repo left join sens s on s.repo = c.repo)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    c, n = changed(spark, d).select("id", "repo"), checkpointed(nodes(spark, d).select("id", "name", "is_test"))
    e = checkpointed(graph.pairs(calls(spark, d)).join(c.withColumnRenamed("id", "dst"), "dst"))
    into = e.groupBy("repo").agg(F.count_distinct("src").alias("n_callers"), _N().alias("fan_in"))
    tested = e.join(n.where("is_test").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("t", F.lit(True))
    own = c.join(tested, "id", "left").join(n.select("id", "name"), "id").groupBy("repo").agg(_N().alias("n_changed"), F.count_if(F.lower(F.coalesce("name", F.lit(""))).rlike(_WORDS["auth"])).alias("n_sensitive"), F.count_if(F.col("t").isNull()).alias("n_untested"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return own.join(into, "repo", "left").select("repo", "n_changed", zero("n_callers"), zero("fan_in"), "n_sensitive", "n_untested")


@query(f"with {_MET} select repo, n_changed, n_callers, fan_in, n_sensitive, n_untested from met")
def a_pr_metrics(spark, d):
    """Per repository: changed definitions, their callers and calls, sensitive ones, and ones that no test calls."""
    return _metrics(spark, d)


_SEV = "case when severity >= 9 then 15 when severity >= 7 then 8 when severity >= 4 then 3 else 1 end"


@query(f"with {_MET}, fs as (select repo, sum(case when severity is null or isnan(severity) then 0 else {_SEV} end) w, max((severity >= 9 and not isnan(severity))::int) crit from (select distinct ord, repo, severity from findings) group by 1), s as (select met.repo, least(100.0, least(n_callers, 30) + least(fan_in, 20) * 0.5 + n_sensitive * 6 + n_untested * 4 + coalesce(w, 0) / 10.0) x, coalesce(crit, 0) crit from met left join fs on fs.repo = met.repo) select repo, round(case when crit = 1 and x < 55 then 55.0 else x end)::bigint as risk, case when crit = 1 and x < 55 then 'high' when x < 25 then 'low' when x < 55 then 'medium' when x < 80 then 'high' else 'critical' end as level from s")
def a_risk(spark, d):
    """A capped weighted sum of a repository's changes and findings, in bands; a critical finding makes it high at least."""
    f = table(spark, d, "findings").select("ord", "repo", "severity").distinct()
    s = F.col("severity")
    ok = s.isNotNull() & ~F.isnan(s)
    w = F.when(~ok, 0).when(s >= 9, 15).when(s >= 7, 8).when(s >= 4, 3).otherwise(1)
    fs = f.groupBy("repo").agg(F.sum(w).alias("w"), F.max((ok & (s >= 9)).cast("int")).alias("crit"))
    m = _metrics(spark, d).join(fs, "repo", "left")
    x = F.least(F.lit(100.0), F.least("n_callers", F.lit(30)) + F.least("fan_in", F.lit(20)) * 0.5 + F.col("n_sensitive") * 6 + F.col("n_untested") * 4 + F.coalesce("w", F.lit(0)) / 10.0)
    low = (F.coalesce("crit", F.lit(0)) == 1) & (F.col("x") < 55)
    return m.withColumn("x", x).select("repo", F.round(F.when(low, 55.0).otherwise(F.col("x"))).cast("long").alias("risk"), F.when(low, "high").when(F.col("x") < 25, "low").when(F.col("x") < 55, "medium").when(F.col("x") < 80, "high").otherwise("critical").alias("level"))


@query(f"with {sql_nodes('repo', 'label', 'name', 'is_test')}, {sql_calls()}, br as (select n.repo, count(*) n from (select distinct * from callers where broken) c join cur n on n.id = {sql_id('c.changed_node_id')} group by 1), dead as (select repo, count(*) n from cur where label = 'Function' and not coalesce(is_test, false) and name not in ('main', '__init__') and id not in (select dst from calls) group by 1), pk as (select repo, count(distinct split_part(import_fqn, '.', 1)) n from refs where import_fqn is not null group by 1), rp as (select distinct repo from cur where repo is not null) select rp.repo, greatest(0, 100 - least(40, coalesce(br.n, 0) * 2) - least(30, coalesce(dead.n, 0) // 3) - least(10, coalesce(pk.n, 0))) as health from rp left join br on br.repo = rp.repo left join dead on dead.repo = rp.repo left join pk on pk.repo = rp.repo")
def a_health(spark, d):
    """100 less capped penalties for broken calls, dead code and foreign packages."""
    n = checkpointed(current_nodes(spark, d, "repo", "label", "name", "is_test"))
    br = table(spark, d, "callers").where("broken").distinct().select(norm_id("changed_node_id").alias("id")).join(n.select("id", "repo"), "id").groupBy("repo").agg(_N().alias("b"))
    dead = n.where("label = 'Function' and not coalesce(is_test, false) and name not in ('main', '__init__')").join(graph.pairs(calls(spark, d)).select(F.col("dst").alias("id")).distinct(), "id", "left_anti").groupBy("repo").agg(_N().alias("x"))
    pk = table(spark, d, "refs").where("import_fqn is not null").groupBy("repo").agg(F.count_distinct(F.split("import_fqn", r"\.")[0]).alias("p"))
    j = n.where("repo is not null").select("repo").distinct().join(br, "repo", "left").join(dead, "repo", "left").join(pk, "repo", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select("repo", F.greatest(F.lit(0), 100 - F.least(F.lit(40), z("b") * 2) - F.least(F.lit(30), F.expr("coalesce(x, 0) div 3")) - F.least(F.lit(10), z("p"))).alias("health"))


_REC = "(select distinct ord, repo, file, line, title, category, severity_label, source from findings)"


@query(f"with r as {_REC}, l as (select repo, file, ord, '- [' || coalesce(upper(trim(severity_label)), 'NONE') || '] ' || coalesce(title, '?') || ' (line ' || coalesce(line::varchar, '?') || ')' t from r where file is not null), g as (select repo, file, '### ' || file || chr(10) || string_agg(t, chr(10) order by ord) t from l group by 1, 2), h as (select repo, count(*) n from r group by 1) select h.repo, '# Review of ' || h.repo || chr(10) || 'Findings: ' || n || coalesce(chr(10) || string_agg(g.t, chr(10) order by g.file), '') as report from h left join g on g.repo = h.repo where h.repo is not null group by h.repo, n")
def sink_report_lines(spark, d):
    """A report in Markdown per repository: a head, and its findings file by file."""
    r = table(spark, d, "findings").where("repo is not null").select("ord", "repo", "file", "line", "title", "category", "severity_label", "source").distinct()
    t = F.concat(F.lit("- ["), F.coalesce(F.upper(F.trim("severity_label")), F.lit("NONE")), F.lit("] "), F.coalesce("title", F.lit("?")), F.lit(" (line "), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit(")"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), "\n")
    g = r.where("file is not null").groupBy("repo", "file").agg(joined(F.struct("ord", t.alias("t"))).alias("t")).select("repo", "file", F.concat(F.lit("### "), "file", F.lit("\n"), "t").alias("t"))
    files = g.groupBy("repo").agg(joined(F.struct("file", "t")).alias("body"))
    h = r.groupBy("repo").agg(_N().alias("n")).join(files, "repo", "left")
    return h.select("repo", F.concat(F.lit("# Review of "), "repo", F.lit("\nFindings: "), F.col("n").cast("string"), F.coalesce(F.concat(F.lit("\n"), "body"), F.lit(""))).alias("report"))


@query(f"with {_CUR}, {sql_nodes('repo', 'label', 'name')}, u as (select repo, relpath, unnest(regexp_extract_all(lower(t), '\\b(insert into|update|delete from|merge into)\\s+([a-z_][a-z0-9_]*)', 2)) tbl, 'WRITES' kind from curf union all select repo, relpath, unnest(regexp_extract_all(lower(t), '\\b(from|join)\\s+([a-z_][a-z0-9_]*)', 2)), 'READS' from curf) select distinct u.repo, relpath, kind, cur.id as table_id from u join cur on cur.repo = u.repo and cur.label in ('Class', 'Package') and lower(cur.name) = u.tbl")
def j_sql_links(spark, d):
    """Tables named in SQL inside files, linked to the nodes that bear their names."""
    t = _current(spark, d)
    find = lambda rx, kind: t.select("repo", "relpath", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.lower("t"), F.lit(rx), F.lit(2))).alias("tbl"))
    u = find(r"\b(insert into|update|delete from|merge into)\s+([a-z_][a-z0-9_]*)", "WRITES").unionByName(find(r"\b(from|join)\s+([a-z_][a-z0-9_]*)", "READS")).distinct()
    n = current_nodes(spark, d, "repo", "label", "name").where("label in ('Class', 'Package') and name is not null").select("repo", F.lower("name").alias("tbl"), F.col("id").alias("table_id"))
    return u.join(n, ["repo", "tbl"]).select("repo", "relpath", "kind", "table_id").distinct()


@query(f"with r as (select distinct ord, id, repo, owning_fqn, subcategory, source from findings), first_ as (select *, row_number() over (partition by id order by ord) k from r), one as (select * from first_ where k = 1 or id is null), fam as (select *, case when regexp_matches(coalesce(subcategory, ''), '(?i)injection') then 'injection' else coalesce(subcategory, '') end f from one), p as (select distinct repo, owning_fqn, f from fam where source = 'graph_proven' and repo is not null and owning_fqn is not null) select fam.ord from fam left join p on p.repo = fam.repo and p.owning_fqn = fam.owning_fqn and p.f = fam.f where not (coalesce(fam.source, '') = 'llm_judged' and p.f is not null)")
def u_family_dedupe(spark, d):
    """The first finding of each id, without judged ones for whose function and family one is proven."""
    r = table(spark, d, "findings").select("ord", "id", "repo", "owning_fqn", "subcategory", "source").distinct()
    once = r.where("id is not null").groupBy("id").agg(F.min("ord").alias("ord"))
    one = r.join(once, ["id", "ord"], "left_semi").unionByName(r.where("id is null").select("id", "ord", "repo", "owning_fqn", "subcategory", "source"))
    fam = one.withColumn("f", F.when(F.coalesce("subcategory", F.lit("")).rlike("(?i)injection"), "injection").otherwise(F.coalesce("subcategory", F.lit(""))))
    p = fam.where("source = 'graph_proven'").select("repo", "owning_fqn", "f").distinct()
    judged = F.coalesce(F.col("source") == "llm_judged", F.lit(False))
    return fam.where(~judged).select("ord").unionByName(fam.where(judged).join(p, ["repo", "owning_fqn", "f"], "left_anti").select("ord"))


@query(f"with {_ND}, f as (select {sql_id('dst')} id, count(*) n from edges where upper(trim(type)) = 'CALLS' group by 1), s as (select nd.id, nd.name, coalesce(f.n, 0) fan_in, coalesce(f.n, 0) + case when nd.route is not null or nd.component_role = 'controller' then 5 else 0 end + case when regexp_matches(lower(coalesce(nd.name, '')), '{_WORDS['auth']}') then 3 else 0 end score from nd left join f on f.id = nd.id where label in ('Function', 'Class')) select id, name, fan_in, score from s order by score desc, id limit 20")
def w_hotspots(spark, d):
    """The twenty hottest definitions: calls, 5 more for entry points, 3 for sensitive names."""
    fan = calls(spark, d).where("dst is not null").groupBy(F.col("dst").alias("id")).agg(_N().alias("n"))
    n = nodes(spark, d).where("label in ('Function', 'Class')").join(fan, "id", "left").withColumn("fan_in", F.coalesce("n", F.lit(0)))
    entry = F.coalesce(F.col("route").isNotNull() | (F.col("component_role") == "controller"), F.lit(False))
    score = F.col("fan_in") + F.when(entry, 5).otherwise(0) + F.when(F.lower(F.coalesce("name", F.lit(""))).rlike(_WORDS["auth"]), 3).otherwise(0)
    return n.select("id", "name", "fan_in", score.alias("score")).orderBy(F.desc("score"), "id").limit(20)


_CAPS = "case label when 'Package' then 80 when 'Class' then 60 else 40 end"


@query(f"with {sql_nodes('label', 'name', 'fan_in', 'visibility')}, par as (select distinct {sql_id('src')} p, {sql_id('dst')} c from edges where upper(trim(type)) in ('CONTAINS', 'DEFINES')), m as (select o.id, o.label, k.name, row_number() over (partition by o.id order by coalesce(k.visibility, '') <> 'public', coalesce(k.fan_in, 0) desc, k.name, k.id) r, count(*) over (partition by o.id) n from par join cur o on o.id = par.p join cur k on k.id = par.c) select id, coalesce(string_agg(name, ', ' order by r) filter (r <= {_CAPS}), '') || case when max(n) > max({_CAPS}) then ' … and ' || (max(n) - max({_CAPS})) || ' more' else '' end as members from m group by id")
def w_capped_list(spark, d):
    """Members of a container, public and much called ones first: 80 of a package, 60 of a class, 40 of others."""
    n = checkpointed(current_nodes(spark, d, "label", "name", "fan_in", "visibility"))
    own = graph.pairs(calls(spark, d, "CONTAINS", "DEFINES")).join(n.select(F.col("id").alias("src"), F.col("label").alias("kind")), "src").join(n.withColumnRenamed("id", "dst"), "dst")
    w = W.partitionBy("src").orderBy(F.coalesce("visibility", F.lit("")) != "public", F.desc(F.coalesce("fan_in", F.lit(0))), "name", "dst")
    cap = F.when(F.col("kind") == "Package", 80).when(F.col("kind") == "Class", 60).otherwise(40)
    top = own.withColumn("r", F.row_number().over(w)).withColumn("cap", cap).groupBy(F.col("src").alias("id")).agg(_N().alias("n"), F.max("cap").alias("cap"), F.sort_array(F.collect_list(F.when((F.col("r") <= F.col("cap")) & F.col("name").isNotNull(), F.struct("r", "name")))).alias("m"))
    more = F.when(F.col("n") > F.col("cap"), F.concat(F.lit(" … and "), (F.col("n") - F.col("cap")).cast("string"), F.lit(" more"))).otherwise("")
    return top.select("id", F.concat(F.array_join(F.transform("m", lambda s: s["name"]), ", "), more).alias("members"))


_PROVEN = ("taint", "audit", "impact")


@query(f"with r as (select distinct ord, file, provenance from findings) select ord from r where provenance in {_PROVEN} and not regexp_matches(lower(replace(coalesce(file, ''), chr(92), '/')), 'path/to/|example\\.py|your_file|placeholder')")
def p_publishable(spark, d):
    """Findings whose provenance is a graph and whose path is no placeholder."""
    path = F.lower(F.regexp_replace(F.coalesce("file", F.lit("")), r"\\", "/"))
    r = table(spark, d, "findings").select("ord", "file", "provenance").distinct()
    return r.where(F.col("provenance").isin(*_PROVEN) & ~path.rlike(r"path/to/|example\.py|your_file|placeholder")).select("ord")


_GRADE = "case when model_severity is null or isnan(model_severity) then 5.0 else greatest(0.0, least(10.0, model_severity)) end"


@query(f"with r as (select distinct ord, title, message, category, source, line, file, owning_fqn, model_severity from findings) select ord, trim(title) as title, coalesce(nullif(trim(category), ''), 'correctness') as category, coalesce(nullif(trim(source), ''), 'llm_judged') as source, greatest(coalesce(line, 0), 0) as line, coalesce(nullif(trim(file), ''), '?') as file, coalesce(nullif(trim(owning_fqn), ''), nullif(trim(file), ''), '?') as owner, {_GRADE} as severity from r where trim(coalesce(title, '')) <> '' and trim(coalesce(message, '')) <> ''")
def p_coerce_findings(spark, d):
    """Findings with what a finding must have: title and message required, defaults, a clamped grade, file and owner."""
    r = table(spark, d, "findings").select("ord", "title", "message", "category", "source", "line", "file", "owning_fqn", "model_severity").distinct().where("trim(coalesce(title, '')) <> '' and trim(coalesce(message, '')) <> ''")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    m = F.col("model_severity")
    grade = F.when(m.isNull() | F.isnan(m), 5.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), m)))
    return r.select(
        "ord", F.trim("title").alias("title"), F.coalesce(filled("category"), F.lit("correctness")).alias("category"), F.coalesce(filled("source"), F.lit("llm_judged")).alias("source"), F.greatest(F.coalesce("line", F.lit(0)), F.lit(0)).alias("line"),
        F.coalesce(filled("file"), F.lit("?")).alias("file"), F.coalesce(filled("owning_fqn"), filled("file"), F.lit("?")).alias("owner"), grade.alias("severity"),
    )


@query(f"with {_ND}, k as (select repo, file, case when route is not null then 'route' when label = 'Class' and regexp_matches(name, '(Model|Table|Entity)$') then 'table' when label = 'Function' and regexp_matches(name, '^(on|handle|emit|publish)_') then 'event' when label in ('Function', 'Class') then 'definition' end kind, name from nd where file is not null) select repo, file, kind, count(*) as n, min(name) as first_name from k where kind is not null group by 1, 2, 3")
def p_kinds(spark, d):
    """Routes, tables, events and definitions of each file."""
    fn, cls = F.col("label") == "Function", F.col("label") == "Class"
    kind = F.when(F.col("route").isNotNull(), "route").when(cls & F.col("name").rlike("(Model|Table|Entity)$"), "table").when(fn & F.col("name").rlike("^(on|handle|emit|publish)_"), "event").when(fn | cls, "definition")
    return nodes(spark, d).where("file is not null").withColumn("kind", kind).where("kind is not null").groupBy("repo", "file", "kind").agg(_N().alias("n"), F.min("name").alias("first_name"))


_RULES = "case when b.p is not null then 'exact' when r.p <> r.c and e.p is not null then 'relative' when s.n = 1 then 'suffix' when u.n = 1 then 'basename' else 'none' end"


@query(f"with f as (select distinct repo, relpath p from files), r as (select distinct repo, file p, regexp_replace(replace(file, chr(92), '/'), '^(\\./|/)+', '') c from findings where file is not null and repo is not null), sx as (select r.repo, r.p, count(*) n from r join f on f.repo = r.repo and ends_with(f.p, '/' || r.c) group by 1, 2), bx as (select repo, regexp_extract(p, '[^/]*$') base, count(*) n from f group by 1, 2) select r.repo, r.p as path, {_RULES} as rule from r left join f b on b.repo = r.repo and b.p = r.p left join f e on e.repo = r.repo and e.p = r.c left join sx s on s.repo = r.repo and s.p = r.p left join bx u on u.repo = r.repo and u.base = regexp_extract(r.c, '[^/]*$')")
def j_path_match(spark, d):
    """Paths in findings matched to files: exactly, cleaned, by a unique ending, by a unique base name."""
    f = table(spark, d, "files").select("repo", F.col("relpath").alias("f")).distinct()
    r = table(spark, d, "findings").where("file is not null and repo is not null").select("repo", F.col("file").alias("path")).distinct().withColumn("c", tx.clean_path(F.col("path")))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    hit = lambda name, c: f.select("repo", F.col("f").alias(c), F.lit(True).alias(name))
    # an ending shares its base name, so that is the key of the join
    ends = r.withColumn("base", base(F.col("c"))).join(f.withColumn("base", base(F.col("f"))), ["repo", "base"]).where(F.col("f").endswith(F.concat(F.lit("/"), "c"))).groupBy("repo", "path").agg(_N().alias("n_ends"))
    bases = f.groupBy("repo", base(F.col("f")).alias("base")).agg(_N().alias("n_base"))
    j = r.withColumn("base", base(F.col("c"))).join(hit("exact", "path"), ["repo", "path"], "left").join(hit("clean", "c"), ["repo", "c"], "left").join(ends, ["repo", "path"], "left").join(bases, ["repo", "base"], "left")
    return j.select("repo", "path", F.when(F.col("exact"), "exact").when((F.col("path") != F.col("c")) & F.col("clean"), "relative").when(F.col("n_ends") == 1, "suffix").when(F.col("n_base") == 1, "basename").otherwise("none").alias("rule"))


@query(f"with {_ND}, r as (select distinct ref_id, upper(trim(type)) ty, repo, recv, nullif(trim(target_name, ' ' || chr(9) || chr(10) || chr(13)), '') t from refs), x as (select repo, name k, id from nd union select repo, fqn, id from nd), full_ as (select r.ref_id, count(distinct x.id) n from r join x on x.repo = r.repo and x.k = r.t group by 1), tail as (select r.ref_id, count(distinct x.id) n from r join x on x.repo = r.repo and x.k = regexp_extract(r.t, '[^.#]*$') group by 1) select r.ref_id, case when ty = 'CALLS' and coalesce(recv, '') not in ('', 'self', 'cls') and coalesce(f.n, 0) <> 1 then 'REFERENCES' else ty end as type, case when f.n is not null then 'full' when l.n is not null then 'tail' else 'none' end as found_by, coalesce(f.n, l.n, 0) as n from r left join full_ f using (ref_id) left join tail l using (ref_id) where t is not null")
def j_demote(spark, d):
    """References by full name, else by its tail; a call on an unknown receiver that is not certain is demoted to a reference."""
    r = checkpointed(table(spark, d, "refs").select("ref_id", F.upper(trimmed("type")).alias("ty"), "repo", "recv", trimmed("target_name").alias("t")).where("t is not null").distinct())
    x = checkpointed(nodes(spark, d).select("repo", "id", F.explode(F.array_distinct(F.array("name", "fqn"))).alias("t")).where("t is not null").distinct())
    by = lambda rows, n: rows.join(x, ["repo", "t"]).groupBy("ref_id").agg(F.count_distinct("id").alias(n))
    j = r.join(by(r.select("ref_id", "repo", "t"), "f"), "ref_id", "left").join(by(r.select("ref_id", "repo", tx.tail_name(F.col("t")).alias("t")), "l"), "ref_id", "left")
    vague = (F.col("ty") == "CALLS") & ~F.coalesce("recv", F.lit("")).isin("", "self", "cls") & (F.coalesce("f", F.lit(0)) != 1)
    return j.select("ref_id", F.when(vague, "REFERENCES").otherwise(F.col("ty")).alias("type"), F.when(F.col("f").isNotNull(), "full").when(F.col("l").isNotNull(), "tail").otherwise("none").alias("found_by"), F.coalesce("f", "l", F.lit(0)).alias("n"))


@query(f"with recursive links as (select distinct {sql_id('src')} a, {sql_id('dst')} b from edges where upper(trim(type)) in ('EXTENDS', 'IMPORTS', 'CONTAINS', 'BELONGS_TO', 'USES') and {sql_id('src')} is not null and {sql_id('dst')} is not null), core as (select a, b from links where a in (select b from links) and b in (select a from links)), w(a, b) as (select a, b from core union select w.a, core.b from w join core on core.a = w.b) select min(w.b) as cycle, w.a as node from w join w x on x.a = w.b and x.b = w.a group by 2")
def g_cycles(spark, d):
    """Nodes that import, use, extend or hold each other, through any number of others, by the least of the group."""
    from veldspar.operators.hierarchy import find_cycles

    e = table(spark, d, "edges").where(F.upper(trimmed("type")).isin("EXTENDS", "IMPORTS", "CONTAINS", "BELONGS_TO", "USES")).select(F.lit("CONTAINS").alias("type"), "src", "dst", "repo")
    return find_cycles(e).select(F.col("cycle_id").alias("cycle"), F.col("node_id").alias("node"))


@query(f"with recursive {_CHG}, lk as materialized (select distinct {sql_id('src')} a, {sql_id('dst')} b from edges where upper(trim(type)) in ('CALLS', 'INSTANTIATES') and {sql_id('src')} in (select id from chg) and {sql_id('dst')} in (select id from chg)), p(path) as (select [id] from chg union all select list_append(path, lk.b) from p join lk on lk.a = path[1] and false union all select list_append(path, lk.b) from p join lk on lk.a = path[-1] where len(path) < 4 and not list_contains(path, lk.b)) select path[1] as start, max(len(path)) as n_nodes from p group by 1".replace("select list_append(path, lk.b) from p join lk on lk.a = path[1] and false union all ", ""))
def g_longest_path(spark, d):
    """The longest way from each changed definition through other changed ones, four nodes at most."""
    ids = changed(spark, d).select(F.col("id").alias("node"))
    e = calls(spark, d, "CALLS", "INSTANTIATES").join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    p = graph.simple_paths(e, ids, 3).groupBy(F.col("path")[0].alias("start")).agg(F.max(F.size("path")).alias("n"))
    return ids.withColumnRenamed("node", "start").join(p, "start", "left").select("start", F.coalesce("n", F.lit(1)).alias("n_nodes"))


@query(f"with {_ND}, oc as (select distinct repo, evidence_file f, evidence_line l, {sql_id('dst')} t from edges where evidence_line > 0), hit as (select oc.*, exists (select 1 from nd where nd.repo = oc.repo and nd.file = regexp_replace(replace(oc.f, chr(92), '/'), '^(\\./|/)+', '') and nd.label = 'Function' and oc.l between nd.start_line and nd.end_line) inside, t in (select id from nd) known from oc) select count(*) as occurrences, count(*) filter (inside) as inside_functions, count(*) filter (known) as known_targets, count(distinct f) as documents from hit")
def a_scip(spark, d):
    """Counters of the index: occurrences, those inside functions, those of known symbols, documents."""
    e = table(spark, d, "edges").where("evidence_line > 0").select("repo", "evidence_file", "evidence_line", F.coalesce(norm_id("dst"), F.lit("")).alias("t")).distinct()
    n = checkpointed(nodes(spark, d).select("id", "repo", "file", "label", "start_line", "end_line"))
    o = checkpointed(e.withColumn("file", tx.clean_path(F.col("evidence_file"))))
    key = ["repo", "evidence_file", "evidence_line", "t"]
    inside = o.join(n.where("label = 'Function'").drop("id", "label"), ["repo", "file"]).where("evidence_line between start_line and end_line").select(*key).distinct().withColumn("i", F.lit(True))
    known = n.select(F.col("id").alias("t"), F.lit(True).alias("k"))
    return o.join(inside, key, "left").join(known, "t", "left").agg(_N().alias("occurrences"), F.count_if("i").alias("inside_functions"), F.count_if("k").alias("known_targets"), F.count_distinct("evidence_file").alias("documents"))


@query(f"with recursive {_CHG}, lk as (select distinct {sql_id('src')} a, {sql_id('dst')} b from edges where upper(trim(type)) in ('CALLS', 'INSTANTIATES', 'EXTENDS', 'OVERRIDES') and {sql_id('src')} in (select id from chg) and {sql_id('dst')} in (select id from chg)), sym as (select a, b from lk union select b, a from lk), cc(x, c) as (select id, id from chg union select sym.b, cc.c from cc join sym on sym.a = cc.x), cl as (select x id, min(c) cluster from cc group by 1) select cluster, '# Cluster of ' || count(*) || ' changes' || chr(10) || string_agg('- ' || coalesce(nd.fqn, nd.name, '?') || ' (' || chg.change_type || ')', chr(10) order by nd.id) as prompt from cl join chg using (id) join nd using (id) group by 1")
def l_impact_prompts(spark, d):
    """A prompt per cluster of changes: its members and how they change."""
    from veldspar.plans.review import clusters

    c = changed(spark, d)
    j = clusters(spark, d, c).join(c.select(F.col("id").alias("node"), "change_type"), "node").join(nodes(spark, d).select(F.col("id").alias("node"), "fqn", "name"), "node")
    line = F.concat(F.lit("- "), F.coalesce("fqn", "name", F.lit("?")), F.lit(" ("), "change_type", F.lit(")"))
    return j.groupBy("cluster").agg(F.concat(F.lit("# Cluster of "), _N().cast("string"), F.lit(" changes\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", line.alias("t")))), lambda x: x["t"]), "\n")).alias("prompt"))


@query("with c as (select distinct chunk_id, repo, file_path, dossier from chunks where dossier is not null and dossier <> ''), f as (select repo, file_path, regexp_extract(dossier, '^[^\\n]*') title, min(chunk_id) chunk_id from c group by 1, 2, 3) select repo, file_path, title, chunk_id, 'info' as severity from f where title <> ''")
def l_review(spark, d):
    """A whole review with the provider that needs no model: chunk by chunk, repeated findings of a file once."""
    from veldspar.operators import provider

    c = checkpointed(table(spark, d, "chunks").where("dossier is not null and dossier <> ''").select("chunk_id", "repo", "file_path", "dossier").distinct())
    found = provider.completed(c, "chunk_id", "dossier", provider.FirstLine()).join(c.select("chunk_id", "repo", "file_path"), "chunk_id")
    return found.groupBy("repo", "file_path", "title").agg(F.min("chunk_id").alias("chunk_id"), F.max("severity").alias("severity"))
