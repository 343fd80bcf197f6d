"""Scalar functions, sources, writes, predicates, joins and text extraction."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions import text as tx
from veldspar.functions.keys import norm_id, trimmed
from veldspar.operators import ranking as rk, sinks
from veldspar.plans.graphs import calls, current_nodes, sql_calls, sql_id, sql_nodes
from veldspar.plans.register import Book
from veldspar.plans.relational import _SQL_NAMES, _SQL_REFS, _findings, _names, _refs, _RECORDS
from veldspar.sources.tables import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

_N = lambda: F.count(F.lit(1))
_PATH = "regexp_replace(replace({c}, chr(92), '/'), '^(\\./|/)+', '')"

# scalar functions


@query("select id, left(sha1(coalesce(repo, '') || chr(0) || coalesce(kind, '') || chr(0) || coalesce(fqn, '')), 16) as made from (select distinct id, repo, kind, fqn from nodes)")
def f_ids(spark, d):
    n = table(spark, d, "nodes").select("id", "repo", "kind", "fqn").distinct()
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return n.select("id", tx.stable_id(e("repo"), e("kind"), e("fqn")).alias("made"))


@query("select doc_id, greatest(1, length(text) // 4)::int as tokens from documents where text is not null")
def f_tokens(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("with n as (select distinct name, fqn, return_type from nodes where fqn is not null) select name, fqn, return_type, regexp_extract(fqn, '[^.#]*$') as tail, case when regexp_matches(name, '^__.*__$') then 'public' when starts_with(name, '__') then 'private' when starts_with(name, '_') then 'protected' else 'public' end as visibility, regexp_extract(replace(regexp_replace(return_type, '<.*$', ''), '[]', ''), '[^.#]*$') as type_name from n")
def f_names(spark, d):
    n = table(spark, d, "nodes").where("fqn is not null").select("name", "fqn", "return_type").distinct()
    return n.select("name", "fqn", "return_type", tx.tail_name(F.col("fqn")).alias("tail"), tx.visibility(F.col("name")).alias("visibility"), tx.simple_type(F.col("return_type")).alias("type_name"))


@query("with n as (select distinct name from nodes where name is not null) select name, regexp_replace(regexp_replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1.\\2', 'g')), '[_\\-/:\\s.]+', '.', 'g'), '^\\.|\\.$', '', 'g') as event from n")
def f_event_name(spark, d):
    return table(spark, d, "nodes").where("name is not null").select("name").distinct().select("name", tx.event_name(F.col("name")).alias("event"))


_ROUTES = "(select distinct 'https://Api.Example.test:8080/v1/' || replace(relpath, '_', '/:') || '?q=1#top' u from files)"


def _urls(spark, d):
    return table(spark, d, "files").select(F.concat(F.lit("https://Api.Example.test:8080/v1/"), F.replace("relpath", F.lit("_"), F.lit("/:")), F.lit("?q=1#top")).alias("u")).distinct()


@query(f"select u, lower(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)) as host, regexp_replace(regexp_replace(u, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') as path from {_ROUTES}")
def f_split_url(spark, d):
    return _urls(spark, d).select("u", tx.url_host(F.col("u")).alias("host"), tx.url_path(F.col("u")).alias("path"))


@query(f"select u, '/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), ':[A-Za-z_]\\w*', '*', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g') as route from {_ROUTES}")
def f_route(spark, d):
    return _urls(spark, d).select("u", tx.route_key(tx.url_path(F.col("u"))).alias("route"))


@query(f"select u, lower(regexp_replace('/' || regexp_replace(regexp_replace(u, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g')) as path from {_ROUTES}")
def f_api_path(spark, d):
    return _urls(spark, d).select("u", tx.api_path(F.col("u")).alias("path"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query(f"with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9_]+'), 1) i from documents where text is not null), f as (select doc_id, w, min(i) i from w where length(w) >= 3 and w not in ({_STOP}) group by 1, 2) select doc_id, count(*) as n, md5(string_agg(w, ' ' order by i)) as terms from f group by 1")
def f_terms(spark, d):
    """Distinct terms of each text in order, as a hash."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", tx.query_terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("terms"))


@query("with v as (select distinct id, param_names from nodes where param_names is not null), u as (select id, param_names, unnest(param_names) x, generate_subscripts(param_names, 1) i from v), f as (select id, param_names, left(trim(x), 60) x, i from u where trim(x) <> ''), k as (select id, param_names, lower(x) k, arg_min(x, i) x, min(i) i from f group by 1, 2, 3), c as (select id, param_names, x, i, row_number() over (partition by id, param_names order by i) r from k) select id, string_agg(x, ',' order by i) as terms from c where r <= 12 group by id, param_names")
def f_clean_terms(spark, d):
    n = table(spark, d, "nodes").where("param_names is not null").select("id", "param_names").distinct()
    return n.select("id", F.array_join(tx.clean_terms(F.col("param_names")), ",").alias("terms")).where("terms <> ''")


@query(f"with {sql_nodes('label', 'name', 'fqn', 'signature', 'docstring')} select id, concat_ws(chr(10), label || ' ' || name, fqn, signature, docstring) as doc from cur")
def f_embed_doc(spark, d):
    """The text a node is embedded by."""
    return current_nodes(spark, d, "label", "name", "fqn", "signature", "docstring").select("id", F.concat_ws("\n", F.concat("label", F.lit(" "), "name"), "fqn", "signature", "docstring").alias("doc"))


@query("select distinct upper(trim(type)) as type, confidence, case upper(trim(type)) when 'CALLS' then 1.0 when 'EXTENDS' then 0.9 when 'INSTANTIATES' then 0.8 when 'IMPORTS' then 0.4 else 0.5 end::double as weight, case confidence when 'EXTRACTED' then 1.0 when 'INFERRED' then 0.6 when 'AMBIGUOUS' then 0.2 else 0.6 end::double as score from edges")
def f_weights(spark, d):
    e = table(spark, d, "edges").select(F.upper(trimmed("type")).alias("type"), "confidence").distinct()
    t, c = F.col("type"), F.col("confidence")
    return e.select("type", "confidence", F.when(t == "CALLS", 1.0).when(t == "EXTENDS", 0.9).when(t == "INSTANTIATES", 0.8).when(t == "IMPORTS", 0.4).otherwise(0.5).alias("weight"), F.when(c == "EXTRACTED", 1.0).when(c == "INFERRED", 0.6).when(c == "AMBIGUOUS", 0.2).otherwise(0.6).alias("score"))


@query(f"select ord, least(10.0, greatest(0.0, base * reach * blast)) as severity, case when least(10.0, greatest(0.0, base * reach * blast)) >= 8 then 'CRITICAL' when base * reach * blast >= 6 then 'HIGH' when base * reach * blast >= 3 then 'MEDIUM' else 'LOW' end as label from (select ord, case source when 'graph_proven' then 10.0 when 'llm_judged' then 7.0 else 5.0 end::double base, case when coalesce(blast_count, 0) > 0 then 1.0 else 0.6 end::double reach, 0.5 + 0.5 * case when coalesce(blast_count, 0) = 0 then 0.0 else least(1.0, coalesce(qualified_blast_count, 0)::double / blast_count) end blast from {_RECORDS})")
def f_severity(spark, d):
    """Severity from source, reach and the qualified share of the blast radius."""
    s = F.col("source")
    base = F.when(s == "graph_proven", 10.0).when(s == "llm_judged", 7.0).otherwise(5.0)
    n = F.coalesce("blast_count", F.lit(0))
    v = base * F.when(n > 0, 1.0).otherwise(0.6) * (F.lit(0.5) + F.lit(0.5) * F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce("qualified_blast_count", F.lit(0)).cast("double") / F.col("blast_count"))))
    out = _findings(spark, d).select("ord", F.least(F.lit(10.0), F.greatest(F.lit(0.0), v)).alias("severity"))
    x = F.col("severity")
    return out.withColumn("label", F.when(x >= 8, "CRITICAL").when(x >= 6, "HIGH").when(x >= 3, "MEDIUM").otherwise("LOW"))


@query(f"select ord, case when model_severity is not null and not isnan(model_severity) then least(10.0, greatest(0.0, model_severity)) else case lower(trim(severity_band)) when 'critical' then 9.0 when 'high' then 7.0 when 'medium' then 5.0 when 'low' then 2.5 else 1.0 end end::double as severity from {_RECORDS}")
def f_parse_severity(spark, d):
    m, b = F.col("model_severity"), F.lower(F.trim("severity_band"))
    band = F.when(b == "critical", 9.0).when(b == "high", 7.0).when(b == "medium", 5.0).when(b == "low", 2.5).otherwise(1.0)
    return _findings(spark, d).select("ord", F.when(m.isNotNull() & ~F.isnan(m), F.least(F.lit(10.0), F.greatest(F.lit(0.0), m))).otherwise(band).alias("severity"))


@query(f"with {sql_nodes('label', 'name', 'docstring')} select id, case when docstring is not null and docstring <> '' then left(docstring, 40) else label || ' ' || name end as brief from cur")
def f_describe(spark, d):
    n = current_nodes(spark, d, "label", "name", "docstring")
    return n.select("id", F.when(F.col("docstring") != "", F.substring("docstring", 1, 40)).otherwise(F.concat("label", F.lit(" "), "name")).alias("brief"))


# sources and writes


@query("select doc_id, left(array_to_string(string_split(text, chr(10))[3:8], chr(10)), 4000) as part from documents where text is not null")
def src_line_slice(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.line_slice(F.col("text"), F.lit(3), F.lit(8), 4000).alias("part"))


@query("select distinct repo, left(regexp_replace(repo || '/x y', '[^A-Za-z0-9._-]+', '-', 'g'), 64) as safe from files")
def src_safe_name(spark, d):
    return table(spark, d, "files").select("repo").distinct().select("repo", F.substring(F.regexp_replace(F.concat("repo", F.lit("/x y")), r"[^A-Za-z0-9._-]+", "-"), 1, 64).alias("safe"))


@query("with f as (select repo, relpath, sha, lang, row_number() over (partition by repo, relpath order by last_indexed desc) r from files) select repo, relpath, sha, case regexp_extract(relpath, '\\.(\\w+)$', 1) when 'py' then 'python' when 'pyi' then 'python' when 'java' then 'java' when 'js' then 'javascript' when 'mjs' then 'javascript' when 'ts' then 'typescript' when 'mts' then 'typescript' end as lang from f where r = 1 and not regexp_matches(relpath, '(^|/)(node_modules|vendor|dist|build)/')")
def src_discover(spark, d):
    """Current files outside ignored folders, with the language of their extension."""
    f = table(spark, d, "files").groupBy("repo", "relpath").agg(F.max_by("sha", "last_indexed").alias("sha"))
    ext = F.regexp_extract("relpath", r"\.(\w+)$", 1)
    lang = F.when(ext.isin("py", "pyi"), "python").when(ext == "java", "java").when(ext.isin("js", "mjs"), "javascript").when(ext.isin("ts", "mts"), "typescript")
    keep = ~F.arrays_overlap(F.slice(F.split("relpath", "/"), 1, F.size(F.split("relpath", "/")) - 1), F.array(*[F.lit(x) for x in ("node_modules", "vendor", "dist", "build")]))
    return f.where(keep).select("repo", "relpath", "sha", lang.alias("lang"))


@query(f"with v as (select id, name, docstring, row_number() over (partition by id order by last_indexed, ord) r, count(*) over (partition by id) n from nodes), a as (select id, name, docstring from v where r = 1), b as (select id, name, docstring from v where r = n and n > 1) select a.id, coalesce(b.name, a.name) as name, coalesce(b.docstring, a.docstring) as docstring from a left join b using (id)")
def sink_upsert_nodes(spark, d):
    """First versions of the nodes, updated by their last ones."""
    n = table(spark, d, "nodes").groupBy("id").agg(F.min_by(F.struct("name", "docstring"), F.struct("last_indexed", "ord")).alias("a"), F.max_by(F.struct("name", "docstring"), F.struct("last_indexed", "ord")).alias("b"), _N().alias("n"))
    return sinks.upsert(n.select("id", "a.*"), n.where("n > 1").select("id", "b.*"), ["id"])


@query(f"with {sql_nodes('name')}, e as (select upper(trim(type)) type, {sql_id('src')} src, {sql_id('dst')} dst, strategy, evidence_line, ord from edges) select type, src, dst, arg_max(strategy, ord) filter (strategy is not null) as strategy, arg_max(evidence_line, ord) filter (evidence_line is not null) as evidence_line, max(ord) as ord from e where src in (select id from cur) and dst in (select id from cur) group by 1, 2, 3")
def sink_upsert_edges(spark, d):
    """One edge per type and ends, later values win, both ends known."""
    e = table(spark, d, "edges").select(F.upper(trimmed("type")).alias("type"), norm_id("src").alias("src"), norm_id("dst").alias("dst"), "strategy", "evidence_line", "ord")
    return sinks.upsert_edges(e, current_nodes(spark, d, "name"))


@query(f"with {sql_nodes('name', 'is_test')}, f as (select {sql_id('dst')} id from edges where upper(trim(type)) = 'EXTENDS' group by 1) select cur.id, case when f.id is not null then 'base' else name end as name from cur left join f using (id)")
def sink_patch(spark, d):
    ch = calls(spark, d, "EXTENDS").where("dst is not null").select(F.col("dst").alias("id")).distinct().withColumn("name", F.lit("base"))
    return sinks.patch(current_nodes(spark, d, "name"), ch, ["id"])


@query(f"with {sql_nodes('repo')}, {sql_calls('CALLS')}, k as (select id from cur where repo = 'amber-gate') select 'nodes' as what, count(*) as n from cur where repo <> 'amber-gate' union all select 'edges', count(*) from calls where src not in (select id from k) and dst not in (select id from k)")
def sink_wipe_counts(spark, d):
    n, e = sinks.wipe(current_nodes(spark, d, "repo"), calls(spark, d).where("src is not null and dst is not null").distinct(), "amber-gate")
    return n.agg(_N().alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(e.agg(_N().alias("n")).select(F.lit("edges").alias("what"), "n"))


@query("select id, count(*) as n from nodes group by 1 having count(*) > 1 or max(label) not in ('Function', 'Class', 'File', 'Package', 'Repository')")
def sink_constraint_check(spark, d):
    """Ids that are not unique, or of a label that is not allowed."""
    return table(spark, d, "nodes").groupBy("id").agg(_N().alias("n"), F.max("label").alias("l")).where("n > 1 or l not in ('Function', 'Class', 'File', 'Package', 'Repository')").select("id", "n")


@query("select upper(trim(type)) as type, case when upper(trim(type)) in ('CALLS', 'IMPORTS', 'EXTENDS', 'CONTAINS', 'INSTANTIATES') then upper(trim(type)) else 'CALLS' end as rel, count(*) as n from edges group by 1, 2")
def sink_edge_rel_map(spark, d):
    t = F.upper(trimmed("type"))
    return table(spark, d, "edges").groupBy(t.alias("type"), F.when(t.isin("CALLS", "IMPORTS", "EXTENDS", "CONTAINS", "INSTANTIATES"), t).otherwise("CALLS").alias("rel")).agg(_N().alias("n"))


# predicates


@query("select distinct id, nullif(docstring, '') as docstring, nullif(component_role, '') as role, nullif(return_type, '') as return_type from nodes")
def p_clean_props(spark, d):
    z = lambda c: F.nullif(F.col(c), F.lit(""))
    return table(spark, d, "nodes").select("id", z("docstring").alias("docstring"), z("component_role").alias("role"), z("return_type").alias("return_type")).distinct()


@query(f"with {sql_nodes('label', 'name', 'fqn')} select id, name from cur where label in ('Function', 'Class') and (contains(lower(name), 'merge') or contains(lower(fqn), 'merge')) order by name, id limit 50")
def p_node_search(spark, d):
    n = current_nodes(spark, d, "label", "name", "fqn").where("label in ('Function', 'Class')")
    return n.where(F.lower("name").contains("merge") | F.lower("fqn").contains("merge")).orderBy("name", "id").limit(50).select("id", "name")


@query(f"with {sql_nodes('kind', 'name')} select id, name from cur where kind = 'method' and contains(name, 'queue') order by name, id limit 25")
def p_similar_names(spark, d):
    return current_nodes(spark, d, "kind", "name").where(F.expr("kind = 'method' and contains(name, 'queue')")).orderBy("name", "id").limit(25).select("id", "name")


@query(f"with {sql_nodes('kind', 'label', 'confidence')} select id, lower(trim(coalesce(nullif(kind, ''), label, ''))) as kind, case lower(coalesce(confidence, '')) when 'extracted' then 'EXTRACTED' when 'ambiguous' then 'AMBIGUOUS' else 'INFERRED' end as confidence from cur")
def p_contract(spark, d):
    c = F.lower(F.coalesce("confidence", F.lit("")))
    return current_nodes(spark, d, "kind", "label", "confidence").select("id", F.lower(F.trim(F.coalesce(F.nullif(F.col("kind"), F.lit("")), "label", F.lit("")))).alias("kind"), F.when(c == "extracted", "EXTRACTED").when(c == "ambiguous", "AMBIGUOUS").otherwise("INFERRED").alias("confidence"))


@query(f"with {sql_nodes('repo', 'file', 'label', 'start_line', 'end_line')}, l as (select distinct repo, file_path, unnest(added_lines) ln from chunks) select distinct cur.id from cur join l on l.repo = cur.repo and l.file_path = {_PATH.format(c='cur.file')} and ln between start_line and end_line where label in ('Function', 'Class')")
def p_node_modified(spark, d):
    """Definitions with an added line inside."""
    l = table(spark, d, "chunks").select("repo", F.col("file_path").alias("path"), F.explode("added_lines").alias("ln")).distinct()
    n = current_nodes(spark, d, "repo", "file", "label", "start_line", "end_line").where("label in ('Function', 'Class')").withColumn("path", tx.clean_path(F.col("file")))
    return n.join(l, ["repo", "path"]).where("ln between start_line and end_line").select("id").distinct()


@query(f"with {sql_nodes('label', 'docstring')} select id, docstring is null or docstring = '' as want_source from cur where label = 'Function'")
def p_want_source(spark, d):
    return current_nodes(spark, d, "label", "docstring").where("label = 'Function'").select("id", (F.col("docstring").isNull() | (F.col("docstring") == "")).alias("want_source"))


# joins


@query(f"with {_SQL_NAMES}, {_SQL_REFS}, c as (select rf.ref_id, nm.id, call_arity, param_count, max(case when call_arity = param_count then 1 else 0 end) over (partition by ref_id) hits from rf join nm using (repo, target)) select ref_id, id from c where hits = 0 or call_arity = param_count")
def j_arity(spark, d):
    """Candidates of a reference: those of its arity, if there is one."""
    c = _refs(spark, d).join(_names(spark, d).select("repo", "target", "id", "param_count"), ["repo", "target"])
    return rk.keep_if_any(c, ["ref_id"], F.col("call_arity") == F.col("param_count")).select("ref_id", "id")


@query(f"with {_SQL_NAMES}, {_SQL_REFS}, k as (select ref_id, repo, target from rf where contains(target, '.')), c as (select k.ref_id, cur.id from k join cur on cur.repo = k.repo and cur.name = regexp_extract(k.target, '[^.#]*$') where cur.fqn = k.target or ends_with(cur.fqn, '.' || k.target) or ends_with(k.target, '.' || cur.fqn)) select ref_id, count(*) as n, min(id) as first_id from c group by 1")
def j_qualified_theta(spark, d):
    """Qualified names against full names that end like them; the tail is the hash key."""
    k = _refs(spark, d).where(F.col("target").contains(".")).select("ref_id", "repo", "target", tx.tail_name(F.col("target")).alias("name"))
    n = current_nodes(spark, d, "repo", "name", "fqn")
    dot = lambda c: F.concat(F.lit("."), F.col(c))
    hit = k.join(n, ["repo", "name"]).where((F.col("fqn") == F.col("target")) | F.col("fqn").endswith(dot("target")) | F.col("target").endswith(dot("fqn")))
    return hit.groupBy("ref_id").agg(_N().alias("n"), F.min("id").alias("first_id"))


@query("with f as (select distinct repo, string_split(relpath, '/') s from files), p as (select repo, s, len(s) n from f) select x.repo, array_to_string(x.s, '/') as path, count(*) as n_like from p x join p y on x.repo = y.repo and x.n = y.n and list_has_all([true], list_transform(list_zip(x.s[1:x.n - 1], y.s[1:y.n - 1]), lambda z: z[1] = z[2])) group by 1, 2")
def j_endpoint_match(spark, d):
    """Paths of any length against the patterns of as many segments whose last one is a wildcard.

    A pattern is the path's prefix, so patterns are counted per prefix and no
    pairs of paths are made.
    """
    p = table(spark, d, "files").where("repo is not null and relpath is not null").select("repo", F.col("relpath").alias("path")).distinct()
    s = F.split("path", "/")
    p = p.select("repo", "path", F.size(s).alias("n"), F.array_join(F.slice(s, 1, F.size(s) - 1), "/").alias("prefix"))
    like = p.groupBy("repo", "n", "prefix").agg(_N().alias("n_like"))
    return p.join(like, ["repo", "n", "prefix"]).select("repo", "path", "n_like")


@query("with e as (select regexp_replace(lower(event_type), '[^a-z]+', '.', 'g') k, event_type, event_id, value from events), dim as (select k, min_by(event_type, event_id) as display from e group by 1) select k as event_key, display, count(*) as n, round(sum(value), 4) as total from e join dim using (k) group by 1, 2")
def j_dimension(spark, d):
    """Events with their dimension: the key, and the first spelling as display."""
    e = table(spark, d, "events").select(F.regexp_replace(F.lower("event_type"), "[^a-z]+", ".").alias("event_key"), "event_type", "event_id", "value")
    return e.groupBy("event_key").agg(F.min_by("event_type", "event_id").alias("display"), _N().alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"with {sql_nodes('repo', 'file', 'label', 'start_line', 'end_line')}, l as (select distinct repo, ref_file, ref_line from refs where ref_line is not null), h as (select l.*, id, row_number() over (partition by l.repo, ref_file, ref_line order by end_line - start_line, id) r from l join cur on cur.repo = l.repo and {_PATH.format(c='cur.file')} = {_PATH.format(c='l.ref_file')} and ref_line between start_line and end_line where label in ('Function', 'Class')) select repo, ref_file, ref_line, id from h where r = 1")
def j_interval_innermost(spark, d):
    """The innermost definition around each referring line."""
    l = table(spark, d, "refs").where("ref_line is not null").select("repo", "ref_file", "ref_line").distinct().withColumn("path", tx.clean_path(F.col("ref_file")))
    n = current_nodes(spark, d, "repo", "file", "label", "start_line", "end_line").where("label in ('Function', 'Class')").withColumn("path", tx.clean_path(F.col("file")))
    hit = l.join(n, ["repo", "path"]).where("ref_line between start_line and end_line")
    return hit.groupBy("repo", "ref_file", "ref_line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("s"), "id")).alias("x")).select("repo", "ref_file", "ref_line", F.col("x.id").alias("id"))


@query(f"with {sql_nodes('repo', 'file', 'label', 'start_line')}, l as (select distinct repo, ref_file, ref_line from refs where ref_line is not null), h as (select l.*, id, row_number() over (partition by l.repo, ref_file, ref_line order by ref_line - start_line, id) r from l join cur on cur.repo = l.repo and {_PATH.format(c='cur.file')} = {_PATH.format(c='l.ref_file')} and start_line <= ref_line where label = 'Function') select repo, ref_file, ref_line, id from h where r = 1")
def j_asof_fallback(spark, d):
    """The nearest function that begins at or above each referring line."""
    l = table(spark, d, "refs").where("ref_line is not null").select("repo", "ref_file", "ref_line").distinct()
    n = current_nodes(spark, d, "repo", "file", "label", "start_line").where("label = 'Function' and start_line is not null").withColumn("path", tx.clean_path(F.col("file")))
    # one sort instead of a range join: starts and lines in one sequence, the last start carried on
    both = n.groupBy("repo", "path", F.col("start_line").alias("at")).agg(F.min("id").alias("id")).select("repo", "path", "at", F.lit(0).alias("k"), "id", F.lit(None).cast("string").alias("ref_file")).unionByName(
        l.select("repo", tx.clean_path(F.col("ref_file")).alias("path"), F.col("ref_line").alias("at"), F.lit(1).alias("k"), F.lit(None).cast("string").alias("id"), "ref_file")
    )
    w = W.partitionBy("repo", "path").orderBy("at", "k").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("id", F.last("id", ignorenulls=True).over(w)).where("k = 1 and id is not null").select("repo", "ref_file", F.col("at").alias("ref_line"), "id")


@query("with a as (select distinct repo, relpath from files), r as (select distinct repo, ref_file from refs where ref_file is not null) select repo, ref_file from r where not exists (select 1 from a where a.repo = r.repo and a.relpath = regexp_replace(replace(r.ref_file, chr(92), '/'), '^(\\./|/)+', ''))")
def j_missing_symbol(spark, d):
    """Referring files that are not in the repository."""
    r = table(spark, d, "refs").where("ref_file is not null").select("repo", "ref_file").distinct().withColumn("relpath", tx.clean_path(F.col("ref_file")))
    return r.join(table(spark, d, "files").select("repo", "relpath").distinct(), ["repo", "relpath"], "left_anti").select("repo", "ref_file")


@query(f"with {sql_nodes('repo', 'package')}, i as (select distinct repo, split_part(import_fqn, '.', 1) p from refs where import_fqn is not null), h as (select distinct repo, split_part(package, '.', 1) p from cur where package is not null) select repo, p as package, 'undeclared' as status from i where not exists (select 1 from h where h.repo = i.repo and h.p = i.p) union all select repo, p, 'unused' from h where not exists (select 1 from i where h.repo = i.repo and h.p = i.p)")
def j_dependency_diff(spark, d):
    """Imported roots that a repository does not hold, and roots that nothing imports."""
    i = table(spark, d, "refs").where("import_fqn is not null").select("repo", F.split("import_fqn", r"\.")[0].alias("package")).distinct()
    h = current_nodes(spark, d, "repo", "package").where("package is not null").select("repo", F.split("package", r"\.")[0].alias("package")).distinct()
    k = ["repo", "package"]
    return i.join(h, k, "left_anti").withColumn("status", F.lit("undeclared")).unionByName(h.join(i, k, "left_anti").withColumn("status", F.lit("unused")))


@query(f"with {sql_nodes('name')}, c as (select distinct chunk_id, node_ids from chunks), x as (select chunk_id, unnest(node_ids) id, generate_subscripts(node_ids, 1) i from c) select chunk_id, string_agg(coalesce(name, '?'), ' > ' order by i) as names from x left join cur on cur.id = lower(trim(x.id)) group by chunk_id")
def j_ordered_lookup(spark, d):
    """Names of a chunk's definitions in their given order."""
    c = table(spark, d, "chunks").select("chunk_id", "node_ids").distinct().select("chunk_id", F.posexplode("node_ids").alias("i", "id")).select("chunk_id", "i", norm_id("id").alias("id"))
    j = c.join(current_nodes(spark, d, "name"), "id", "left")
    return j.groupBy("chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("name", F.lit("?")).alias("n")))), lambda s: s["n"]), " > ").alias("names"))


# text extraction


_CURRENT_TEXT = "(select repo, relpath, max_by(text, last_indexed) t from (select repo, relpath, text, last_indexed from files where text is not null) group by 1, 2)"


def _texts(spark, d):
    return table(spark, d, "files").where("text is not null").groupBy("repo", "relpath").agg(F.max_by("text", "last_indexed").alias("t"))


@query(f"with w as (select repo, relpath, unnest(regexp_extract_all(lower(t), '\\b(insert into|update|delete from|merge into)\\s+([a-z_][a-z0-9_]*)', 2)) tbl, 'WRITES' kind from {_CURRENT_TEXT} union all select repo, relpath, unnest(regexp_extract_all(lower(t), '\\b(from|join)\\s+([a-z_][a-z0-9_]*)', 2)), 'READS' from {_CURRENT_TEXT}) select distinct repo, relpath, kind, tbl from w")
def x_sql_usage(spark, d):
    """Tables that SQL in a file's text reads or writes."""
    low = F.lower("t")
    find = lambda rx, kind: _texts(spark, d).select("repo", "relpath", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(low, F.lit(rx), F.lit(2))).alias("tbl"))
    return find(r"\b(insert into|update|delete from|merge into)\s+([a-z_][a-z0-9_]*)", "WRITES").unionByName(find(r"\b(from|join)\s+([a-z_][a-z0-9_]*)", "READS")).distinct()


@query(f"with m as (select repo, relpath, unnest(regexp_extract_all(t, '(?m)^(?:from|import)\\s+([A-Za-z_]\\w*)', 1)) m from {_CURRENT_TEXT} where regexp_matches(relpath, '\\.pyi?$')) select repo, lower(replace(m, '_', '-')) as package, count(distinct relpath) as n_files from m group by 1, 2")
def x_imported_pkgs(spark, d):
    """Root packages that Python files import."""
    m = _texts(spark, d).where(F.col("relpath").rlike(r"\.pyi?$")).select("repo", "relpath", F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^(?:from|import)\s+([A-Za-z_]\w*)"), F.lit(1))).alias("m"))
    return m.groupBy("repo", F.lower(F.translate("m", "_", "-")).alias("package")).agg(F.count_distinct("relpath").alias("n_files"))


@query(f"with l as (select repo, relpath, unnest(string_split(t, chr(10))) l, generate_subscripts(string_split(t, chr(10)), 1) i from {_CURRENT_TEXT}) select repo, relpath, string_agg(l, chr(10) order by i) as block from l where starts_with(ltrim(l), 'import ') or starts_with(ltrim(l), 'from ') group by 1, 2")
def x_import_block(spark, d):
    """The import lines of each file."""
    lines = F.filter(F.split("t", "\n", -1), lambda l: F.ltrim(l).startswith("import ") | F.ltrim(l).startswith("from "))
    return _texts(spark, d).select("repo", "relpath", lines.alias("l")).where(F.size("l") > 0).select("repo", "relpath", F.array_join("l", "\n").alias("block"))


@query(f"with {sql_nodes('label', 'signature')} select id, left(regexp_replace(signature, '\\s+', ' ', 'g'), 240) as signature, regexp_extract(signature, '^[^(]*') as callee from cur where label = 'Function' and signature is not null")
def x_signature(spark, d):
    n = current_nodes(spark, d, "label", "signature").where("label = 'Function' and signature is not null")
    return n.select("id", F.substring(F.regexp_replace("signature", r"\s+", " "), 1, 240).alias("signature"), F.regexp_extract("signature", r"^[^(]*", 0).alias("callee"))


@query(f"with {sql_nodes('label', 'body_hash', 'repo')} select repo, body_hash, count(*) as n, min(id) as first_id from cur where label = 'Function' and body_hash is not null group by 1, 2")
def l_identity_cache(spark, d):
    """Functions of equal text, which share one description."""
    n = current_nodes(spark, d, "label", "body_hash", "repo").where("label = 'Function' and body_hash is not null")
    return n.groupBy("repo", "body_hash").agg(_N().alias("n"), F.min("id").alias("first_id"))


@query(f"with v as (select {sql_id('id')} id, body_hash, row_number() over (partition by {sql_id('id')} order by last_indexed desc, ord desc) r from nodes where label = 'Function') select a.id from v a left join v b on b.id = a.id and b.r = 2 where a.r = 1 and (b.id is null or a.body_hash is distinct from b.body_hash)")
def l_embed_targets(spark, d):
    """Functions to be embedded again: new ones, and those whose text changed."""
    w = W.partitionBy("id").orderBy(F.desc("last_indexed"), F.desc("ord"))
    v = table(spark, d, "nodes").where("label = 'Function'").select(norm_id("id").alias("id"), "body_hash", "last_indexed", "ord").withColumn("r", F.row_number().over(w)).where("r <= 2")
    a, b = v.where("r = 1").select("id", "body_hash"), v.where("r = 2").select("id", F.col("body_hash").alias("old"), F.lit(True).alias("known"))
    return a.join(b, "id", "left").where("known is null or not (body_hash <=> old)").select("id")
