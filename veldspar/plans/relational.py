"""Aggregations, windows, set operations, writes and predicates over the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions import text as tx
from veldspar.functions.keys import norm_id, trimmed
from veldspar.operators import ranking as rk
from veldspar.plans.graphs import calls, current_nodes, sql_id, sql_nodes
from veldspar.plans.register import Book
from veldspar.sources.tables import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

_N = lambda: F.count(F.lit(1))
_PATH = "regexp_replace(replace({c}, chr(92), '/'), '^(\\./|/)+', '')"
_RECORDS = "(select distinct ord, repo, file, line, title, message, category, subcategory, owning_fqn, severity, severity_label, severity_band, model_severity, source, blast_count, qualified_blast_count from findings)"


def _findings(spark, d):
    """One row per delivered record."""
    f = table(spark, d, "findings")
    return f.select("ord", "repo", "file", "line", "title", "message", "category", "subcategory", "owning_fqn", "severity", "severity_label", "severity_band", "model_severity", "source", "blast_count", "qualified_blast_count").distinct()


def _refs(spark, d):
    return table(spark, d, "refs").select("ref_id", "repo", "type", trimmed("target_name").alias("target"), norm_id("src").alias("src"), "call_arity", "ref_file", "ref_line", "recv", "import_fqn").distinct()


def _names(spark, d):
    """(repo, target, id): the names and full names of the current nodes."""
    n = current_nodes(spark, d, "repo", "name", "fqn", "file", "param_count", "label", "package")
    return n.withColumn("target", F.explode(F.array_distinct(F.array("name", "fqn"))))


_SQL_NAMES = sql_nodes("repo", "name", "fqn", "file", "param_count", "label", "package") + ", nm as (select distinct repo, x.t target, id, file, param_count, label, package from cur, lateral (select unnest([name, fqn]) t) x where x.t is not null)"
_SQL_REFS = f"rf as (select distinct ref_id, repo, type, nullif(trim(target_name, ' ' || chr(9)), '') target, {sql_id('src')} src, call_arity, ref_file, ref_line, recv, import_fqn from refs)"

# aggregations


@query(f"with {_SQL_NAMES}, {_SQL_REFS}, k as (select ref_id, type, count(nm.id) n from rf left join nm using (repo, target) group by 1, 2) select type, count(*) as total, count(*) filter (n = 1) as resolved, count(*) filter (n > 1) as ambiguous, count(*) filter (n = 0) as unresolved, round(100.0 * count(*) filter (n = 1) / count(*), 4) as pct from k group by 1")
def a_coverage(spark, d):
    """How many references find one, several or no node of their repository."""
    n = _names(spark, d).groupBy("repo", "target").agg(_N().alias("n"))
    k = _refs(spark, d).join(n, ["repo", "target"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    hit = lambda c: F.count_if(c)
    return k.groupBy("type").agg(_N().alias("total"), hit(F.col("n") == 1).alias("resolved"), hit(F.col("n") > 1).alias("ambiguous"), hit(F.col("n") == 0).alias("unresolved")).withColumn("pct", F.round(F.try_divide(F.col("resolved") * 100.0, F.col("total")), 4))


@query(
    f"""with {sql_nodes('start_line', 'end_line', 'label', 'cyclomatic')}, e as (select distinct ord, {sql_id('src')} s, {sql_id('dst')} t from edges)
select 'duplicate_ids' as "check", 'error' as severity, (select count(*) from (select id from nodes group by 1 having count(*) > 1)) as n
union all select 'dangling_edges', 'error', (select count(*) from e where s not in (select id from cur) or t is null or t not in (select id from cur))
union all select 'invalid_ranges', 'error', (select count(*) from cur where start_line > end_line or start_line < 1)
union all select 'functions_without_metrics', 'warning', (select count(*) from cur where label = 'Function' and cyclomatic is null)"""
)
def a_validate(spark, d):
    """Checks of the whole graph, one row each."""
    n = current_nodes(spark, d, "start_line", "end_line", "label", "cyclomatic")
    dup = table(spark, d, "nodes").groupBy("id").agg(_N().alias("c")).where("c > 1").agg(_N().alias("n"))
    e = table(spark, d, "edges").select("ord", norm_id("src").alias("src"), norm_id("dst").alias("dst")).distinct()
    ids = n.select("id", F.lit(1).alias("hit"))
    lost = e.join(ids.withColumnsRenamed({"id": "src", "hit": "a"}), "src", "left").join(ids.withColumnsRenamed({"id": "dst", "hit": "b"}), "dst", "left").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n"))
    rest = n.agg(F.count_if(F.expr("start_line > end_line or start_line < 1")).alias("r"), F.count_if(F.expr("label = 'Function' and cyclomatic is null")).alias("m"))
    row = lambda df, name, severity, c="n": df.select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col(c).alias("n"))
    return row(dup, "duplicate_ids", "error").unionByName(row(lost, "dangling_edges", "error")).unionByName(row(rest, "invalid_ranges", "error", "r")).unionByName(row(rest, "functions_without_metrics", "warning", "m"))


@query(f"with {sql_nodes('label', 'kind', 'component_role')} select label, kind, component_role as role, count(*) as n from cur group by 1, 2, 3")
def a_histogram(spark, d):
    return current_nodes(spark, d, "label", "kind", "component_role").groupBy("label", "kind", F.col("component_role").alias("role")).agg(_N().alias("n"))


@query(f"with {sql_nodes('label', 'repo')} select repo, count(*) filter (label = 'File') as n_files, count(*) filter (label in ('Function', 'Class')) as n_definitions from cur group by 1")
def a_file_def_counts(spark, d):
    return current_nodes(spark, d, "label", "repo").groupBy("repo").agg(F.count_if(F.expr("label = 'File'")).alias("n_files"), F.count_if(F.expr("label in ('Function', 'Class')")).alias("n_definitions"))


@query(f"with {sql_nodes('repo', 'label')} select repo, label, count(*) as n from cur group by 1, 2")
def a_repo_counts(spark, d):
    return current_nodes(spark, d, "repo", "label").groupBy("repo", "label").agg(_N().alias("n"))


@query(f"with b as (select unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) band), f as (select upper(trim(severity_label)) band, count(*) n from {_RECORDS} group by 1) select band, coalesce(n, 0) as n from b left join f using (band)")
def a_severity_counts(spark, d):
    """Findings per band, absent bands as 0."""
    bands = spark.createDataFrame([(b,) for b in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], "band string")
    f = _findings(spark, d).groupBy(F.upper(trimmed("severity_label")).alias("band")).agg(_N().alias("n"))
    return F.broadcast(bands).join(f, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""with t as (select distinct repo, file, subcategory k from {_RECORDS} where source = 'human_review'), a as (select distinct repo, file, subcategory k from {_RECORDS} where source = 'llm_judged'),
j as (select coalesce(t.repo, a.repo) repo, count(*) filter (t.k is not null and a.k is not null) tp, count(*) filter (t.k is null) fp, count(*) filter (a.k is null) fn from t full join a on t.repo = a.repo and t.file = a.file and t.k = a.k group by 1)
select repo, tp, fp, fn, round(case when tp + fp = 0 then 1 else tp / (tp + fp) end, 6) as prec, round(case when tp + fn = 0 then 1 else tp / (tp + fn) end, 6) as recall from j"""
)
def a_eval_metrics(spark, d):
    """Judged findings held against those of people, by file and kind."""
    f = _findings(spark, d).where("file is not null and repo is not null and subcategory is not null")
    key = ["repo", "file", "subcategory"]
    t = f.where("source = 'human_review'").select(*key).distinct().withColumn("t", F.lit(1))
    a = f.where("source = 'llm_judged'").select(*key).distinct().withColumn("a", F.lit(1))
    j = t.join(a, key, "full").groupBy("repo").agg(F.count_if(F.expr("t = 1 and a = 1")).alias("tp"), F.count_if(F.expr("t is null")).alias("fp"), F.count_if(F.expr("a is null")).alias("fn"))
    rate = lambda x: F.round(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(x)), F.lit(1.0)), 6)
    return j.select("repo", "tp", "fp", "fn", rate("fp").alias("prec"), rate("fn").alias("recall"))


@query(f"with f as (select {sql_id('dst')} id, count(*) n from edges where upper(trim(type)) = 'CALLS' group by 1) select id, n as n_callers, case when n >= 15 then 'high' when n >= 6 then 'medium' else 'low' end as band from f where id is not null")
def a_breakage(spark, d):
    n = F.col("n_callers")
    return calls(spark, d).where("dst is not null").groupBy(F.col("dst").alias("id")).agg(_N().alias("n_callers")).withColumn("band", F.when(n >= 15, "high").when(n >= 6, "medium").otherwise("low"))


@query(f"select (select count(distinct (repo, relpath)) from files) as n_files, (select count(distinct id) from nodes) as n_nodes, (select count(distinct ord) from edges) as n_edges, (select count(distinct ord) from findings) as n_findings")
def a_audit(spark, d):
    """Totals of a whole audit in one row."""
    one = lambda t, *c: table(spark, d, t).select(*c).distinct().agg(_N().alias("n"))
    out = None
    for name, df in (("n_files", one("files", "repo", "relpath")), ("n_nodes", one("nodes", "id")), ("n_edges", one("edges", "ord")), ("n_findings", one("findings", "ord"))):
        part = df.select(F.lit(name).alias("k"), "n")
        out = part if out is None else out.unionByName(part)
    return out.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("n_files", "n_nodes", "n_edges", "n_findings")])


@query("with roots as (select unnest(['io', 'core', 'api', 'service']) r), f as (select distinct repo, relpath from files) select repo, relpath, coalesce((select max(r) from roots where starts_with(relpath, r || '/')), split_part(relpath, '/', 1)) as module from f")
def a_module_key(spark, d):
    """The module of a file: the longest configured root, else its first segment."""
    roots = F.broadcast(spark.createDataFrame([(r,) for r in ("io", "core", "api", "service")], "r string"))
    f = table(spark, d, "files").select("repo", "relpath").distinct()
    hit = f.join(roots, F.col("relpath").startswith(F.concat("r", F.lit("/"))), "left").groupBy("repo", "relpath").agg(F.max_by("r", F.length("r")).alias("r"))
    return hit.select("repo", "relpath", F.coalesce("r", F.split("relpath", "/")[0]).alias("module"))


# windows and rankings


@query("select type, src, dst, min_by(ord, ord) as ord from (select distinct upper(trim(type)) type, lower(trim(src, ' ' || chr(9))) src, lower(trim(dst, ' ' || chr(9))) dst, ord from edges) group by 1, 2, 3 having src <> '' and dst <> ''")
def w_first_per_key(spark, d):
    """The first edge of each type between two nodes."""
    e = table(spark, d, "edges").select(F.upper(trimmed("type")).alias("type"), norm_id("src").alias("src"), norm_id("dst").alias("dst"), "ord").where("src is not null and dst is not null")
    return rk.first_per_key(e.withColumn("o", F.col("ord")), ["type", "src", "dst"], ["ord"]).drop("o")


@query(f"select repo, file, bucket, t as title, ord from (select repo, file, line // 5 bucket, lower(trim(title)) t, ord, row_number() over (partition by repo, file, line // 5, lower(trim(title)) order by case when severity is null or isnan(severity) then -1 else severity end desc, ord) r from {_RECORDS}) where r = 1")
def w_dedupe_bucket(spark, d):
    """Near-equal findings: the gravest of each file, five lines and title."""
    f = _findings(spark, d).select("repo", "file", F.floor(F.col("line") / 5).cast("int").alias("bucket"), F.lower(F.trim("title")).alias("title"), "ord", F.when(F.isnan("severity"), -1).otherwise(F.coalesce("severity", F.lit(-1))).alias("w"))
    return rk.first_per_key(f, ["repo", "file", "bucket", "title"], [-F.col("w"), F.col("ord")]).select("repo", "file", "bucket", "title", "ord")


_Q = "q as (select list_transform(embedding, lambda x: cast(x as double)) v from embeddings where vec_id = 0)"
_COS = "round(list_dot_product(list_transform(e.embedding, lambda x: cast(x as double)), q.v) / sqrt(list_dot_product(list_transform(e.embedding, lambda x: cast(x as double)), list_transform(e.embedding, lambda x: cast(x as double))) * list_dot_product(q.v, q.v)), 6)"
_VEC = f"(select vec_id, {_COS} score from embeddings e, q order by score desc, vec_id limit {{k}})"


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


@query(f"with {_Q} select * from {_VEC.format(k=8)}")
def w_vector_topk(spark, d):
    return rk.vector_topk(table(spark, d, "embeddings"), _query_vector(spark, d), 8)


@query(f"with {_Q} select e.vec_id, {_COS} as score from embeddings e, q where label = 3 and {_COS} > 0.1 order by score desc, e.vec_id limit 10")
def w_vector_filtered(spark, d):
    return rk.vector_topk(table(spark, d, "embeddings").where("label = 3"), _query_vector(spark, d), 10).where("score > 0.1")


_TERMS = ("merge", "retry", "dossier")
_KEY = "(select doc_id, (contains(lower(text), 'merge')::int + contains(lower(text), 'retry')::int + contains(lower(text), 'dossier')::int)::bigint score from documents where text is not null and (contains(lower(text), 'merge') or contains(lower(text), 'retry') or contains(lower(text), 'dossier')) order by score desc, doc_id limit {k})"


@query(f"select * from {_KEY.format(k=20)}")
def w_keyword_topk(spark, d):
    return rk.keyword_topk(table(spark, d, "documents"), _TERMS, 20, "doc_id", F.col("text"))


_RRF = f"with {_Q}, v as (select vec_id doc_id, row_number() over (order by score desc, vec_id) - 1 r from {_VEC.format(k=32)}), k as (select doc_id, row_number() over (order by score desc, doc_id) - 1 r from {_KEY.format(k=32)}), a as (select doc_id, r, 'vector' leg from v union all select doc_id, r, 'keyword' from k) select doc_id, round(sum(1.0::double / (60 + r)), 9) as rrf, string_agg(leg || '#' || (r + 1), ',' order by leg) as legs from a group by 1 order by rrf desc, doc_id limit 8"


@query(_RRF)
def w_rrf(spark, d):
    """Vector and keyword hits fused by reciprocal rank."""
    v = rk.vector_topk(table(spark, d, "embeddings"), _query_vector(spark, d), 32).withColumnRenamed("vec_id", "doc_id")
    k = rk.keyword_topk(table(spark, d, "documents"), _TERMS, 32, "doc_id", F.col("text"))
    return rk.reciprocal_rank_fusion({"vector": v, "keyword": k}, "doc_id", 8)


@query(f"with f as ({_RRF}) select f.doc_id, f.rrf, d.source, (length(d.text) // 4)::int as tokens from f join documents d using (doc_id)")
def l_ask(spark, d):
    """The fused hits with what a context pack needs of them."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.floor(F.length("text") / 4).cast("int").alias("tokens"))
    return F.broadcast(w_rrf(spark, d)).join(docs, "doc_id").select("doc_id", "rrf", "source", "tokens")


@query("with o as (select user_id, event_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over w <= 1800000000 then 0 else 1 end n from events window w as (partition by user_id order by ts, event_id)), s as (select user_id, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) s from o) select user_id, s as session, count(*) as n from s group by 1, 2")
def w_gap_sessions(spark, d):
    """Sessions of a user's events: a gap above half an hour begins a new one."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    at = F.expr("unix_micros(cast(ts as timestamp))")
    return rk.gap_sessions(e, ["user_id"], at, ["ts", "event_id"], 1_800_000_000).groupBy("user_id", "session").agg(_N().alias("n"))


@query("with l as (select chunk_id, unnest(list_sort(list_distinct(added_lines))) ln from (select distinct chunk_id, added_lines from chunks)), m as (select chunk_id, ln, case when ln - lag(ln) over (partition by chunk_id order by ln) <= 8 then 0 else 1 end n from l), s as (select chunk_id, ln, sum(n) over (partition by chunk_id order by ln) s from m) select chunk_id, min(ln) as first_line, max(ln) as last_line, count(*) as n from s group by chunk_id, s")
def w_line_groups(spark, d):
    """Added lines at most eight apart as one group."""
    l = table(spark, d, "chunks").select("chunk_id", "added_lines").distinct().select("chunk_id", F.explode("added_lines").alias("ln")).distinct()
    return rk.gap_sessions(l, ["chunk_id"], F.col("ln"), ["ln"], 8).groupBy("chunk_id", "session").agg(F.min("ln").alias("first_line"), F.max("ln").alias("last_line"), _N().alias("n")).drop("session")


@query("with d as (select doc_id, string_split(text, chr(10)) l from documents where text is not null), w as (select doc_id, l, unnest(range(0, len(l), 25)) s from d) select doc_id, s + 1 as first_line, least(s + 30, len(l)) as last_line, length(array_to_string(l[s + 1:s + 30], chr(10))) as n_chars from w where s = 0 or s + 5 < len(l)")
def w_sliding_chunks(spark, d):
    """Windows of thirty lines, five of them shared with the one before."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("l"))
    w = x.withColumn("s", F.explode(F.sequence(F.lit(0), F.size("l") - 1, F.lit(25)))).where("s = 0 or s + 5 < size(l)")
    return w.select("doc_id", (F.col("s") + 1).alias("first_line"), F.least(F.col("s") + 30, F.size("l")).alias("last_line"), F.length(F.array_join(F.slice("l", F.col("s") + 1, F.lit(30)), "\n")).alias("n_chars"))


@query(f"select repo, ord, rank, n_rest from (select repo, ord, row_number() over (partition by repo order by blast_count desc, ord) rank, greatest(count(*) over (partition by repo) - 5, 0) n_rest from {_RECORDS}) where rank <= 5")
def w_topn_rest(spark, d):
    return rk.top_with_rest(_findings(spark, d).select("repo", "ord", "blast_count"), ["repo"], [F.desc_nulls_last("blast_count"), F.col("ord")], 5).select("repo", "ord", "rank", "n_rest")


@query("with c as (select changed_node_id, node_id, count(*) n from (select distinct * from callers) group by 1, 2) select changed_node_id, node_id, n, rank, case when rank <= 4 then 'source' else 'signature' end as shows from (select *, row_number() over (partition by changed_node_id order by n desc, node_id) rank from c) where rank <= 12")
def w_caller_rank(spark, d):
    """Callers of a changed node by their calls: four with source, up to twelve by signature."""
    c = table(spark, d, "callers").distinct().groupBy("changed_node_id", "node_id").agg(_N().alias("n"))
    r = c.withColumn("rank", F.row_number().over(W.partitionBy("changed_node_id").orderBy(F.desc("n"), "node_id"))).where("rank <= 12")
    return r.withColumn("shows", F.when(F.col("rank") <= 4, "source").otherwise("signature"))


@query("with f as (select repo, relpath, max_by(text, last_indexed) x from (select repo, relpath, text, last_indexed from files where text is not null) group by 1, 2), l as (select repo, relpath, string_split(x, chr(10)) l from f), n as (select repo, relpath, l, unnest(range(1, len(l) + 1)) i from l) select repo, relpath, md5(string_agg(lpad(i::varchar, 5, ' ') || '  ' || l[i], chr(10) order by i)) as numbered from n group by 1, 2")
def w_number_lines(spark, d):
    """Hash of each current file with its lines numbered."""
    f = table(spark, d, "files").where("text is not null").groupBy("repo", "relpath").agg(F.max_by("text", "last_indexed").alias("x"))
    lines = F.transform(F.split("x", "\n", -1), lambda l, i: F.concat(F.lpad((i + 1).cast("string"), 5, " "), F.lit("  "), l))
    return f.select("repo", "relpath", F.md5(F.array_join(lines, "\n").cast("binary")).alias("numbered"))


@query(f"with {sql_nodes('repo', 'file', 'label', 'start_line', 'end_line')}, b as (select *, lead(start_line) over (partition by repo, {_PATH.format(c='file')} order by start_line, id) nx from cur where label in ('Function', 'Class') and file is not null and start_line is not null) select id, start_line, case when end_line - start_line < 4 then case when nx is null then start_line + 120 else greatest(start_line, nx - 1) end else end_line end as block_end from b")
def w_block_expand(spark, d):
    """The end of each definition's block; a short one reaches to the next definition."""
    n = current_nodes(spark, d, "repo", "file", "label", "start_line", "end_line").where("label in ('Function', 'Class') and file is not null and start_line is not null")
    nx = F.lead("start_line").over(W.partitionBy("repo", tx.clean_path(F.col("file"))).orderBy("start_line", "id"))
    return n.withColumn("nx", nx).select("id", "start_line", F.when(F.col("end_line") - F.col("start_line") < 4, F.when(F.col("nx").isNull(), F.col("start_line") + 120).otherwise(F.greatest(F.col("start_line"), F.col("nx") - 1))).otherwise(F.col("end_line")).alias("block_end"))


@query(
    f"""with recursive {sql_nodes('repo', 'file', 'label', 'start_line', 'end_line')}, f as (select repo, {_PATH.format(c='file')} file, id, start_line s, coalesce(end_line, start_line) e, row_number() over (partition by repo, {_PATH.format(c='file')} order by start_line, id) r from cur where label = 'Function' and file is not null and start_line is not null),
w(repo, file, id, r, base, chunk) as (select repo, file, id, r, s, 0 from f where r = 1 union all select f.repo, f.file, f.id, f.r, case when f.e - w.base + 1 > 150 then f.s else w.base end, case when f.e - w.base + 1 > 150 then w.chunk + 1 else w.chunk end from w join f on f.repo = w.repo and f.file = w.file and f.r = w.r + 1)
select repo, file, chunk, count(*) as n from w group by 1, 2, 3"""
)
def w_pack_functions(spark, d):
    """Whole functions packed into chunks of at most 150 lines, file by file."""
    n = current_nodes(spark, d, "repo", "file", "label", "start_line", "end_line").where("label = 'Function' and file is not null and start_line is not null")
    spans = n.groupBy("repo", tx.clean_path(F.col("file")).alias("file")).agg(F.sort_array(F.collect_list(F.struct(F.col("start_line").alias("s"), "id", F.coalesce("end_line", "start_line").alias("e")))).alias("a"))
    zero = F.struct(F.lit(0).alias("base"), F.lit(-1).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        new = (acc["chunk"] < 0) | (x["e"] - acc["base"] + 1 > 150)
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(F.when(new, x["s"]).otherwise(acc["base"]).alias("base"), chunk.alias("chunk"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return spans.select("repo", "file", F.explode(F.aggregate("a", zero, step)["out"]).alias("chunk")).groupBy("repo", "file", "chunk").agg(_N().alias("n"))


# sets and sorts


@query("select repo, file_path as path from chunks union select repo, file_path from file_reviews union select repo, relpath from files")
def u_union(spark, d):
    a, b, c = table(spark, d, "chunks"), table(spark, d, "file_reviews"), table(spark, d, "files")
    return a.select("repo", F.col("file_path").alias("path")).unionByName(b.select("repo", F.col("file_path").alias("path"))).unionByName(c.select("repo", F.col("relpath").alias("path"))).distinct()


@query(f"select repo, file, line, left(title, 40) as head, min(ord) as ord from {_RECORDS} group by 1, 2, 3, 4")
def u_title_dedupe(spark, d):
    f = _findings(spark, d).select("repo", "file", "line", F.substring("title", 1, 40).alias("head"), "ord")
    return f.groupBy("repo", "file", "line", "head").agg(F.min("ord").alias("ord"))


@query(f"select ord, row_number() over (order by case upper(trim(severity_label)) when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end, ord) as pos from {_RECORDS} order by pos limit 100")
def o_severity(spark, d):
    """The hundred gravest findings in order."""
    rank = F.expr("case upper(trim(severity_label)) when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end")
    top = _findings(spark, d).select("ord", rank.alias("k")).orderBy("k", "ord").limit(100)
    return top.select("ord", F.row_number().over(W.orderBy("k", "ord")).alias("pos"))


@query("with c as (select distinct * from callers) select node_id, min(coalesce(line, 0)) as first_line, string_agg(distinct file, ',' order by file) as files from c group by 1")
def o_dependents(spark, d):
    """Files and first line of each caller."""
    c = table(spark, d, "callers").select("node_id", "file", "line").distinct()
    return c.groupBy("node_id").agg(F.min(F.coalesce("line", F.lit(0))).alias("first_line"), F.array_join(F.sort_array(F.collect_set("file")), ",").alias("files"))


@query(f"select repo, file, count(*) as n, string_agg(ord::varchar, ',' order by ord) as ords from {_RECORDS} group by 1, 2")
def o_group_file(spark, d):
    return _findings(spark, d).groupBy("repo", "file").agg(_N().alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("ords"))
