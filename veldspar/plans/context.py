"""Context for a reader: pieces, budgets, tokens, prompts, changes between versions, imports of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions import text as tx
from veldspar.functions.keys import norm_id, trimmed
from veldspar.operators import graph
from veldspar.plans.graphs import calls, current_nodes, sql_calls, sql_id, sql_nodes
from veldspar.plans.register import Book
from veldspar.plans.review import _CHG, _CLEAN, _ND, changed, nodes
from veldspar.session import checkpointed
from veldspar.sources.tables import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

_N = lambda: F.count(F.lit(1))

# changes between the last two versions of a file

_VER = """ver as materialized (select repo, relpath, text, last_indexed, row_number() over (partition by repo, relpath order by last_indexed desc, text) r from (select distinct repo, relpath, text, last_indexed from files where text is not null)),
chd as materialized (select a.repo, a.relpath, list_filter(string_split(b.text, chr(10)), lambda l: not list_contains(string_split(a.text, chr(10)), l)) gone, list_filter(string_split(a.text, chr(10)), lambda l: not list_contains(string_split(b.text, chr(10)), l)) come from ver a join ver b on a.repo = b.repo and a.relpath = b.relpath and a.r = 1 and b.r = 2 where a.text <> b.text)"""


def version_changes(spark: SparkSession, d: str) -> DataFrame:
    """(repo, relpath, old, new, gone, come): the last two versions of a file, and the lines that only one has."""
    f = table(spark, d, "files").where("text is not null").select("repo", "relpath", "text", "last_indexed").distinct()
    again = f.groupBy("repo", "relpath").agg(_N().alias("n")).where("n > 1").select("repo", "relpath")
    w = W.partitionBy("repo", "relpath").orderBy(F.desc("last_indexed"), "text")
    v = f.join(again, ["repo", "relpath"], "left_semi").withColumn("r", F.row_number().over(w)).where("r <= 2")
    pair = v.groupBy("repo", "relpath").agg(F.max(F.when(F.col("r") == 1, F.col("text"))).alias("new"), F.max(F.when(F.col("r") == 2, F.col("text"))).alias("old")).where("new <> old")
    a, b = F.split("old", "\n", -1), F.split("new", "\n", -1)
    return pair.select("*", F.filter(a, lambda l: ~F.array_contains(b, l)).alias("gone"), F.filter(b, lambda l: ~F.array_contains(a, l)).alias("come"))


@query(f"with {_VER} select repo, relpath, len(gone) as n_removed, array_to_string(gone, chr(10)) as removed_text from chd")
def diff_removed_lines(spark, d):
    """Lines that a file's last version has no more."""
    return version_changes(spark, d).select("repo", "relpath", F.size("gone").alias("n_removed"), F.array_join("gone", "\n").alias("removed_text"))


@query()
def diff_parse(spark, d):
    """Unified diffs of the last two versions of each file, read back: added lines, removed text, new and deleted files."""
    from veldspar.operators import diffs

    v = version_changes(spark, d).select(F.concat_ws(":", "repo", "relpath").alias("diff_id"), "relpath", "old", "new")
    return diffs.file_diffs(diffs.unified(v)).select("diff_id", "path", "is_new", "is_deleted", F.array_join(F.transform("added_lines", lambda x: x.cast("string")), ",").alias("added_lines"), "removed_text")


_KEY1, _KEY2 = r"[\"'']([A-Za-z_]\w*)[\"'']\s*:", r"\[[\"'']([A-Za-z_]\w*)[\"'']\]"


def _sql_keys(c: str) -> str:
    return f"list_distinct(list_concat(regexp_extract_all(array_to_string({c}, chr(10)), '{_KEY1}', 1), regexp_extract_all(array_to_string({c}, chr(10)), '{_KEY2}', 1)))"


def _keys(c: str):
    t = F.array_join(c, "\n")
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(_KEY1.replace("''", "'")), F.lit(1)), F.regexp_extract_all(t, F.lit(_KEY2.replace("''", "'")), F.lit(1))))


@query(f"with {_VER} select repo, relpath, 'removed' as side, unnest({_sql_keys('gone')}) as field from chd union all select repo, relpath, 'added', unnest({_sql_keys('come')}) from chd")
def x_field_delta(spark, d):
    """Field keys in lines that a change removes and adds."""
    v = version_changes(spark, d)
    return v.select("repo", "relpath", F.lit("removed").alias("side"), F.explode(_keys("gone")).alias("field")).unionByName(v.select("repo", "relpath", F.lit("added").alias("side"), F.explode(_keys("come")).alias("field")))


@query(f"with {_VER} select distinct repo, unnest({_sql_keys('gone')}) as field from chd except select distinct repo, unnest({_sql_keys('come')}) from chd")
def u_except(spark, d):
    """Fields of a repository that changes remove and none adds."""
    v = version_changes(spark, d)
    return v.select("repo", F.explode(_keys("gone")).alias("field")).subtract(v.select("repo", F.explode(_keys("come")).alias("field")))


@query(f"with r as (select {sql_id('dst')} id from edges where upper(trim(type)) = 'READS'), p as (select {sql_id('dst')} id from edges where upper(trim(type)) in ('PASSES', 'REFERENCES', 'USES')) select id from r where id is not null intersect select id from p")
def u_intersect(spark, d):
    """What is both read and passed on."""
    return calls(spark, d, "READS").where("dst is not null").select(F.col("dst").alias("id")).intersect(calls(spark, d, "PASSES", "REFERENCES", "USES").select(F.col("dst").alias("id")))


_IDENT = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*[:=]"


@query(f"with {_VER}, k as (select repo, relpath, regexp_extract_all(array_to_string(gone, chr(10)), '{_IDENT}', 1) o, regexp_extract_all(array_to_string(come, chr(10)), '{_IDENT}', 1) n from chd), p as (select repo, relpath, x.o, i, n from (select repo, relpath, unnest(o) o, generate_subscripts(o, 1) i, n from k) x), q as (select repo, relpath, o, i, list_filter(n, lambda y: y <> o)[1] nn from p) select repo, relpath, arg_min(o, i) as old_name, arg_min(nn, i) as new_name from q where nn is not null group by 1, 2")
def f_rename_pair(spark, d):
    """The first pair of assigned names, one removed and one added, that differ."""
    find = lambda c: F.regexp_extract_all(F.array_join(c, "\n"), F.lit(_IDENT), F.lit(1))
    v = version_changes(spark, d).select("repo", "relpath", find("gone").alias("o"), find("come").alias("n"))
    pair = F.transform("o", lambda o: F.struct(o.alias("old_name"), F.get(F.filter("n", lambda y: y != o), 0).alias("new_name")))
    return v.select("repo", "relpath", F.get(F.filter(pair, lambda p: p["new_name"].isNotNull()), 0).alias("p")).where("p is not null").select("repo", "relpath", "p.old_name", "p.new_name")


# pieces and budgets

_PIECE = 1000


@query(
    f"""with recursive l as materialized (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null),
w(doc_id, i, used, chunk) as (select doc_id, i, length(t) + 1, 0 from l where i = 1 union all select l.doc_id, l.i, case when w.used + length(l.t) + 1 > {_PIECE} then length(l.t) + 1 else w.used + length(l.t) + 1 end, case when w.used + length(l.t) + 1 > {_PIECE} then w.chunk + 1 else w.chunk end from w join l on l.doc_id = w.doc_id and l.i = w.i + 1)
select w.doc_id, chunk, count(*) as n_lines, sum(length(t) + 1) as n_chars from w join l using (doc_id, i) group by 1, 2"""
)
def w_chunk_text(spark, d):
    """Texts split at line ends into pieces of at most 1,000 characters; a longer line stands alone."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.transform(F.split("text", "\n", -1), lambda l: F.length(l) + 1).alias("lens"))
    return t.select("doc_id", F.explode(greedy("lens", _PIECE)).alias("p")).select("doc_id", F.col("p.chunk").alias("chunk"), F.col("p.n").alias("n_lines"), F.col("p.used").alias("n_chars"))


def greedy(sizes: str, limit: int):
    """Array of (chunk, n, used): sizes in order, a new chunk where the limit would be passed."""
    last = F.struct(F.lit(-1).alias("chunk"), F.lit(0).alias("n"), F.lit(0).alias("used"))
    zero = F.struct(last.alias("at"), F.array().cast("array<struct<chunk:int,n:int,used:int>>").alias("out"))

    def step(acc, x):
        at = acc["at"]
        new = (at["chunk"] < 0) | (at["used"] + x > limit)
        fresh = F.struct((at["chunk"] + 1).alias("chunk"), F.lit(1).alias("n"), x.cast("int").alias("used"))
        more = F.struct(at["chunk"].alias("chunk"), (at["n"] + 1).alias("n"), (at["used"] + x).cast("int").alias("used"))
        return F.struct(F.when(new, fresh).otherwise(more).alias("at"), F.when(new & (at["chunk"] >= 0), F.concat(acc["out"], F.array(at))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, zero, step, lambda acc: F.concat(acc["out"], F.array(acc["at"])))


@query(
    f"""with recursive {_ND}, {sql_calls('CONTAINS', 'DEFINES').replace('calls as', 'own as')}, df as (select id, repo, file, start_line s, greatest(coalesce(end_line, start_line), start_line) e from nd where label in ('Function', 'Class') and file is not null and start_line > 0),
outer_ as materialized (select repo, file, s, e, id from df where id not in (select own.dst from own join df p on p.id = own.src join df c on c.id = own.dst where p.repo = c.repo and p.file = c.file and p.s <= c.s and c.e <= p.e and p.id <> c.id)),
sg as materialized (select *, row_number() over (partition by repo, file order by s, e, id) i, greatest(e - s + 1, 1) len from outer_),
w(repo, file, i, used, chunk) as (select repo, file, i, len, 0 from sg where i = 1 union all select sg.repo, sg.file, sg.i, case when w.used + sg.len > 200 then sg.len else w.used + sg.len end, case when w.used + sg.len > 200 then w.chunk + 1 else w.chunk end from w join sg on sg.repo = w.repo and sg.file = w.file and sg.i = w.i + 1)
select w.repo, w.file, chunk, count(*) as n_segments, sum(len) as n_lines from w join sg using (repo, file, i) group by 1, 2, 3"""
)
def w_file_chunks(spark, d):
    """Outermost definitions of a file packed into chunks of at most 200 lines; a longer one stands alone."""
    n = checkpointed(nodes(spark, d).where("label in ('Function', 'Class') and file is not null and start_line > 0").select("id", "repo", "file", F.col("start_line").alias("s"), F.greatest(F.coalesce("end_line", "start_line"), "start_line").alias("e")))
    own = graph.pairs(calls(spark, d, "CONTAINS", "DEFINES"))
    p = n.select(F.col("id").alias("src"), F.col("repo").alias("pr"), F.col("file").alias("pf"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    inner = n.join(own.withColumnRenamed("dst", "id"), "id").join(p, "src").where("pr = repo and pf = file and ps <= s and e <= pe and src <> id").select("id").distinct()
    segments = n.join(inner, "id", "left_anti").groupBy("repo", "file").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "e", "id"))), lambda x: F.greatest(x["e"] - x["s"] + 1, F.lit(1))).alias("lens"))
    return segments.select("repo", "file", F.explode(greedy("lens", 200)).alias("p")).select("repo", "file", F.col("p.chunk").alias("chunk"), F.col("p.n").alias("n_segments"), F.col("p.used").alias("n_lines"))


@query("with c as (select changed_node_id g, node_id, count(*) n, min(greatest(1, length(coalesce(source, '')) // 4)) cost from (select distinct * from callers) where node_id is not null group by 1, 2), r as (select *, sum(cost) over (partition by g order by n desc, node_id rows unbounded preceding) upto from c) select g as changed_node_id, node_id, cost, upto from r where upto <= 40")
def w_budget_pack(spark, d):
    """Callers of a change by their calls while their lines fit 40 tokens; the first misfit ends the group."""
    c = table(spark, d, "callers").distinct().where("node_id is not null").groupBy("changed_node_id", "node_id").agg(_N().alias("n"), F.min(F.greatest(F.lit(1), F.expr("length(coalesce(source, '')) div 4"))).alias("cost"))
    w = W.partitionBy("changed_node_id").orderBy(F.desc("n"), "node_id").rowsBetween(W.unboundedPreceding, 0)
    return c.withColumn("upto", F.sum("cost").over(w)).where("upto <= 40").select("changed_node_id", "node_id", "cost", "upto")


@query(f"with {_ND} select id, case when row_number() over (partition by repo, file, name order by start_line, id) > 1 then name || '@' || coalesce(start_line, 0) else name end as key from nd where label = 'Function' and name is not null")
def w_disambiguate(spark, d):
    """Names of functions as keys; a repeated one gets its line."""
    n = nodes(spark, d).where("label = 'Function' and name is not null")
    again = F.row_number().over(W.partitionBy("repo", "file", "name").orderBy("start_line", "id")) > 1
    return n.withColumn("again", again).select("id", F.when(F.col("again"), F.concat("name", F.lit("@"), F.coalesce("start_line", F.lit(0)).cast("string"))).otherwise(F.col("name")).alias("key"))


_TOK = f"""{_ND}, te as (select {sql_id('src')} src, {sql_id('dst')} dst, upper(trim(type)) ty, min(ord) o from edges where upper(trim(type)) in ('CALLS', 'EXPOSES', 'THROWS') group by 1, 2, 3),
tk as materialized (select te.src, 'c' || row_number() over (partition by te.src order by case ty when 'CALLS' then 0 when 'EXPOSES' then 1 else 2 end, o, te.dst) token, nd.id, case ty when 'CALLS' then 'Function' when 'EXPOSES' then 'Endpoint' else 'Class' end kind, coalesce(nd.name, '?') || case when ty = 'THROWS' then ' (raised)' else '' end label from te join nd on nd.id = te.dst where te.src is not null)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(src, token, id, kind, label): what a function may refer to, numbered: calls, then endpoints, then errors."""
    e = table(spark, d, "edges").select(norm_id("src").alias("src"), norm_id("dst").alias("id"), F.upper(trimmed("type")).alias("ty"), "ord").where("src is not null and ty in ('CALLS', 'EXPOSES', 'THROWS')").groupBy("src", "id", "ty").agg(F.min("ord").alias("o"))
    j = e.join(nodes(spark, d).select("id", "name"), "id")
    rank = F.when(F.col("ty") == "CALLS", 0).when(F.col("ty") == "EXPOSES", 1).otherwise(2)
    token = F.concat(F.lit("c"), F.row_number().over(W.partitionBy("src").orderBy(rank, "o", "id")).cast("string"))
    kind = F.when(F.col("ty") == "CALLS", "Function").when(F.col("ty") == "EXPOSES", "Endpoint").otherwise("Class")
    return j.select("src", token.alias("token"), "id", kind.alias("kind"), F.concat(F.coalesce("name", F.lit("?")), F.when(F.col("ty") == "THROWS", " (raised)").otherwise("")).alias("label"))


@query(f"with {_TOK} select src, token, id, kind, label from tk")
def w_tokens(spark, d):
    return tokens(spark, d)


@query(f"with {_TOK} select nd.id, 'Function: ' || coalesce(fqn, name) || chr(10) || 'Signature: ' || coalesce(signature, name) || coalesce(chr(10) || 'Docstring: ' || docstring, '') || chr(10) || coalesce(c.t, '(none)') as prompt from nd left join (select src, string_agg('[' || token || '] ' || kind || ' ' || label, chr(10) order by substr(token, 2)::int) t from tk group by 1) c on c.src = nd.id where label = 'Function' and name is not null".replace("where label = 'Function'", "where nd.label = 'Function'"))
def l_flows(spark, d):
    """The question put to a model for a function's steps: its facts and the tokens that it may refer to."""
    t = tokens(spark, d).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.expr("cast(substring(token, 2) as int)").alias("i"), F.concat(F.lit("["), "token", F.lit("] "), "kind", F.lit(" "), "label").alias("t")))).alias("t"))
    n = nodes(spark, d).where("label = 'Function' and name is not null").join(t, "id", "left")
    facts = F.coalesce(F.array_join(F.transform("t", lambda x: x["t"]), "\n"), F.lit("(none)"))
    return n.select("id", F.concat(F.lit("Function: "), F.coalesce("fqn", "name"), F.lit("\nSignature: "), F.coalesce("signature", "name"), F.coalesce(F.concat(F.lit("\nDocstring: "), "docstring"), F.lit("")), F.lit("\n"), facts).alias("prompt"))


@query(f"with {_CHG}, {sql_calls()}, dp as (select chg.id, nd.fqn, row_number() over (partition by chg.id order by nd.fqn, nd.id) r from chg join calls on calls.dst = chg.id join nd on nd.id = calls.src where nd.id <> chg.id) select chg.id as node_id, '## Changed: ' || coalesce(nd.fqn, nd.name) || ' (' || chg.change_type || ')' || coalesce(chr(10) || g.t, '') as prompt from chg join nd on nd.id = chg.id left join (select id, string_agg('- ' || coalesce(fqn, '?'), chr(10) order by r) t from dp where r <= 25 group by 1) g on g.id = chg.id")
def l_prompts(spark, d):
    """A prompt per changed definition with its dependents, 25 at most."""
    n, c = nodes(spark, d).select("id", "name", "fqn"), changed(spark, d)
    e = graph.pairs(calls(spark, d)).where("src <> dst").join(c.select(F.col("id").alias("dst")), "dst").join(n.select(F.col("id").alias("src"), "fqn"), "src")
    top = e.withColumn("r", F.row_number().over(W.partitionBy("dst").orderBy("fqn", "src"))).where("r <= 25").groupBy(F.col("dst").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.coalesce("fqn", F.lit("?")).alias("f")))), lambda x: F.concat(F.lit("- "), x["f"])), "\n").alias("t"))
    j = c.join(n, "id").join(top, "id", "left")
    return j.select(F.col("id").alias("node_id"), F.concat(F.lit("## Changed: "), F.coalesce("fqn", "name"), F.lit(" ("), "change_type", F.lit(")"), F.coalesce(F.concat(F.lit("\n"), "t"), F.lit(""))).alias("prompt"))


@query(f"with {_ND}, x as (select distinct changed_qualname q, {_CLEAN.format(c='changed_file')} f, {sql_id('node_id')} id from callers where changed_qualname is not null) select q, f as changed_file, regexp_extract(q, '[^.#]*$') as changed_fn, regexp_extract(q, '[^.#]*$') || ' -> ' || coalesce(min(nd.name), '(no immediate dependent found)') as chain from x left join nd on nd.id = x.id group by 1, 2")
def f_text_blocks(spark, d):
    """The parts of a change's key, and its shortest chain as text."""
    c = table(spark, d, "callers").where("changed_qualname is not null").select(F.col("changed_qualname").alias("q"), tx.clean_path(F.col("changed_file")).alias("changed_file"), norm_id("node_id").alias("id")).distinct()
    name = c.join(nodes(spark, d).select("id", "name"), "id", "left").groupBy("q", "changed_file").agg(F.min("name").alias("n"))
    fn = tx.tail_name(F.col("q"))
    return name.select("q", "changed_file", fn.alias("changed_fn"), F.concat(fn, F.lit(" -> "), F.coalesce("n", F.lit("(no immediate dependent found)"))).alias("chain"))


_DIM = 64


@query(f"with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) t from documents where text is not null), h as (select doc_id, ('0x' || substr(md5(t), 1, 4))::int % {_DIM} b, case when ('0x' || substr(md5(t), 5, 1))::int % 2 = 0 then 1 else -1 end s from w), v as (select doc_id, b, sum(s) x from h group by 1, 2) select doc_id, b as dim, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as value from v where x <> 0")
def l_embed(spark, d):
    """Feature-hashed vectors of length one, as (dimension, value): the embedder that needs no model."""
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("t"))
    hexes = lambda a, n: F.conv(F.substring(F.md5(F.col("t").cast("binary")), a, n), 16, 10).cast("int")
    h = w.select("doc_id", F.pmod(hexes(1, 4), F.lit(_DIM)).alias("dim"), F.when(F.pmod(hexes(5, 1), F.lit(2)) == 0, 1).otherwise(-1).alias("s"))
    v = h.groupBy("doc_id", "dim").agg(F.sum("s").alias("x")).where("x <> 0")
    norm = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))  # at most 64 rows a document
    return v.join(norm, "doc_id").select("doc_id", "dim", F.round(F.col("x") / F.col("n"), 6).alias("value"))


_QUESTION = ("palette", "session", "queue")


@query(f"with {_ND}, s as (select id, name, signature, docstring, {' + '.join(f'''(contains(lower(coalesce(name, '')), '{q}'))::int * 2 + (contains(lower(coalesce(docstring, '')), '{q}'))::int''' for q in _QUESTION)} score from nd where label = 'Function'), r as (select *, row_number() over (order by score desc, id) r from s where score > 0) select id, r as rank, case when r <= 3 then coalesce(signature, name) || coalesce(' -- ' || docstring, '') else name end as shown from r where r <= 8")
def l_context_pack(spark, d):
    """The eight functions nearest to a question: three with signature and docstring, the rest by name."""
    n = nodes(spark, d).where("label = 'Function'")
    has = lambda c, q: F.coalesce(F.lower(c).contains(q), F.lit(False)).cast("int")
    score = sum((has("name", q) * 2 + has("docstring", q) for q in _QUESTION), F.lit(0))
    top = n.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id").limit(8).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    full = F.concat(F.coalesce("signature", "name"), F.coalesce(F.concat(F.lit(" -- "), "docstring"), F.lit("")))
    return top.select("id", "rank", F.when(F.col("rank") <= 3, full).otherwise(F.col("name")).alias("shown"))


@query(f"with {sql_nodes('repo', 'component_role', 'label')}, {sql_calls()} select a.repo, coalesce(a.component_role, '-') as from_role, coalesce(b.component_role, '-') as to_role, count(*) as n from calls join cur a on a.id = calls.src join cur b on b.id = calls.dst where a.repo = b.repo group by 1, 2, 3")
def l_arch_det(spark, d):
    """Calls between the roles of a repository's components: the part of the architecture review that needs no model."""
    n = current_nodes(spark, d, "repo", "component_role").withColumn("component_role", F.coalesce("component_role", F.lit("-")))
    a, b = n.withColumnsRenamed({"id": "src", "component_role": "from_role"}), n.withColumnsRenamed({"id": "dst", "repo": "r2", "component_role": "to_role"})
    return graph.pairs(calls(spark, d)).join(a, "src").join(b, "dst").where("repo = r2").groupBy("repo", "from_role", "to_role").agg(_N().alias("n"))


@query(f"with {_ND}, {sql_calls()}, c as (select distinct chunk_id, lower(trim(unnest(node_ids))) id from chunks), h as (select dst id, count(*) n from calls group by 1) select c.chunk_id, count(*) as n_functions, sum(coalesce(h.n, 0)) as n_callers, string_agg(nd.name, ',' order by nd.start_line, nd.id) as names from c join nd on nd.id = c.id left join h on h.id = c.id where nd.label = 'Function' group by 1")
def l_chunks(spark, d):
    """What a reviewer of a chunk gets: its functions in order, and how many callers they have."""
    c = table(spark, d, "chunks").select("chunk_id", F.explode("node_ids").alias("id")).select("chunk_id", norm_id("id").alias("id")).distinct()
    h = graph.pairs(calls(spark, d)).groupBy(F.col("dst").alias("id")).agg(_N().alias("n"))
    j = c.join(nodes(spark, d).where("label = 'Function'").select("id", "name", "start_line"), "id").join(h, "id", "left")
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "id", "name"))), lambda x: x["name"]), ",")
    return j.groupBy("chunk_id").agg(_N().alias("n_functions"), F.sum(F.coalesce("n", F.lit(0))).alias("n_callers"), names.alias("names"))


@query(f"with {_ND}, {sql_calls()}, t as (select id from nd where name = 'queue' or fqn like '%.queue') select 'callers' as tool, t.id as key, calls.src as value from t join calls on calls.dst = t.id union all select 'callees', t.id, calls.dst from t join calls on calls.src = t.id union all select 'search', t.id, nd.fqn from t join nd using (id) union all select 'file', t.id, nd.file from t join nd using (id)")
def l_tools(spark, d):
    """What the tools of a reviewing agent answer for one name: callers, callees, search, file."""
    n = nodes(spark, d)
    t = n.where("name = 'queue' or fqn like '%.queue'").select("id", "fqn", "file")
    e = graph.pairs(calls(spark, d))
    ids = t.select("id")
    part = lambda tool, df, v: df.select(F.lit(tool).alias("tool"), F.col("id").alias("key"), F.col(v).alias("value"))
    return part("callers", e.join(ids.withColumnRenamed("id", "dst"), "dst").withColumnRenamed("dst", "id"), "src").unionByName(part("callees", e.join(ids.withColumnRenamed("id", "src"), "src").withColumnRenamed("src", "id"), "dst")).unionByName(part("search", t, "fqn")).unionByName(part("file", t, "file"))


# imports of files

_JS = r"(?:import|export)\b[^;\n]*?from\s+[''\"](\.[^''\"]+)[''\"]"
_CUR = "curf as materialized (select repo, relpath, max_by(text, last_indexed) t from (select repo, relpath, text, last_indexed from files where text is not null) group by 1, 2)"
_IMPORTS = f"""{_CUR}, im as (select distinct repo, relpath, unnest(regexp_extract_all(t, '{_JS}', 1)) spec from curf where regexp_matches(relpath, '\\.(m?js|m?ts)$')),
sg as (select *, string_split(spec, '/') s, list_filter(string_split(regexp_replace(relpath, '/?[^/]*$', ''), '/'), lambda x: x <> '') dir from im), up as (select *, len(list_filter(s, lambda x: x = '..')) n, list_filter(s, lambda x: x not in ('.', '..', '')) rest from sg),
base as (select repo, relpath, spec, array_to_string(list_concat(dir[1:greatest(len(dir) - n, 0)], rest), '/') b from up where n <= len(dir)),
cand as (select repo, relpath, spec, b || x.e c, x.i from base, (select unnest(['', '.ts', '.js', '.mjs', '.mts', '/index.ts', '/index.js']) e, unnest(range(7)) i) x), every as (select distinct repo, relpath p from files)"""


def import_paths(spark: SparkSession, d: str, exports: bool = False) -> DataFrame:
    """(repo, relpath, spec, target): relative imports of JS and TS files with the first file that the path may stand for."""
    f = table(spark, d, "files").where("text is not null and relpath rlike '[.](m?js|m?ts)$'").groupBy("repo", "relpath").agg(F.max_by("text", "last_indexed").alias("t"))
    rx = _JS.replace("''", "'") if not exports else _JS.replace("''", "'").replace("(?:import|export)", "export")
    im = f.select("repo", "relpath", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(rx), F.lit(1)))).alias("spec"))
    s = F.split("spec", "/")
    folder = F.filter(F.split(F.regexp_replace("relpath", r"/?[^/]*$", ""), "/"), lambda x: x != "")
    b = im.withColumn("dir", folder).withColumn("n", F.size(F.filter(s, lambda x: x == ".."))).withColumn("rest", F.filter(s, lambda x: ~x.isin(".", "..", ""))).where("n <= size(dir)")
    base = F.array_join(F.concat(F.slice("dir", F.lit(1), F.size("dir") - F.col("n")), "rest"), "/")
    c = b.select("repo", "relpath", "spec", F.posexplode(F.array(*[F.concat(base, F.lit(e)) for e in ("", ".ts", ".js", ".mjs", ".mts", "/index.ts", "/index.js")])).alias("i", "target"))
    every = table(spark, d, "files").select("repo", F.col("relpath").alias("target")).distinct()
    return c.join(every, ["repo", "target"]).groupBy("repo", "relpath", "spec").agg(F.min_by("target", "i").alias("target"))


@query(f"with {_IMPORTS} select cand.repo, cand.relpath, spec, arg_min(c, i) as target from cand join every on every.repo = cand.repo and p = c group by 1, 2, 3")
def x_import_paths(spark, d):
    """Relative imports resolved to files by trying extensions and index files in turn."""
    return import_paths(spark, d)


@query(f"with recursive {_IMPORTS}, lk as (select cand.repo, cand.relpath a, arg_min(c, i) b from cand join every on every.repo = cand.repo and p = c group by cand.repo, cand.relpath, spec), w(repo, a, b, d) as (select repo, a, b, 1 from lk union select w.repo, w.a, lk.b, d + 1 from w join lk on lk.repo = w.repo and lk.a = w.b where d < 2) select repo, a as relpath, b as reaches, min(d) as depth from w where a <> b group by 1, 2, 3")
def g_reexports(spark, d):
    """Files that a file reaches through imports and re-exports in two steps."""
    e = import_paths(spark, d).select("repo", "relpath", "target").distinct()
    key = lambda c: F.struct("repo", F.col(c).alias("f"))
    links = checkpointed(e.select(key("relpath").alias("src"), key("target").alias("dst")))
    far = graph.distances(links, links.select(F.col("src").alias("origin")).distinct(), 2).where("hops > 0 and origin <> node")
    return far.select("origin.repo", F.col("origin.f").alias("relpath"), F.col("node.f").alias("reaches"), F.col("hops").alias("depth"))


_FROM = r"(?m)^from\s+([A-Za-z_][\w.]*)\s+import\s+([A-Za-z_]\w*)"


@query(f"with {_CUR}, {_ND}, im as (select distinct repo, relpath, unnest(regexp_extract_all(t, '{_FROM}', 1)) m, unnest(regexp_extract_all(t, '{_FROM}', 2)) s from curf where regexp_matches(relpath, '\\.pyi?$')), md as (select distinct repo, relpath p, replace(regexp_replace(relpath, '\\.pyi?$', ''), '/', '.') m from files where regexp_matches(relpath, '\\.pyi?$')) select im.repo, im.relpath, im.m as module, s as symbol, case when min(md.p) is null then 'external' when count(nd.id) > 0 then 'found' else 'missing' end as status from im left join md on md.repo = im.repo and md.m = im.m left join nd on nd.repo = im.repo and nd.file = md.p and nd.name = s group by 1, 2, 3, 4")
def x_from_imports(spark, d):
    """Imported names: of a module outside, defined in the module's file, or missing there."""
    f = table(spark, d, "files").where("text is not null and relpath rlike '[.]pyi?$'").groupBy("repo", "relpath").agg(F.max_by("text", "last_indexed").alias("t"))
    both = F.arrays_zip(F.regexp_extract_all("t", F.lit(_FROM), F.lit(1)).alias("m"), F.regexp_extract_all("t", F.lit(_FROM), F.lit(2)).alias("s"))
    im = f.select("repo", "relpath", F.explode(both).alias("x")).select("repo", "relpath", F.col("x.m").alias("module"), F.col("x.s").alias("symbol")).distinct()
    md = table(spark, d, "files").where("relpath rlike '[.]pyi?$'").select("repo", F.col("relpath").alias("file"), F.translate(F.regexp_replace("relpath", r"\.pyi?$", ""), "/", ".").alias("module")).distinct()
    n = nodes(spark, d).where("file is not null and name is not null").select("repo", "file", F.col("name").alias("symbol"), "id")
    j = im.join(md, ["repo", "module"], "left").join(n, ["repo", "file", "symbol"], "left")
    return j.groupBy("repo", "relpath", "module", "symbol").agg(F.when(F.count("file") == 0, "external").when(F.count("id") > 0, "found").otherwise("missing").alias("status"))


@query(f"with {_ND}, oc as (select distinct repo, evidence_file f, evidence_line l, {sql_id('dst')} t from edges where upper(trim(type)) in ('CALLS', 'REFERENCES') and evidence_line > 0), hit as (select oc.t, oc.f, oc.l, arg_max(nd.id, (nd.start_line, nd.id)) s from oc join nd on nd.repo = oc.repo and nd.file = {_CLEAN.format(c='oc.f')} and oc.l between nd.start_line and nd.end_line where nd.label = 'Function' group by 1, 2, 3) select s as src, t as dst, min(l) as first_line, count(*) as n from hit where t in (select id from nd) and s <> t group by 1, 2")
def j_scip(spark, d):
    """Calls from an index of occurrences: each in the function that begins last before it and ends behind it."""
    e = table(spark, d, "edges").where(F.upper(trimmed("type")).isin("CALLS", "REFERENCES") & (F.col("evidence_line") > 0)).select("repo", "evidence_file", tx.clean_path(F.col("evidence_file")).alias("file"), F.col("evidence_line").alias("l"), norm_id("dst").alias("t")).distinct()
    n = checkpointed(nodes(spark, d).select("id", "repo", "file", "label", "start_line", "end_line"))
    hit = e.join(n.where("label = 'Function'").drop("label"), ["repo", "file"]).where("l between start_line and end_line").groupBy("t", "evidence_file", "l").agg(F.max(F.struct("start_line", "id"))["id"].alias("s"))
    return hit.join(n.select(F.col("id").alias("t")), "t").where("s <> t").groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.min("l").alias("first_line"), _N().alias("n"))


@query(f"with {_ND} select repo || ' ' || coalesce(fqn, name) || case when label = 'Function' then '().' when label = 'Class' then '#' else '/' end as symbol, file as document, start_line - 1 as line0, 1 as roles from nd where file is not null and start_line > 0 and name is not null")
def scip_symbols(spark, d):
    """Definitions as occurrences of symbols, lines from 0, role 1."""
    n = nodes(spark, d).where("file is not null and start_line > 0 and name is not null")
    mark = F.when(F.col("label") == "Function", "().").when(F.col("label") == "Class", "#").otherwise("/")
    return n.select(F.concat("repo", F.lit(" "), F.coalesce("fqn", "name"), mark).alias("symbol"), F.col("file").alias("document"), (F.col("start_line") - 1).alias("line0"), F.lit(1).alias("roles"))


@query("with p as (select distinct split_part(import_fqn, '.', 1) as package from refs where import_fqn is not null) select package, 'disabled' as status, 0 as n_advisories from p where package <> ''")
def src_osv_status(spark, d):
    """Imported packages with the advisories known for them; without a table of advisories the look-up is disabled."""
    from veldspar.sources.advisories import lookup

    return lookup(table(spark, d, "refs").where("import_fqn is not null").select(F.split("import_fqn", r"\.")[0].alias("package")), None)


@query("select distinct repo from files where repo is not null")
def src_github_pages(spark, d):
    """Repositories read page by page from saved answers of a paged service."""
    from veldspar.sources import paged

    return paged.read_saved(table(spark, d, "files").where("repo is not null").select("repo").distinct(), page_rows=2)


@query("select chunk_id, regexp_extract(dossier, '^[^\\n]*') as title, 'info' as severity from (select distinct chunk_id, dossier from chunks) where dossier is not null and dossier <> ''")
def l_stub(spark, d):
    """Answers of the provider that needs no model: each dossier's first line as a finding, through the JSON that a model would give."""
    from veldspar.operators import provider

    c = table(spark, d, "chunks").select("chunk_id", "dossier").distinct().where("dossier is not null and dossier <> ''")
    return provider.completed(c, "chunk_id", "dossier", provider.FirstLine()).select("chunk_id", "title", "severity")
