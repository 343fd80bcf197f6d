"""Impact of changes, tolerant reading of JSON, DDL and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions import text as tx
from veldspar.functions.keys import norm_id, trimmed
from veldspar.operators import impact
from veldspar.plans.graphs import current_nodes, sql_id, sql_nodes
from veldspar.plans.register import Book
from veldspar.sources.tables import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles

_SCORE = "case confidence when 'EXTRACTED' then 1.0 when 'INFERRED' then 0.6 when 'AMBIGUOUS' then 0.2 else 0.6 end"


def _edges(spark, d):
    c = F.col("confidence")
    e = table(spark, d, "edges").where(F.upper(trimmed("type")).isin(*impact.WEIGHTS))
    return e.select(F.upper(trimmed("type")).alias("type"), norm_id("src").alias("src"), norm_id("dst").alias("dst"), F.when(c == "EXTRACTED", 1.0).when(c == "INFERRED", 0.6).when(c == "AMBIGUOUS", 0.2).otherwise(0.6).alias("score"))


def _tree(spark, d):
    changed = table(spark, d, "callers").select(norm_id("changed_node_id").alias("node")).distinct()
    return impact.impact_tree(_edges(spark, d), changed, 3)


_E = f"e as materialized (select {sql_id('src')} s, {sql_id('dst')} t, max(({_SCORE}, case upper(trim(type)) when 'CALLS' then 1.0 when 'EXTENDS' then 0.9 when 'INSTANTIATES' then 0.8 else 0.4 end)) k from edges where upper(trim(type)) in ('CALLS', 'EXTENDS', 'INSTANTIATES', 'IMPORTS') group by 1, 2 having s is not null and t is not null and s <> t)"
_L0 = f"select distinct {sql_id('changed_node_id')} n from callers where {sql_id('changed_node_id')} is not null"
_LEVEL = "(select s n, arg_min(t, (-k[1], -k[2], t)) p from e join {a} on t = {a}.n where s not in (select n from {seen}) group by 1)"
_TREE = f"""with {_E}, l0 as materialized ({_L0}), l1 as materialized {_LEVEL.format(a='l0', seen='l0')},
s1 as materialized (select n from l0 union all select n from l1), l2 as materialized {_LEVEL.format(a='l1', seen='s1')}, s2 as materialized (select n from s1 union all select n from l2), l3 as materialized {_LEVEL.format(a='l2', seen='s2')}
select n as node, null::varchar as parent, 0 as depth from l0 union all select n, p, 1 from l1 union all select n, p, 2 from l2 union all select n, p, 3 from l3"""


@query(_TREE.replace("k[1]", "struct_extract_at(k, 1)").replace("k[2]", "struct_extract_at(k, 2)"))
def g_impact_tree(spark, d):
    """What changed functions reach in three hops, with one parent each."""
    return _tree(spark, d).select("node", "parent", "depth")


@query()
def g_chain(spark, d):
    """Chains from a changed node to its consumers, by score, fifteen per change."""
    n = current_nodes(spark, d, "name", "file", "is_test", "route")
    how = table(spark, d, "callers").select(norm_id("changed_node_id").alias("origin"), "change_type").groupBy("origin").agg(F.max("change_type").alias("change_type"))
    t = _tree(spark, d).where("depth > 0").join(n.withColumnRenamed("id", "node"), "node", "left").join(how, "origin", "left")
    score = impact.chain_score(F.col("change_type"), F.col("depth"), F.col("name").rlike("(?i)auth|token|session"), F.col("route").isNotNull(), F.col("is_test"), F.lit(False), F.lit(False))
    from pyspark.sql import Window as W

    ranked = t.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy("origin").orderBy(F.desc("score"), "node"))).where("rank <= 15")
    return ranked.select("origin", "node", "rank", "score", F.array_join("path", " > ").alias("chain"))


_SENSITIVE = "regexp_matches(lower(coalesce(qualname, '')), 'auth|token|session')"


@query(f"select changed_node_id, node_id, line, (case when change_type in ('signature', 'added') then 3.0 else 1.0 end + greatest(0.0, 3.0 - coalesce(line, 0) % 4) + least(3.0, (coalesce(line, 0) % 4) * 0.5) + case when {_SENSITIVE} then 2.0 else 0.0 end - case when contains(coalesce(file, ''), 'test') then 2.0 else 0.0 end - case when coalesce(broken, false) then 2.0 else 0.0 end)::double as score from callers")
def f_chain_score(spark, d):
    """The score of each call of a changed function as a chain; its line stands for the depth."""
    c = table(spark, d, "callers")
    depth = F.pmod(F.coalesce("line", F.lit(0)), F.lit(4))
    score = impact.chain_score(F.col("change_type"), depth, F.lower(F.coalesce("qualname", F.lit(""))).rlike("auth|token|session"), F.lit(False), F.coalesce("file", F.lit("")).contains("test"), F.col("broken"), F.lit(False))
    return c.select("changed_node_id", "node_id", "line", score.cast("double").alias("score"))


@query("select distinct ord, title, line from findings where title is not null")
def src_json_extract(spark, d):
    """Findings read back out of a model's text: a fenced block, the whole text, or the outermost brackets."""
    f = table(spark, d, "findings").where("title is not null").select("ord", "title", "line").distinct()
    array = F.to_json(F.array(F.struct("title", "line")))
    how = F.pmod("ord", F.lit(3))
    t = f.select("ord", F.when(how == 0, F.concat(F.lit("Sure:\n```json\n"), array, F.lit("\n```\nbye"))).when(how == 1, array).otherwise(F.concat(F.lit("I found "), array, F.lit(" here"))).alias("t"))
    parsed = lambda c: F.from_json(c, "array<struct<title: string, line: string>>")
    fenced = F.regexp_extract("t", r"(?s)```(?:json)?\s*(\[.*\])\s*```", 1)
    inner = F.regexp_extract("t", r"(?s)(\[.*\])", 1)
    rows = t.select("ord", F.explode(F.coalesce(*[parsed(F.nullif(c, F.lit(""))) for c in (fenced, F.when(F.trim("t").startswith("["), F.col("t")), inner)])).alias("x"))
    return rows.select("ord", "x.title", F.expr("try_cast(x.line as int)").alias("line"))


@query(f"with {sql_nodes('repo', 'label', 'name', 'param_names')} select repo || '.' || name as tbl, id, unnest(param_names) as col, generate_subscripts(param_names, 1) as pos from cur where label = 'Function' and name is not null and len(param_names) > 0".replace("repo || '.'", "replace(repo, '-', '_') || '.'"))
def x_sql_ddl(spark, d):
    """Tables and columns of DDL scripts, one written for each function: schema, column, place; commas inside brackets do not separate."""
    n = current_nodes(spark, d, "repo", "label", "name", "param_names").where("label = 'Function' and name is not null and size(param_names) > 0")
    kinds = F.array(F.lit(" BIGINT NOT NULL"), F.lit(" DECIMAL(10, 2)"), F.lit(" INT REFERENCES users(id)"), F.lit(" varchar(40) default 'a'"))
    columns = F.array_join(F.transform("param_names", lambda p, i: F.concat(F.lit("  "), p, F.get(kinds, F.pmod(i, F.lit(4))))), ",\n")
    t = n.select("id", F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), F.translate("repo", "-", "_"), F.lit("."), "name", F.lit(" (\n"), columns, F.lit("\n);")).alias("t"))
    rx = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.$]+)\s*\(((?:[^()]|\([^()]*\))*)\)"
    body = t.select("id", F.regexp_extract("t", rx, 1).alias("tbl"), F.regexp_replace(F.regexp_extract("t", rx, 2), r"\([^()]*\)", "").alias("b"))
    cols = body.select("id", "tbl", F.posexplode(F.split("b", ",")).alias("i", "c"))
    return cols.select("tbl", "id", F.regexp_extract("c", r"^\s*(\S+)\s+(\w+)", 1).alias("col"), (F.col("i") + 1).alias("pos"))


@query("with p as (select distinct file as path from findings where file is not null union select distinct file from nodes where file is not null), c as (select path, regexp_replace(replace(path, chr(92), '/'), '^(\\./|/)+', '') c from p) select path, case when not regexp_matches(c, '(^|/)\\.\\.(/|$)') and not regexp_matches(c, '^[A-Za-z]:') and regexp_matches(c, '\\.(py|pyi|java|js|mjs|ts|mts|go|sql)$') then c end as safe from c")
def src_sanitize_path(spark, d):
    """Paths as upload names: no parent steps, drives or other extensions."""
    p = table(spark, d, "findings").select(F.col("file").alias("path")).unionByName(table(spark, d, "nodes").select(F.col("file").alias("path"))).where("path is not null").distinct()
    clean = tx.clean_path(F.col("path"))
    return p.select("path", F.when(~clean.rlike(r"(^|/)\.\.(/|$)") & ~clean.rlike("^[A-Za-z]:") & clean.rlike(r"\.(py|pyi|java|js|mjs|ts|mts|go|sql)$"), clean).alias("safe"))


@query("select repo, lower(replace(split_part(import_fqn, '.', 1), '_', '-')) as package from refs where import_fqn is not null and repo is not null group by 1, 2")
def src_requirements(spark, d):
    """Packages of a requirements file, one written for the imports of each repository."""
    roots = table(spark, d, "refs").where("import_fqn is not null and repo is not null").select("repo", F.split("import_fqn", r"\.")[0].alias("r")).distinct()
    line = F.concat("r", F.when(F.length("r") % 3 == 0, "==2.0 # web").when(F.length("r") % 3 == 1, "[extra]>=2").otherwise(" ; python_version > '3'"))
    t = roots.groupBy("repo").agg(F.concat(F.lit("# none\n\n-r other.txt\n"), F.array_join(F.collect_list(line), "\n")).alias("t"))
    lines = t.select("repo", F.explode(F.split("t", "\n")).alias("l")).select("repo", F.trim(F.regexp_replace("l", "#.*$", "")).alias("l")).where("l <> '' and l not like '-%'")
    return lines.select("repo", F.lower(F.translate(F.regexp_extract("l", r"^[A-Za-z0-9._-]+", 0), "_", "-")).alias("package")).distinct()

