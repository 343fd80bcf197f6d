"""Extraction from source text: facts of the current version of every file of the data folder.

No SQL can say the same, so the facts are checked against a small corpus in
the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import extract, extract_braces, taint
from veldspar.operators.ranking import numbered_in_order
from veldspar.plans.register import Book
from veldspar.session import checkpointed
from veldspar.sources.tables import table

query = Book()
QUERIES, ORACLES = query.queries, query.oracles


def _current_facts(spark, d):
    """Facts of the latest version of every Python file; a null repository is ''."""
    f = table(spark, d, "files").where("relpath rlike '[.]pyi?$'")
    current = f.groupBy(F.coalesce("repo", F.lit("")).alias("repo"), "relpath").agg(F.max_by("text", F.struct("last_indexed", "text")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return extract.extract_python(current.repartition(n, "repo", "relpath"))


_FILE = ("repo", "relpath")


def facts_query(f):
    """Registers a function of facts and key columns over the current version of all files."""

    def whole(spark, d):
        return f(_current_facts(spark, d), *_FILE)

    whole.__name__, whole.__doc__ = f.__name__, f.__doc__
    query()(whole)
    return f


def _args():
    return F.array_join("args", ",").alias("args")


@facts_query
def x_python(f, *k):
    """Nodes of the corpus."""
    return f.where("fact = 'node'").select(*k, "type", "fqn", "line")


@facts_query
def x_metrics(f, *k):
    """Cyclomatic number, and branches, loops and lines, per function."""
    return f.where("fact = 'metric'").select(*k, F.col("src").alias("fqn"), F.col("arity").alias("cyclomatic"), F.array_join("args", ",").alias("counts"))


def _refs(f, *types):
    return f.where(F.col("type").isin(*types) & F.col("fact").isin("ref", "edge"))


@facts_query
def x_endpoints(f, *k):
    return _refs(f, "EXPOSES").select(*k, "src", "name")


@facts_query
def x_outbound_http(f, *k):
    return _refs(f, "CALLS_API").select(*k, "src", "name", "value")


@facts_query
def x_events(f, *k):
    return _refs(f, "EMITS_EVENT", "CONSUMES_EVENT").select(*k, "type", "src", "name", "value")


@facts_query
def x_auth(f, *k):
    return _refs(f, "REQUIRES_AUTH").select(*k, "src", "name", "value")


@facts_query
def x_locks(f, *k):
    return f.where("type = 'Field' and value = 'lock'").select(*k, "fqn")


@facts_query
def x_exceptions(f, *k):
    return _refs(f, "THROWS", "CATCHES").select(*k, "type", "src", "name")


@facts_query
def x_types(f, *k):
    return _refs(f, "PARAM_TYPE", "RETURN_TYPE", "HAS_GENERIC").select(*k, "type", "src", "name")


@facts_query
def x_params(f, *k):
    return f.where("fact = 'node' and type = 'Function'").select(*k, "fqn", "arity", _args())


@facts_query
def x_receivers(f, *k):
    """Calls on a receiver whose class is known, with their arity (-1: unknown)."""
    return _refs(f, "CALLS").where("value is not null").select(*k, "name", "value", "arity")


@facts_query
def x_imports(f, *k):
    return _refs(f, "IMPORTS").select(*k, "name", "fqn", "value")


@facts_query
def x_extends(f, *k):
    return _refs(f, "EXTENDS").select(*k, "src", "name")


@facts_query
def x_syntax_gate(f, *k):
    return f.where("fact = 'error'").select(*k[:1], "relpath", "line")


@facts_query
def g_taint(f, *k):
    """Parameters of endpoints that reach a sink, by a shortest path each."""
    return taint.taint(f)


@facts_query
def g_taint_paths(f, *k):
    """Every path of up to eight functions from an endpoint's parameter to a sink."""
    return taint.taint_paths(f)


@facts_query
def o_taint(f, *k):
    """The paths in order of class, source, sink and line."""
    order = [F.coalesce(c, F.lit("")) for c in ("sink_class", "source", "sink")]
    return numbered_in_order(taint.taint_paths(f), [*order, F.coalesce("line", F.lit(0)), F.col("repo"), F.col("param"), F.col("path")])


@facts_query
def g_field_taint(f, *k):
    """Fields that hold what came in through an endpoint and reach a sink."""
    return taint.field_taint(f)


@facts_query
def p_own_sinks(f, *k):
    return taint.own_sinks(f).select("repo", "fn", "sink_class", F.array_join(F.transform("params", lambda x: x.cast("string")), ",").alias("params"))


@facts_query
def p_has_sink_flow(f, *k):
    """Whether anything reaches a sink in a function."""
    hot = taint.passes(f).where("sink_class is not null").select("repo", "fn").distinct().withColumn("hot", F.lit(True))
    return taint.functions(f).select("repo", "fn").distinct().join(hot, ["repo", "fn"], "left").select("repo", "fn", F.coalesce("hot", F.lit(False)).alias("has_sink_flow"))


@facts_query
def p_sanitizer_candidates(f, *k):
    """Functions whose name hints at a sanitizer, and those that the callers of sinks call."""
    fns = taint.functions(f).select("repo", "fn", "name").distinct()
    sent = taint.passes(f)
    near = sent.where("sink_class is null").join(sent.where("sink_class is not null").select("repo", "fn").distinct(), ["repo", "fn"], "left_semi").select("repo", "name").distinct()
    return fns.where(F.col("name").rlike(taint.SANITIZER_HINT)).unionByName(fns.join(near, ["repo", "name"], "left_semi").select(*fns.columns)).distinct().select("repo", "fn")


@facts_query
def p_sanitizers(f, *k):
    """Parameters that a function cleans."""
    return taint.sanitizers(f)


@facts_query
def a_passes(f, *k):
    """What is passed from caller to callee, position by position."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return taint.passes_edges(f).select("repo", "src", "callee", text("positions"), text("from_params"), text("const_args"))


@facts_query
def p_sink_classify(f, *k):
    c = _refs(f, "CALLS").select(*k, "src", "name", taint.sink_class(F.col("name"), taint.receiver(F.col("fqn"))).alias("sink_class"))
    return c.where("sink_class is not null")


@facts_query
def j_arg_binding(f, *k):
    """Arguments bound to the parameters of the one function of that name."""
    f = checkpointed(f.where("(fact = 'node' and type = 'Function') or (fact = 'flow' and type = 'PASSES')"))
    defs = f.where("fact = 'node' and type = 'Function'").groupBy(*k[:1], "name").agg(F.count(F.lit(1)).alias("n"), F.max("fqn").alias("callee"), F.max_by("args", "fqn").alias("params")).where("n = 1")
    p = f.where("fact = 'flow' and type = 'PASSES'").select(*k, "src", "name", F.col("value").alias("slot"))
    return p.join(defs, [*k[:1], "name"]).select(*k, "src", "callee", "slot", F.when(F.col("slot").rlike("^[0-9]+$"), F.get("params", F.col("slot").cast("int"))).otherwise(F.col("slot")).alias("callee_param"))


@query()
def x_python_files(spark, d):
    """Facts of the current versions of all Python files, counted by kind."""
    f = table(spark, d, "files")
    last = f.groupBy("repo", "relpath").agg(F.max("last_indexed").alias("last_indexed"))
    current = f.join(last, ["repo", "relpath", "last_indexed"], "left_semi").dropDuplicates(["repo", "relpath"])
    return extract.extract_python(current).groupBy("repo", "fact", "type").agg(F.count(F.lit(1)).alias("n"))


def _state(spark, d, how):
    """Fields and globals that functions read and write; a field's owner is a class of the same file."""
    f = checkpointed(_current_facts(spark, d).where("type in ('READS', 'WRITES') or (fact = 'node' and type = 'Class')"))
    classes = f.where("fact = 'node'").select(*_FILE, F.col("fqn").alias("owner")).distinct()
    r = _refs(f, "READS", "WRITES").withColumn("owner", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1))
    return r.join(classes, [*_FILE, "owner"], how).select(*_FILE, "type", "src", "name")


@query()
def x_field_state(spark, d):
    """Fields of classes that their methods read and write."""
    return _state(spark, d, "left_semi")


@query()
def x_global_state(spark, d):
    return _state(spark, d, "left_anti")


@query()
def x_dataflow(spark, d):
    """Which parameters reach which arguments and results, in every function."""
    return _current_facts(spark, d).where("fact = 'flow'").select(*_FILE, "type", "src", "name", F.col("value").alias("slot"), _args())


def _brace_facts(spark, d, pattern):
    """Facts of the latest version of every file whose path matches; a null repository is ''."""
    f = table(spark, d, "files").where(F.col("relpath").rlike(pattern))
    current = f.groupBy(F.coalesce("repo", F.lit("")).alias("repo"), "relpath").agg(F.max_by("text", F.struct("last_indexed", "text")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return extract_braces.extract_braces(current.repartition(n, "repo", "relpath"))


_JAVA, _SCRIPTS, _BRACES = r"[.]java$", r"[.](m?js|m?ts|jsx|tsx)$", r"[.](java|m?js|m?ts|jsx|tsx)$"


@query()
def x_java(spark, d):
    """Nodes of all Java files."""
    return _brace_facts(spark, d, _JAVA).where("fact = 'node'").select(*_FILE, "type", "fqn", F.col("value").alias("kind"), "line", "end_line")


@query()
def x_js(spark, d):
    """Nodes of all JavaScript and TypeScript files."""
    return _brace_facts(spark, d, _SCRIPTS).where("fact = 'node'").select(*_FILE, "type", "fqn", F.col("value").alias("kind"), "line", "end_line")


@query()
def x_brace_refs(spark, d):
    """References of all Java, JavaScript and TypeScript files, by kind and name."""
    r = _brace_facts(spark, d, _BRACES).where("fact = 'ref'")
    return r.groupBy("repo", "type", "name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("relpath").alias("n_files"))


@query()
def x_brace_metrics(spark, d):
    """Cyclomatic number, and branches, loops and lines, per function of these languages."""
    return _brace_facts(spark, d, _BRACES).where("fact = 'metric'").select(*_FILE, F.col("src").alias("fqn"), "line", F.col("arity").alias("cyclomatic"), F.array_join("args", ",").alias("counts"))


@query()
def x_autowired(spark, d):
    """What is injected into Java classes: by marked fields, marked constructors, or the only constructor."""
    return _brace_facts(spark, d, _JAVA).where("type = 'AUTOWIRED'").select(*_FILE, "src", "name", F.col("value").alias("by"))


@query()
def x_fallback(spark, d):
    """What a scan by lines finds in files that do not parse."""
    return _brace_facts(spark, d, _BRACES).where("fact = 'error' or value = 'fallback'").select(*_FILE, "fact", "type", "fqn", "line")


def _kinds(facts):
    """Kinds of the plainer graph: routes, events, types, services, methods, variables."""
    kind = (
        F.when(F.col("type") == "Endpoint", "route").when(F.col("type").isin("EMITS_EVENT", "CONSUMES_EVENT"), "event").when(F.col("value").isin("interface", "type_alias", "enum"), F.col("value"))
        .when((F.col("type") == "Class") & F.col("name").rlike("(Service|Repository|Component)$"), "service").when((F.col("type") == "Class") & F.col("name").rlike("(Model|Table|Entity)$"), "table").when(F.col("type") == "Class", "class")
        .when((F.col("type") == "Function") & F.col("value").isin("method", "constructor"), "method").when(F.col("type") == "Function", "function").when((F.col("type") == "Field") & (F.col("value") == "module"), "variable").when(F.col("type") == "Field", "field").otherwise(F.lower("type"))
    )
    return facts.where("fact = 'node' or type in ('EMITS_EVENT', 'CONSUMES_EVENT')").groupBy("repo", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("relpath").alias("n_files"))


@query()
def x_nx_python(spark, d):
    return _kinds(_current_facts(spark, d))


@query()
def x_nx_generic(spark, d):
    return _kinds(_brace_facts(spark, d, _BRACES))
