"""Parameters and fields followed through calls to dangerous sinks.

``facts`` is what :mod:`veldspar.operators.extract` gives. Sources are the
parameters of endpoints and event consumers. A callee is looked up by its name
in the repository; functions of the caller's own file go before others.

A function is taken for a sanitizer of a parameter if its name says so, it
returns what it made of the parameter, and the parameter reaches none of its
own sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.operators.ranking import keep_if_any
from veldspar.session import checkpointed

# Classes of sinks in order of precedence, with the names of their calls in lower case.
SINKS = {
    "sql_injection": "execute executemany raw rawquery executescript executequery executeupdate executebatch executelargeupdate",
    "command_injection": "system popen call run spawn getoutput check_output check_call popen2 popen3 popen4 exec",
    "deserialization": "loads load unpickle yaml_load read_pickle",
    "path_traversal": "open sendfile send_file remove unlink rmtree extractall read_text write_text readlink",
    "eval_injection": "eval exec compile",
    "ssrf": "get post put delete request urlopen fetch",
    "template_injection": "render_template_string from_string",
    "xss": "mark_safe markup",
    "open_redirect": "redirect httpresponseredirect",
    "nosql_injection": "find find_one find_one_and_update find_one_and_delete aggregate update_many update_one delete_many delete_one insert_many",
    "ldap_injection": "search_s search bind_s",
    "xxe": "parse fromstring iterparse",
    "sensitive_data_exposure": "debug info warning warn error exception critical",
    "crypto_misuse": "encrypt decrypt new",
}
# The receivers that a class requires; "-" stands for none.
RECEIVERS = {
    "path_traversal": "os shutil - zipfile tarfile pathlib",
    "ssrf": "requests urllib http httpx aiohttp session",
    "nosql_injection": "collection db mongo mongodb client coll",
    "ldap_injection": "ldap conn connection server",
    "xxe": "etree lxml xml sax minidom elementtree",
    "sensitive_data_exposure": "logger log logging",
    "crypto_misuse": "cipher aes des rsa crypto cryptography",
}
# Parts of names that hint at a sanitizer.
SANITIZER_HINT = "(?i)(sanitiz|escape|clean|validate|quote|encode|strip_tags|whitelist|allowlist)"


def sink_class(name: Column, receiver: Column) -> Column:
    """The first class whose names hold the call and whose receivers, if any, hold the receiver."""
    low, recv = F.lower(name), F.lower(F.coalesce(receiver, F.lit("")))
    out = None
    for kind, names in SINKS.items():
        hit = low.isin(*names.split())
        if kind in RECEIVERS:
            hit = hit & recv.isin(*["" if r == "-" else r for r in RECEIVERS[kind].split()])
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def receiver(dotted: Column) -> Column:
    parts = F.split(dotted, r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def functions(facts: DataFrame) -> DataFrame:
    """(repo, relpath, fn, name, params)."""
    return facts.where("fact = 'node' and type = 'Function'").select("repo", "relpath", F.col("fqn").alias("fn"), "name", F.col("args").alias("params"))


def passes(facts: DataFrame) -> DataFrame:
    """(repo, relpath, fn, name, slot, line, origin, sink_class): what reaches the arguments of calls, a row per origin."""
    f = facts.where("fact = 'flow' and type = 'PASSES'")
    return f.select("repo", "relpath", F.col("src").alias("fn"), "name", F.col("value").alias("slot"), "line", F.explode("args").alias("origin"), sink_class(F.col("name"), receiver(F.col("fqn"))).alias("sink_class"))


def own_sinks(facts: DataFrame) -> DataFrame:
    """(repo, fn, sink_class, params): the parameters that reach a sink in the function itself."""
    p = passes(facts).where("sink_class is not null and origin rlike '^[0-9]+$'")
    return p.groupBy("repo", "fn", "sink_class").agg(F.sort_array(F.collect_set(F.col("origin").cast("int"))).alias("params"))


def sanitizers(facts: DataFrame) -> DataFrame:
    """(repo, fn, p): parameters that a function cleans."""
    back = facts.where("fact = 'flow' and type = 'RETURNS'").select("repo", F.col("src").alias("fn"), F.explode("args").alias("o")).where("o rlike '^[0-9]+$'").select("repo", "fn", F.col("o").cast("int").alias("p")).distinct()
    named = functions(facts).where(F.col("name").rlike(SANITIZER_HINT)).select("repo", "fn").distinct()
    bad = own_sinks(facts).select("repo", "fn", F.explode("params").alias("p")).distinct()
    return back.join(named, ["repo", "fn"], "left_semi").join(bad, ["repo", "fn", "p"], "left_anti")


def steps(facts: DataFrame) -> DataFrame:
    """(repo, fn, origin, callee, p): an origin in ``fn`` becomes parameter ``p`` of ``callee``."""
    defs = functions(facts).withColumnsRenamed({"fn": "callee", "relpath": "there"})
    sent = passes(facts).where("sink_class is null").select("repo", "relpath", "fn", "name", "slot", "origin").distinct()
    found = keep_if_any(sent.join(defs, ["repo", "name"]), ["repo", "fn", "name", "slot", "origin"], F.col("there") == F.col("relpath"))
    at = F.when(F.col("slot").rlike("^[0-9]+$"), F.col("slot").cast("int")).otherwise(F.array_position("params", F.col("slot")).cast("int") - 1)
    return found.select("repo", "fn", "origin", "callee", at.alias("p"), F.size("params").alias("n")).where("p >= 0 and p < n").select("repo", "fn", "origin", "callee", "p").distinct()


def sources(facts: DataFrame) -> DataFrame:
    """(repo, source, param, p): parameters of endpoints and event consumers."""
    entry = facts.where("(fact = 'edge' and type = 'EXPOSES') or (fact = 'ref' and type = 'CONSUMES_EVENT')").select("repo", F.col("src").alias("fn")).distinct()
    return functions(facts).join(entry, ["repo", "fn"], "left_semi").select("repo", F.col("fn").alias("source"), F.posexplode("params").alias("p", "param"))


def _needed(facts: DataFrame) -> DataFrame:
    return checkpointed(facts.where("fact = 'flow' or (fact = 'node' and type = 'Function') or (fact = 'edge' and type = 'EXPOSES') or (fact = 'ref' and type = 'CONSUMES_EVENT')"))


def _hits(reached: DataFrame, sent: DataFrame) -> DataFrame:
    sinks = sent.where("sink_class is not null").select("repo", "fn", "origin", F.col("name").alias("sink"), "sink_class", "line")
    return reached.withColumn("origin", F.col("p").cast("string")).join(sinks, ["repo", "fn", "origin"])


def taint(facts: DataFrame) -> DataFrame:
    """(repo, source, param, sink, sink_class, line, path, hops, sanitized): parameters that reach a sink.

    A shortest path for each; the search keeps what a source has reached, so
    it ends without a bound on hops. It goes on through sanitizers, and says so.
    """
    facts = _needed(facts)
    sent, step, clean = checkpointed(passes(facts)), checkpointed(steps(facts)), checkpointed(sanitizers(facts).withColumn("_clean", F.lit(True)))
    key = ["repo", "source", "param", "fn", "p"]
    seen = front = checkpointed(sources(facts).select("repo", "source", "param", F.col("source").alias("fn"), "p", F.array("source").alias("path"), F.lit(False).alias("sanitized")))
    while not front.isEmpty():
        went = front.withColumn("origin", F.col("p").cast("string")).drop("p").join(step, ["repo", "fn", "origin"]).select("repo", "source", "param", F.col("callee").alias("fn"), "p", F.concat("path", F.array("callee")).alias("path"), "sanitized")
        marked = went.join(clean, ["repo", "fn", "p"], "left").withColumn("sanitized", F.col("sanitized") | F.coalesce("_clean", F.lit(False))).drop("_clean")
        best = marked.groupBy(*key).agg(F.min(F.struct("sanitized", "path")).alias("b")).select(*key, "b.path", "b.sanitized")
        front = checkpointed(best.join(seen.select(*key), key, "left_anti").select(*seen.columns))
        seen = seen.unionByName(front)
    return _hits(seen, sent).select("repo", "source", "param", "sink", "sink_class", "line", F.array_join("path", " > ").alias("path"), F.size("path").alias("hops"), "sanitized").distinct()


def taint_paths(facts: DataFrame, max_hops: int = 8) -> DataFrame:
    """As :func:`taint`, but every simple path of up to ``max_hops`` functions, sanitized ones too."""
    facts = _needed(facts)
    sent, step, clean = checkpointed(passes(facts)), checkpointed(steps(facts)), checkpointed(sanitizers(facts).withColumn("_clean", F.lit(True)))
    front = checkpointed(sources(facts).select("repo", "source", "param", F.col("source").alias("fn"), "p", F.array("source").alias("path"), F.lit(False).alias("sanitized")))
    out = None
    for _ in range(max_hops):
        part = _hits(front, sent).select("repo", "source", "param", "sink", "sink_class", "line", F.array_join("path", " > ").alias("path"), F.size("path").alias("hops"), "sanitized")
        out = part if out is None else out.unionByName(part)
        went = front.withColumn("origin", F.col("p").cast("string")).drop("p").join(step, ["repo", "fn", "origin"]).where(~F.array_contains("path", F.col("callee"))).select("repo", "source", "param", F.col("callee").alias("fn"), "p", F.concat("path", F.array("callee")).alias("path"), "sanitized")
        front = checkpointed(went.join(clean, ["repo", "fn", "p"], "left").withColumn("sanitized", F.col("sanitized") | F.coalesce("_clean", F.lit(False))).drop("_clean").distinct())
        if front.isEmpty():
            break
    return out.distinct()


def field_taint(facts: DataFrame) -> DataFrame:
    """(repo, field, fn, sink, sink_class, line): fields that hold a source's value and reach a sink.

    Parameters taint fields, fields taint other fields and parameters, until
    neither set grows.
    """
    facts = _needed(facts)
    sent, step = checkpointed(passes(facts)), checkpointed(steps(facts))
    writes = checkpointed(facts.where("fact = 'flow' and type = 'FIELD_WRITE'").select("repo", F.col("src").alias("fn"), F.col("name").alias("field"), F.explode("args").alias("origin")))
    # an origin in a function: a parameter there, or a field, which is the same everywhere
    seen = front = checkpointed(sources(facts).select("repo", F.col("source").alias("fn"), F.col("p").cast("string").alias("origin")).distinct())
    anywhere = checkpointed(sent.select("repo", "fn", "origin").unionByName(writes.select("repo", "fn", "origin")).where("origin not rlike '^[0-9]+$'").distinct())
    while not front.isEmpty():
        into = front.join(step, ["repo", "fn", "origin"]).select("repo", F.col("callee").alias("fn"), F.col("p").cast("string").alias("origin"))
        fields = front.join(writes, ["repo", "fn", "origin"]).select("repo", F.col("field").alias("origin")).distinct()
        new = into.unionByName(fields.join(anywhere, ["repo", "origin"]).select("repo", "fn", "origin")).distinct()
        front = checkpointed(new.join(seen, ["repo", "fn", "origin"], "left_anti"))
        seen = seen.unionByName(front)
    hits = sent.where("sink_class is not null and origin not rlike '^[0-9]+$'").join(seen, ["repo", "fn", "origin"], "left_semi")
    return hits.select("repo", F.col("origin").alias("field"), "fn", F.col("name").alias("sink"), "sink_class", "line").distinct()


def passes_edges(facts: DataFrame) -> DataFrame:
    """(repo, src, callee, positions, from_params, const_args): one row per caller and callee, in order of the calls.

    ``from_params`` has the least parameter that reaches the argument, or -1;
    ``const_args`` the positions at which every argument is a literal.
    """
    f = facts.where("fact = 'flow' and type = 'PASSES'").select("repo", F.col("src"), F.col("name").alias("callee"), F.col("value").alias("slot"), "line", F.col("arity").alias("literal"), "args")
    least = F.array_min(F.transform(F.filter("args", lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int")))
    rows = f.withColumn("p", F.when(F.col("slot").rlike("^[0-9]+$"), F.col("slot").cast("int")).otherwise(-1)).withColumn("q", F.coalesce(least, F.lit(-1)))
    const = rows.groupBy("repo", "src", "callee", "p").agg(F.min("literal").alias("all")).where("all = 1 and p >= 0").groupBy("repo", "src", "callee").agg(F.sort_array(F.collect_set("p")).alias("const_args"))
    flows = rows.groupBy("repo", "src", "callee").agg(F.sort_array(F.collect_list(F.struct("line", (F.col("p") < 0).alias("named"), "p", "slot", "q"))).alias("x"))
    out = flows.join(const, ["repo", "src", "callee"], "left")
    return out.select("repo", "src", "callee", F.transform("x", lambda v: v["p"]).alias("positions"), F.transform("x", lambda v: v["q"]).alias("from_params"), F.coalesce("const_args", F.array().cast("array<int>")).alias("const_args"))
