"""References resolved to definitions by scope, imports, packages and receivers.

Candidates are joined by name within a repository; what tells them apart is
joined to them as columns, so that every cascade is one ranking per reference
(:func:`veldspar.operators.ranking.cascade`).

``nodes`` is (id, repo, label, name, fqn, file, package, kind, param_count),
one row per id, with clean paths; ``parents`` (child, parent), one row per
child; ``refs`` (ref_id, type, repo, src, target, recv, recv_type, import_fqn,
kind_hint, ref_file, call_arity), one row per reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.text import tail_name
from veldspar.operators.ranking import cascade, keep_if_any
from veldspar.session import checkpointed


def import_scope(refs: DataFrame) -> DataFrame:
    """(repo, f, fqns, simples, wilds): what each file imports, by full name, tail and wildcard package."""
    i = refs.where("type = 'IMPORTS' and ref_file is not null")
    wild = F.coalesce(F.col("kind_hint") == "import_wildcard", F.lit(False))
    return i.groupBy("repo", F.col("ref_file").alias("f")).agg(
        F.collect_set(F.when(~wild, F.col("import_fqn"))).alias("fqns"), F.collect_set(F.when(~wild, tail_name(F.col("target")))).alias("simples"), F.collect_set(F.when(wild, F.col("import_fqn"))).alias("wilds")
    )


def owner_name(fqn: Column, name: Column) -> Column:
    """The full name without its last part, where that is the name; else empty."""
    return F.when(fqn.endswith(F.concat(F.lit("."), name)), F.expr("left(fqn, length(fqn) - length(name) - 1)")).otherwise("")


def _qualified(fqn: Column) -> Column:
    """Whether the name is an import of the file, below one, or ends like one."""
    return F.exists("fqns", lambda x: (fqn == x) | fqn.startswith(F.concat(x, F.lit("."))) | fqn.endswith(F.concat(F.lit("."), x)))


def scoped(refs: DataFrame, nodes: DataFrame, scope: DataFrame, parents: DataFrame) -> DataFrame:
    """``refs`` with the file, package, parent and imports of their source."""
    package = nodes.where("label = 'File' and file is not null").groupBy("repo", F.col("file").alias("src_file")).agg(F.max("package").alias("src_package"))
    src = nodes.select(F.col("id").alias("src"), F.col("file").alias("src_file")).join(parents.select(F.col("child").alias("src"), F.col("parent").alias("src_parent")), "src", "left")
    out = refs.join(src, "src", "left").join(package, ["repo", "src_file"], "left").join(scope.withColumnRenamed("f", "src_file"), ["repo", "src_file"], "left")
    return out


def visible(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of the classes of one name those that the source sees first: ``rows`` has the class as fqn, name, file."""
    in_file = F.col("src_file").isNotNull()
    package = owner_name(F.col("fqn"), F.col("name"))
    size = F.count(F.lit(1)).over(_by(key))
    return cascade(
        rows.withColumn("_size", size), key,
        [
            ("unique", F.col("_size") == 1), ("same_file", in_file & (F.col("file") == F.col("src_file"))), ("imports_qualified_exact", F.array_contains("fqns", F.col("fqn"))), ("imports_qualified", _qualified(F.col("fqn"))),
            ("same_package", (F.col("src_package") != "") & (package == F.col("src_package"))), ("imports_wildcard", F.array_contains("wilds", package)), ("imports", F.array_contains("simples", F.col("name"))), ("name", F.lit(True)),
        ],
    ).drop("_size")


def _by(key: list[str]):
    from pyspark.sql import Window as W

    return W.partitionBy(*key)


def nearest_above(parents: DataFrame, marks: DataFrame) -> DataFrame:
    """(child, above): the nearest node above each child that is one of ``marks`` (node).

    A climb ends at a mark, at a top, or where it comes back to a node it left.
    """
    step = checkpointed(parents.join(marks.select(F.col("node").alias("parent"), F.lit(True).alias("hit")), "parent", "left").select(F.col("child").alias("_at"), F.col("parent").alias("_up"), F.coalesce("hit", F.lit(False)).alias("hit")))
    front = step.select(F.col("_at").alias("child"), F.col("_up").alias("at"), "hit", F.array("_at").alias("path"))
    out = None
    while True:
        front = checkpointed(front)
        found = front.where("hit").select("child", F.col("at").alias("above"))
        out = found if out is None else out.unionByName(found)
        rest = front.where("not hit").select("child", F.col("at").alias("_at"), "path")
        if rest.isEmpty():
            return out
        front = rest.join(step, "_at").where(~F.array_contains("path", F.col("_up"))).select("child", F.col("_up").alias("at"), "hit", F.concat("path", F.array("_at")).alias("path"))


def resolved_calls(refs: DataFrame, nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref_id, id, strategy, n_candidates) of the calls among ``refs``.

    Scope, file, imports and receivers in turn; of what a rule leaves, the
    functions of the call's arity, if there are any (-1 fits every one).
    """
    calls = checkpointed(scoped(refs.where("type = 'CALLS' and target is not null"), nodes, import_scope(refs), parents))
    defs = nodes.where("label in ('Function', 'Class')").select("repo", "id", "label", "name", "fqn", "file", "kind", "param_count").join(parents.select(F.col("child").alias("id"), "parent"), "id", "left")
    named = defs.withColumn("target", F.explode(F.array_distinct(F.array("name", "fqn"))))
    pool = keep_if_any(calls.join(named, ["repo", "target"]), ["ref_id"], F.col("label") == "Function")
    classes = nodes.where("label = 'Class'").select("repo", F.col("id").alias("cls"), "name", "fqn", "file")
    # only functions lie in functions, so a climb that leaves them has found its class or never will
    inside = parents.join(nodes.where("label = 'Function'").select(F.col("id").alias("child")), "child", "left_semi")
    above = nearest_above(inside, nodes.where("label = 'Class'").select(F.col("id").alias("node")))

    def receivers(column: str, flag: str) -> DataFrame:
        """(ref_id, parent, flag): the visible classes that the column names."""
        r = calls.where(F.col(column).isNotNull() & ~F.col(column).isin("self", "cls", "")).select("ref_id", "repo", F.col(column).alias("name"), "src_file", "src_package", "fqns", "simples", "wilds")
        return visible(r.join(classes, ["repo", "name"]), ["ref_id"]).select("ref_id", F.col("cls").alias("parent"), F.lit(True).alias(flag)).distinct()

    own = calls.where("recv in ('self', 'cls')").join(above.withColumnRenamed("child", "src"), "src").select("ref_id", F.col("above").alias("parent"), F.lit(True).alias("_own"))
    pool = pool.join(receivers("recv_type", "_typed"), ["ref_id", "parent"], "left").join(own, ["ref_id", "parent"], "left").join(receivers("recv", "_named"), ["ref_id", "parent"], "left")
    method = F.col("kind") == "method"
    best = cascade(
        pool, ["ref_id"],
        [
            ("same_scope", F.col("parent") == F.col("src_parent")), ("same_file", F.col("file") == F.col("src_file")), ("imports_qualified_exact", F.array_contains("fqns", owner_name(F.col("fqn"), F.col("name")))), ("imports_qualified", _qualified(F.col("fqn"))),
            ("imports", F.array_contains("simples", F.col("name"))), ("receiver_type_hint", method & F.col("_typed")), ("receiver_type", method & (F.coalesce("_own", F.lit(False)) | F.coalesce("_named", F.lit(False)))), ("name", F.lit(True)),
        ],
    ).drop("n_candidates")
    fits = F.col("call_arity").isNotNull() & (F.col("call_arity") >= 0) & (F.col("call_arity") == F.col("param_count"))
    kept = keep_if_any(best, ["ref_id"], fits)
    return kept.withColumn("n_candidates", F.count(F.lit(1)).over(_by(["ref_id"]))).select("ref_id", "id", "strategy", "n_candidates")


def resolved_types(refs: DataFrame, nodes: DataFrame, parents: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(ref_id, id, strategy, n_candidates) of the references to types."""
    rows = scoped(refs.where(F.col("type").isin(*types) & F.col("target").isNotNull()), nodes, import_scope(refs), parents).withColumn("name", tail_name(F.col("target")))
    classes = nodes.where("label = 'Class'").select("repo", "id", "name", "fqn", "file")
    return visible(rows.join(classes, ["repo", "name"]), ["ref_id"]).select("ref_id", "id", "strategy", "n_candidates")
