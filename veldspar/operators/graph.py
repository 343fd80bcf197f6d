"""Traversals of any edge table (src, dst): distances, components, paths, cycles.

Frontier loops keep a visited set in a written table and stop on an empty
frontier. Path enumerations are bounded by length, since the number of simple
paths is not bounded by the size of the graph.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.session import checkpointed, released


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without nulls."""
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def distances(edges: DataFrame, starts: DataFrame, max_hops: int | None, reverse: bool = False) -> DataFrame:
    """(origin, node, hops): least number of hops from each origin, itself at 0.

    ``starts`` is (origin). Without ``max_hops`` the search ends when nothing new is reached. With ``reverse`` edges are walked from dst to src.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = checkpointed(pairs(edges).select(F.col(a).alias("_from"), F.col(b).alias("_to")))
    seen = front = checkpointed(starts.select("origin", F.col("origin").alias("node"), F.lit(0).alias("hops")).where("origin is not null").distinct())
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        reached = front.join(step, F.col("node") == F.col("_from")).select("origin", F.col("_to").alias("node")).distinct()
        front = checkpointed(reached.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def adaptive_distances(edges: DataFrame, starts: DataFrame, reverse: bool = True) -> DataFrame:
    """As :func:`distances`, each origin to its own ``depth``. ``starts`` is (origin, depth)."""
    limits = starts.groupBy("origin").agg(F.max("depth").alias("depth"))
    most = limits.agg(F.max("depth")).first()[0] or 0
    return distances(edges, limits.select("origin"), int(most), reverse).join(limits, "origin").where("hops <= depth").drop("depth")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): connected components without regard to direction.

    Large-star and small-star steps in turn: every node points its greater
    neighbours, then itself and its smaller neighbours, to the least one it
    sees. Stars grow exponentially, so the rounds are logarithmic in depth.
    """
    links = checkpointed(pairs(edges).where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpointed(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = checkpointed(small)
        released(large)
        if new.join(links, ["u", "v"], "left_anti").isEmpty() and links.join(new, ["u", "v"], "left_anti").isEmpty():
            released(new)
            break
        released(links)
        links = new
    hung = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = hung.unionByName(heads)
    if nodes is None:
        return out
    return nodes.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def simple_paths(edges: DataFrame, starts: DataFrame, max_hops: int, stop: DataFrame | None = None) -> DataFrame:
    """(path, hops): all simple paths of 1..max_hops hops from ``starts`` (node).

    A path that reaches a node of ``stop`` (node) is not prolonged.
    """
    step = checkpointed(pairs(edges).select(F.col("src").alias("_from"), F.col("dst").alias("_to")))
    ends = None if stop is None else stop.select(F.col("node").alias("_last")).distinct()
    front = starts.select(F.array("node").alias("path")).distinct()
    out = None
    for hop in range(1, max_hops + 1):
        grown = front.withColumn("_last", F.element_at("path", -1)) if hop == 1 or ends is None else front.withColumn("_last", F.element_at("path", -1)).join(ends, "_last", "left_anti")
        front = checkpointed(grown.join(step, F.col("_last") == F.col("_from")).where(~F.array_contains("path", F.col("_to"))).select(F.concat("path", F.array("_to")).alias("path")))
        if front.isEmpty():
            break
        part = front.withColumn("hops", F.lit(hop))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else front.withColumn("hops", F.lit(0)).limit(0)


def simple_cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """(cycle, length): simple cycles of 2..max_length nodes, each from its least node on."""
    step = checkpointed(pairs(edges).where("src <> dst").select(F.col("src").alias("_from"), F.col("dst").alias("_to")))
    front = step.where("_from < _to").select(F.array("_from", "_to").alias("path"))
    out = None
    for length in range(2, max_length + 1):
        front = checkpointed(front)
        ends = front.withColumn("_last", F.element_at("path", -1)).withColumn("_first", F.col("path")[0])
        closed = ends.join(step, (F.col("_last") == F.col("_from")) & (F.col("_first") == F.col("_to"))).select(F.col("path").alias("cycle"), F.lit(length).alias("length"))
        out = closed if out is None else out.unionByName(closed)
        front = ends.join(step, F.col("_last") == F.col("_from")).where((F.col("_to") > F.col("_first")) & ~F.array_contains("path", F.col("_to"))).select(F.concat("path", F.array("_to")).alias("path"))
    return out


def shortest_paths(edges: DataFrame, start: str | int, max_hops: int, reverse: bool = True) -> DataFrame:
    """(node, path): one shortest path from ``start``, through least parents."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    spark = edges.sparkSession
    step = checkpointed(pairs(edges).select(F.col(a).alias("_from"), F.col(b).alias("_to")))
    kind = step.schema["_from"].dataType
    front = spark.createDataFrame([(start,)], ["node"]).select(F.col("node").cast(kind).alias("node")).withColumn("path", F.array("node"))
    seen = front = checkpointed(front)
    for _ in range(max_hops):
        grown = front.join(step, F.col("node") == F.col("_from")).select(F.col("_to").alias("n"), F.concat("path", F.array("_to")).alias("p"), F.col("node").alias("q"))
        front = checkpointed(grown.groupBy("n").agg(F.min_by("p", "q").alias("path")).withColumnRenamed("n", "node").join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def prefix_tree(paths: DataFrame, column: str, separator: str) -> DataFrame:
    """(node, parent): every prefix of a dotted or slashed path under the next shorter one."""
    parts = F.filter(F.split(F.col(column), f"[{separator}]"), lambda x: x != "")
    rows = paths.where(F.col(column).isNotNull()).select(parts.alias("p")).where(F.size("p") > 0).distinct()
    prefix = lambda i: F.array_join(F.slice(F.col("p"), 1, i), separator)
    return rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(prefix(i).alias("node"), F.when(i > 1, F.array_join(F.slice(F.col("p"), 1, i - 1), separator)).alias("parent")))).alias("x")).select("x.*").distinct()


def transitive_overrides(inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """(sub_method, super_method): same name and parameter count in any class above.

    ``inherits`` is (src, dst) from class to superclass, ``methods`` (id, owner, name, n_params).
    """
    above = distances(inherits, methods.select(F.col("owner").alias("origin")).distinct(), None).where("hops > 0")
    low, high = methods.select(F.col("id").alias("sub_method"), F.col("owner").alias("origin"), "name", "n_params"), methods.select(F.col("id").alias("super_method"), F.col("owner").alias("node"), "name", "n_params")
    return low.join(above, "origin").join(high, ["node", "name", "n_params"]).select("sub_method", "super_method").distinct()
