"""What a change reaches: impact trees and ranked chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.session import checkpointed

# Weight of a relation in an impact chain.
WEIGHTS = {"CALLS": 1.0, "EXTENDS": 0.9, "INSTANTIATES": 0.8, "IMPORTS": 0.4}


def relation_weight(kind: Column) -> Column:
    out = None
    for k, w in WEIGHTS.items():
        out = F.when(kind == k, w) if out is None else out.when(kind == k, w)
    return out.otherwise(0.5)


def impact_tree(edges: DataFrame, changed: DataFrame, max_depth: int) -> DataFrame:
    """(node, parent, origin, depth, path): one parent per impacted node.

    ``edges`` is (type, src, dst, score), ``changed`` (node). A multi-source
    search against the edges; only changed nodes and their consumers up to
    ``max_depth`` are entered. Of several parents in a level the one whose edge
    has the highest score, then weight, then the least id is kept.
    """
    step = checkpointed(edges.where("src is not null and dst is not null and src <> dst").groupBy(F.col("dst").alias("_dst"), F.col("src").alias("_src")).agg(F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), relation_weight(F.col("type")).alias("w"))).alias("e")))
    text = changed.select("node").where("node is not null").distinct()
    front = checkpointed(text.select("node", F.lit(None).cast(text.schema["node"].dataType).alias("parent"), F.col("node").alias("origin"), F.lit(0).alias("depth"), F.array("node").alias("path")))
    seen = front
    for depth in range(1, max_depth + 1):
        grown = front.join(step, F.col("node") == F.col("_dst")).select(F.col("_src").alias("n"), F.struct((-F.col("e.s")).alias("s"), (-F.col("e.w")).alias("w"), F.col("node").alias("q")).alias("k"), F.struct(F.col("node").alias("parent"), "origin", F.concat("path", F.array("_src")).alias("path")).alias("v"))
        best = grown.groupBy("n").agg(F.min_by("v", "k").alias("v")).select(F.col("n").alias("node"), "v.parent", "v.origin", F.lit(depth).alias("depth"), "v.path")
        front = checkpointed(best.join(seen.select("node"), "node", "left_anti").select("node", "parent", "origin", "depth", "path"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def chain_score(change: Column, depth: Column, sensitive: Column, entry: Column, test: Column, uncertain: Column, modified: Column) -> Column:
    """Kind of change, closeness, sensitive and entry points up; tests, doubt and nodes already changed down."""
    kind = F.when(change.isin("signature", "added"), 3.0).otherwise(1.0)
    flag = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return kind + F.greatest(F.lit(0.0), F.lit(3.0) - depth) + F.least(F.lit(3.0), depth * 0.5) + flag(sensitive, 2.0) + flag(entry, 3.0) - flag(test, 2.0) - flag(uncertain, 2.0) - flag(modified, 5.0)
