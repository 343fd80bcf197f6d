"""Upserts, patches and wipes of node and edge tables, as new tables.

Each takes the stored rows and a delta and gives the rows to be stored; equal
keys meet by a full outer join or a combined first-per-key aggregation, never
on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; where a key is in both, non-null new values replace old ones."""
    a, b = stored.alias("a"), new.alias("b")
    rest = [c for c in stored.columns if c not in keys]
    return a.join(b, list(keys), "full").select(*keys, *[(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}")).alias(c) for c in rest])


def upsert_edges(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("type", "src", "dst"), order: str = "ord") -> DataFrame:
    """One edge per key, later values win; both ends must be nodes (id)."""
    ids = nodes.select("id").distinct()
    rest = [c for c in edges.columns if c not in keys]
    both = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def patch(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Selected properties of rows that exist; other changes fall away."""
    a, b = stored.alias("a"), changes.alias("b")
    return a.join(b, list(keys), "left").select(*keys, *[(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in changes.columns else F.col(f"a.{c}")).alias(c) for c in stored.columns if c not in keys])


def wipe(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of a repository and what hung on them."""
    gone = nodes.where(F.col("repo") == repo).select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.where(~F.col("repo").eqNullSafe(repo)), kept
