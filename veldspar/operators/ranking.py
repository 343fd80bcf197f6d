"""First per key, top n with a rest, fusion of rankings, vectors and keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.session import checkpointed


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key. Combined before the shuffle, so hot keys cost a row per task."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])).alias("_first")).select(*keys, "_first.*")


def top_with_rest(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with ``rank`` (from 1) and ``n_rest``."""
    w = W.partitionBy(*group)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.where(F.col("rank") <= n).join(sizes, list(group)).withColumn("n_rest", F.greatest(F.col("_n") - n, F.lit(0))).drop("_n")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_topk(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, score) of the ``k`` rows nearest to the one vector of ``query`` (q). Exact."""
    return vectors.crossJoin(F.broadcast(query.select("q").limit(1))).select(key, F.round(cosine(F.col(column), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def keyword_topk(docs: DataFrame, terms: Sequence[str], k: int, key: str, text: Column) -> DataFrame:
    """(key, score): number of the terms that the text contains, positive only."""
    low = F.lower(text)
    score = sum((F.when(low.contains(t.lower()), 1).otherwise(0) for t in terms), F.lit(0))
    return docs.select(key, score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def reciprocal_rank_fusion(legs: dict[str, DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """(key, rrf, legs): sums of 1 / (constant + rank), ranks from 0.

    ``legs`` are short ranked lists (key, score), each cut to its top before.
    """
    out = None
    for name, leg in legs.items():
        rank = F.row_number().over(W.orderBy(F.desc("score"), key)) - 1
        part = leg.select(key, (1.0 / (constant + rank)).alias("_s"), F.concat(F.lit(f"{name}#"), (rank + 1).cast("string")).alias("_l"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.round(F.sum("_s"), 9).alias("rrf"), F.array_join(F.sort_array(F.collect_list("_l")), ",").alias("legs")).orderBy(F.desc("rrf"), key).limit(k)


def gap_sessions(rows: DataFrame, group: Sequence[str], at: Column, order: Sequence[str], gap: float, width: float | None = None) -> DataFrame:
    """``rows`` with ``session`` (from 1): a step of ``at`` above ``gap`` begins a new one.

    ``order`` must not go against ``at``. A group is cut into stretches of
    ``width`` (a thousand gaps), each with the end of the one in front and the
    number of sessions before it, so no window holds a whole group. Groups
    compare null-safe; rows without ``at`` stand alone, before the others.
    """
    width = width or 1000 * gap
    cut = rows.withColumn("_g", F.struct(*group)).withColumn("_at", at).withColumn("_b", F.coalesce(F.floor(F.col("_at") / width), F.lit(-(2**62))))
    ends = cut.groupBy("_g", "_b").agg(F.max("_at").alias("_last")).withColumn("_prev", F.lag("_last").over(W.partitionBy("_g").orderBy("_b"))).select("_g", "_b", "_prev")
    w = W.partitionBy("_g", "_b").orderBy(*order)
    step = F.col("_at") - F.coalesce(F.lag("_at").over(w), "_prev")
    marked = checkpointed(cut.join(ends, ["_g", "_b"]).withColumn("_new", F.when(step <= gap, 0).otherwise(1)))
    counts = marked.groupBy("_g", "_b").agg(F.sum("_new").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = marked.join(counts.select("_g", "_b", before.alias("_from")), ["_g", "_b"])
    return out.withColumn("session", F.col("_from") + F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_g", "_b", "_at", "_prev", "_new", "_from")


def keep_if_any(rows: DataFrame, group: Sequence[str], wanted: Column) -> DataFrame:
    """Of each group the rows that are wanted, or all of it if none is."""
    some = rows.groupBy(*group).agg(F.max(F.coalesce(wanted, F.lit(False))).alias("_some"))
    return rows.join(some, list(group)).where(~F.col("_some") | F.coalesce(wanted, F.lit(False))).drop("_some")


def cascade(candidates: DataFrame, key: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Candidates of the first rule that matches, per key.

    Adds ``strategy`` (the rule's name) and ``n_candidates``; rows that no rule
    matches fall out. One pass and one shuffle on the key for all rules.
    """
    rank = F.coalesce(*[F.when(cond, i) for i, (_, cond) in enumerate(rules)])
    names = F.array(*[F.lit(n) for n, _ in rules])
    w = W.partitionBy(*key)
    ranked = candidates.withColumn("_rule", rank).where("_rule is not null")
    best = ranked.withColumn("_best", F.min("_rule").over(w)).where("_rule = _best")
    return best.withColumn("strategy", F.get(names, F.col("_rule"))).withColumn("n_candidates", F.count(F.lit(1)).over(w)).drop("_rule", "_best")


def numbered_in_order(rows: DataFrame, order: Sequence[Column], column: str = "pos") -> DataFrame:
    """``rows`` with their place in the whole order, from 1, without a task that holds them all.

    The rows are sorted in ranges, the ranges counted, and each row gets its
    place within its range behind the rows of those in front. The order must
    be total, and the input deterministic, since it is read twice.
    """
    parted = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parted = checkpointed(parted)
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parted.join(F.broadcast(starts), "_part").withColumn(column, place + F.col("_from")).drop("_part", "_from")
