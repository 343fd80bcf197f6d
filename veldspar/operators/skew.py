"""Work per key when a few keys hold most rows.

Loads are estimated by a count that is combined before the shuffle. A key is
heavy above ``target_rows``, or above a quarter of what a task would get if
all rows were dealt out evenly, if that is more: so there are four heavy keys
a task at most, however many rows there are. Heavy keys are split into shards
in proportion to their load; the shards and the middling keys are packed into
tasks, longest first; the many light keys are spread by hash. The matching
side of a join is copied only to the shards of the keys it belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TARGET_ROWS = 500_000


def key_loads(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``_load``): rows per key, null keys left out. Combined map-side."""
    kept = rows.select(*keys)
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_load"))


def _weighed(loads: DataFrame, tasks: int, target_rows: int) -> DataFrame:
    """``loads`` with ``_target``, the rows of a shard."""
    total = F.broadcast(loads.agg(F.sum("_load").alias("_total")))  # one row
    return loads.crossJoin(total).withColumn("_target", F.greatest(F.lit(target_rows), F.ceil(F.col("_total") / (4 * tasks)))).drop("_total")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shard_plan(rows: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """(keys, ``_shards``) of the heavy keys only: four a task at most, so small enough to broadcast."""
    loads = _weighed(key_loads(rows, keys), _tasks(rows), target_rows)
    return loads.where("_load > _target").select(*keys, F.ceil(F.col("_load") / F.col("_target")).cast("int").alias("_shards"))


def with_shard(rows: DataFrame, plan: DataFrame, keys: Sequence[str], spread: Column) -> DataFrame:
    """``rows`` with ``_shard``: 0 for light keys, else by the hash of ``spread``."""
    return rows.join(F.broadcast(plan), list(keys), "left").withColumn("_shard", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_shards")).cast("int"), F.lit(0))).drop("_shards")


def replicated(side: DataFrame, plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``side`` once for each shard of its key: once, for all but the heavy keys."""
    return (
        side.join(F.broadcast(plan), list(keys), "left")
        .withColumn("_shard", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shards"), F.lit(1)) - 1)))
        .drop("_shards")
    )


def fragment_replicate_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str, spread: Column, target_rows: int = TARGET_ROWS, condition: Column | None = None) -> DataFrame:
    """Equi-join in which a heavy key's rows go to as many tasks as they need.

    ``how`` is inner, left, left_semi or left_anti (``rows`` is the left side).
    ``side`` may have several rows per key. ``spread`` is an expression on
    ``rows`` with many values. With ``condition`` the columns of ``side``
    other than the keys must not occur in ``rows``. Rows with a null key match
    nothing. Empty inputs give what a plain join gives.
    """
    plan = shard_plan(rows, keys, target_rows)
    left, right = with_shard(rows, plan, keys, spread), replicated(side, plan, keys)
    on = [*keys, "_shard"]
    if condition is None:
        return left.join(right, on, how).drop("_shard")
    names = {k: f"_right_{k}" for k in on}
    right = right.withColumnsRenamed(names)
    test = condition
    for k, other in names.items():
        test = test & (F.col(k) == F.col(other))
    return left.join(right, test, how).drop("_shard", *names.values())


def packed_tasks(loads: DataFrame, keys: Sequence[str], tasks: int, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(keys, ``_n``, ``_shard``, ``_task``) for every shard of the keys of some weight.

    Keys of at least a sixteenth of a shard are dealt out, greatest shard
    first, in turns that go forth and back over the tasks; for shards of like
    size that is the longest-first rule, and it needs no loop on the driver.
    Lighter keys are absent: they go to a task by hash.
    """
    n = F.ceil(F.col("_load") / F.col("_target")).cast("int")
    some = _weighed(loads, tasks, target_rows).where(F.col("_load") * 16 >= F.col("_target")).withColumn("_n", n).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # at most 17 * 4 rows a task; one task sorts them
    turn = F.row_number().over(W.orderBy(F.desc(F.col("_load") / F.col("_n")), *keys, "_shard")) - 1
    lap, at = F.floor(turn / tasks), F.pmod(turn, F.lit(tasks))
    return some.withColumn("_task", F.when(F.pmod(lap, F.lit(2)) == 0, at).otherwise(tasks - 1 - at).cast("int")).select(*keys, "_n", "_shard", "_task")


def balanced_key_stats(rows: DataFrame, key: str, member: str, target_rows: int = TARGET_ROWS, tasks: int | None = None, side: DataFrame | None = None) -> DataFrame:
    """Rows and distinct members per key, without a task that has most of the work.

    Result: (key, ``n_rows``, ``n_members``, ``n_shards``), and the columns of
    ``side`` (at most one row per key; other columns than key and member) if
    given, in which case ``n_side_rows`` counts the rows that found a partner.
    Rows with a null key are left out; a null member counts as no member;
    repeated rows count as often as they occur. An empty input gives no row.
    All equal members of a key fall into one shard, so their numbers add up.
    """
    tasks = tasks or _tasks(rows)
    rows = rows.select(F.col(key).alias("_k"), F.col(member).alias("_m")).where(F.col("_k").isNotNull())
    # equal pairs become one row before they are moved: most of a heavy key's rows are such
    pairs = rows.groupBy("_k", "_m").agg(F.count(F.lit(1)).alias("_c"))
    # a pair weighs one; summed over its count, so that the plan reads the same shuffle as the work
    plan = packed_tasks(pairs.groupBy("_k").agg(F.sum(F.least(F.lit(1), F.col("_c"))).alias("_load")), ["_k"], tasks, target_rows)
    heads = F.broadcast(plan.select("_k", "_n").distinct())

    def placed(df: DataFrame) -> DataFrame:
        """``df`` in the task of its shard."""
        light = F.pmod(F.xxhash64("_k"), F.lit(tasks)).cast("int")
        return df.join(F.broadcast(plan.drop("_n")), ["_k", "_shard"], "left").withColumn("_task", F.coalesce("_task", light)).repartitionById(tasks, "_task")

    here = placed(pairs.join(heads, "_k", "left").withColumn("_shard", F.coalesce(F.pmod(F.xxhash64("_m"), F.col("_n")).cast("int"), F.lit(0))).drop("_n"))
    extra = []
    if side is not None:
        extra = [c for c in side.columns if c != key]
        copies = side.withColumnRenamed(key, "_k").where("_k is not null").join(heads, "_k", "left").withColumn("_shard", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n").withColumn("_hit", F.lit(1))
        here = here.join(placed(copies), ["_task", "_k", "_shard"], "left")
    part = here.groupBy("_task", "_k", "_shard", *extra).agg(
        F.sum("_c").alias("_c"), F.count("_m").alias("_d"), *([F.sum(F.col("_c") * F.coalesce("_hit", F.lit(0))).alias("_h")] if side is not None else [])
    )
    out = part.groupBy("_k", *extra).agg(
        F.sum("_c").alias("n_rows"), F.sum("_d").alias("n_members"), F.count(F.lit(1)).alias("n_shards"), *([F.sum("_h").alias("n_side_rows")] if side is not None else [])
    )
    return out.withColumnRenamed("_k", key)
