"""References to records that do not exist (yet, or any more).

Everything is kept as signed deltas per key: a record adds 1 to the existence
of its key when it arrives and takes 1 away when it is removed; a reference
adds 1 to the references of its key. A key whose references are positive and
whose existence is zero is an orphan. :func:`maintained` keeps both counts
from one batch of changes to the next. Judged at the time of each reference,
the existence of a key is the running sum of its deltas up to that time:
:func:`orphans_at` merges references and deltas of a key by time, in as many
shards as the key's references need, each with all the key's deltas.

Nulls: a null or blank key refers to nothing and is no orphan. A reference
without a time is judged at the end of time. A record without an arrival has
never arrived. Repeated deltas of one record must be removed by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions.keys import norm_id, trimmed
from veldspar.operators.skew import TARGET_ROWS, replicated, shard_plan, with_shard
from veldspar.session import checkpointed

FOREVER = "9999-12-31 00:00:00"


def maintained(state: DataFrame | None, references: DataFrame, existence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_references, n_existing): ``state`` after a batch of signed changes.

    ``references`` and ``existence`` are (keys, delta), in any order. Both are
    summed before they are moved, so a hot key costs a row per task; a key
    whose counts are both zero again leaves the state. Changes whose key holds
    null are left out. Without a state this is the first batch.
    """
    zero = F.lit(0).cast("long")
    both = references.select(*keys, F.col("delta").cast("long").alias("_r"), zero.alias("_e")).unionByName(existence.select(*keys, zero.alias("_r"), F.col("delta").cast("long").alias("_e")))
    for k in keys:
        both = both.where(F.col(k).isNotNull())
    if state is not None:
        both = both.unionByName(state.select(*keys, F.col("n_references").alias("_r"), F.col("n_existing").alias("_e")))
    return both.groupBy(*keys).agg(F.sum("_r").alias("n_references"), F.sum("_e").alias("n_existing")).where("n_references <> 0 or n_existing <> 0")


def orphan_keys(state: DataFrame) -> DataFrame:
    """The current orphans of a state from :func:`maintained`."""
    return state.where("n_references > 0 and n_existing <= 0")


def orphans_at(references: DataFrame, changes: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Rows of ``references`` whose key does not exist at the row's own time.

    ``references`` is (keys, t, ...), ``changes`` (keys, t, delta); a change
    counts from its own time on. Keys that hold null exist at no time. The
    loads of the keys are counted once; a key above ``target_rows`` gets
    shards in proportion, and its changes, summed per time, go to each.
    """
    rest = [c for c in references.columns if c not in (*keys, "t")]
    at = F.coalesce("t", F.lit(FOREVER).cast("timestamp_ntz"))
    plan = checkpointed(shard_plan(references, keys, target_rows))
    rows = with_shard(references.withColumn("_at", at), plan, keys, F.struct("t", *rest))
    steps = changes.where("t is not null").groupBy(*keys, F.col("t").alias("_at")).agg(F.sum("delta").alias("_d")).where("_d <> 0")
    steps = replicated(steps, plan, keys)
    payload = F.struct("t", *rest)
    merged = rows.select(*keys, "_shard", "_at", F.lit(0).cast("long").alias("_d"), payload.alias("_row")).unionByName(
        steps.select(*keys, "_shard", "_at", "_d", F.lit(None).cast(rows.select(payload.alias("p")).schema["p"].dataType).alias("_row"))
    )
    upto = W.partitionBy(*keys, "_shard").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    out = merged.withColumn("_n", F.sum("_d").over(upto)).where("_row is not null and _n <= 0")
    return out.select(*keys, "_row.*").select(*references.columns)


def node_changes(nodes: DataFrame, shared: DataFrame, removed: DataFrame) -> DataFrame:
    """(key, t, delta) per node id: its first arrival, and its removal, at the arrival if that was before."""
    arrived = (
        nodes.select(norm_id("id").alias("key"), F.col("last_indexed").alias("since"))
        .unionByName(shared.select(norm_id("id").alias("key"), F.col("last_indexed").alias("since")))
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("since").alias("since"))
    )
    return _signed(arrived.join(_removals(removed), "key", "left"), ["key"])


def _signed(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    here = F.struct(F.col("since").alias("t"), F.lit(1).alias("delta"))
    gone = F.when(F.col("until").isNotNull(), F.struct(F.greatest("since", "until").alias("t"), F.lit(-1).alias("delta")))
    return spans.where("since is not null").select(*keys, F.explode(F.array_compact(F.array(here, gone))).alias("c")).select(*keys, "c.t", "c.delta")


def _removals(removed: DataFrame) -> DataFrame:
    return removed.select(norm_id("id").alias("key"), F.col("removed_at").alias("until")).where("key is not null").groupBy("key").agg(F.min("until").alias("until"))


def name_changes(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """(repo, key, t, delta) for the name and the fqn of each row of a node."""
    rows = nodes.select("repo", norm_id("id").alias("_id"), F.col("last_indexed").alias("since"), F.explode(F.array_distinct(F.array(trimmed("name"), trimmed("fqn")))).alias("key"))
    gone = _removals(removed).withColumnRenamed("key", "_id")
    return _signed(rows.where("key is not null and repo is not null").join(gone, "_id", "left"), ["repo", "key"])


def dangling(edges: DataFrame, refs: DataFrame, nodes: DataFrame, shared: DataFrame, removed: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(tbl, field, row_id, key, t): one row per reference that finds nothing.

    ``edges.dst`` and ``refs.src`` refer to node ids; ``refs.target_name`` to
    the name or fqn of a node of the same repository or of a shared node. Ids
    and names are judged together: an id is a key of the repository ``#id``.
    """
    t, space = F.col("seen_at").alias("t"), F.lit("#id").alias("repo")
    ids = edges.select(F.lit("edges").alias("tbl"), F.lit("dst").alias("field"), F.col("ord").alias("row_id"), space, norm_id("dst").alias("key"), t).unionByName(
        refs.select(F.lit("refs").alias("tbl"), F.lit("src").alias("field"), F.col("ref_id").alias("row_id"), space, norm_id("src").alias("key"), t)
    )
    names = refs.select(F.lit("refs").alias("tbl"), F.lit("target_name").alias("field"), F.col("ref_id").alias("row_id"), F.concat(F.lit("."), F.coalesce("repo", F.lit(""))).alias("repo"), trimmed("target_name").alias("key"), t)
    # the shared library's names, the hottest ones, are settled without moving a row
    library = shared.select(F.col("last_indexed").alias("_since"), F.explode(F.array_distinct(F.array(trimmed("name"), trimmed("fqn")))).alias("key")).where("key is not null and _since is not null").groupBy("key").agg(F.min("_since").alias("_since"))
    unknown = names.where("key is not null").join(library, "key", "left").where(F.col("_since").isNull() | (F.col("_since") > F.coalesce("t", F.lit(FOREVER).cast("timestamp_ntz")))).drop("_since")
    changes = node_changes(nodes, shared, removed).withColumn("repo", F.lit("#id")).unionByName(name_changes(nodes, removed).withColumn("repo", F.concat(F.lit("."), "repo")))
    lost = orphans_at(ids.where("key is not null").unionByName(unknown), changes, ["repo", "key"], target_rows)
    # a row that was delivered twice is one record; few rows are left by now
    return lost.groupBy("tbl", "field", "row_id").agg(F.min(F.struct("key", "t")).alias("k")).select("tbl", "field", "row_id", "k.key", "k.t")
