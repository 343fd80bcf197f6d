"""Ranks and running sums within groups of any size, without one task per group.

Rows are put in a pseudo-random but fixed order by a seeded hash of their key.
The leading bits of the hash cut every group into parts; the parts' totals are
few, so a window over them gives each part its start, and a window within the
parts does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of a group. Part totals number groups * PARTS at most.
PARTS = 1024


def running(rows: DataFrame, group: Sequence[str], key: Sequence[str], weight: Column | None = None, seed: int = 0, parts: int = PARTS) -> DataFrame:
    """``rows`` with ``_rank`` (from 0) and ``_before``, the weight of the rows in front.

    ``key`` should identify a row; rows of equal key follow each other in any
    order. Groups compare null-safe. ``_before`` counts rows if there is no
    weight. The input is read twice, so it must be deterministic.
    """
    w = (weight if weight is not None else F.lit(1)).cast("long")
    rows = rows.withColumn("_g", F.struct(*group)).withColumn("_w", F.coalesce(w, F.lit(0))).withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_part", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(parts)).cast("int"))
    totals = rows.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_s"))
    ahead = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_g", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0"))
    within = W.partitionBy("_g", "_part").orderBy("_h", *key)
    out = rows.withColumn("_r", F.row_number().over(within) - 1).withColumn("_b", F.coalesce(F.sum("_w").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(starts, ["_g", "_part"])
    return out.withColumn("_rank", (F.col("_r") + F.col("_n0")).cast("long")).withColumn("_before", (F.col("_b") + F.col("_s0")).cast("long")).drop("_g", "_w", "_h", "_part", "_n0", "_s0", "_r", "_b")
