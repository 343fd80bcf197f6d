"""Documents of several sources mixed to target shares of the tokens.

Method: the documents of a source, one behind the other in a fixed
pseudo-random order, are cut into blocks of a fixed number of tokens. The
output is a number of shards of equally many slots, each slot a block long.
Every shard draws multinomially how many of its slots each source gets, from
what the source still has to give, so that the draws of all shards add up to
the source's quota. A slot of a source is mapped to a block by a pseudo-random
permutation of the block numbers, pass by pass, so every block has been used
p times before one is used p + 1 times. Slots and blocks are joined by their
index.

The draws are made in two levels, each about the square root of the number of
shards: the driver draws for groups of shards, a task for the shards of a
group. The total is the largest for which no source needs more than
``max_repeats`` passes, or ``total_tokens`` if that is less. Without
``block_tokens`` a block is a thousandth of the total, at most 4,096 tokens.

Nulls: documents without a source, of a source without a target, without an id
or text of no tokens are not used. Targets without documents, share or repeats
get nothing and are reported; the shares of the others are scaled to 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.functions.keys import spelling
from veldspar.llm.tokens import TOKENIZER, token_count
from veldspar.operators.prefix import running
from veldspar.session import checkpointed, spread

MOST_BLOCK_TOKENS = 4096
#: Part of the total that a block may be: a share misses its target by a block or two.
PRECISION = 0.001
SHARD_TOKENS = 200_000


def _permutation(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """(m, c) with block = (m * place + c) mod n one-to-one, within 64 bits."""
    most = max(2, min(n, 2**62 // max(n, 1)))
    m = int(rng.integers(1, most))
    while math.gcd(m, n) != 1:
        m = m % (most - 1) + 1
    return m, int(rng.integers(0, max(n, 1)))


def planned(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None, block_tokens: int | None) -> tuple[int, dict[str, int], dict[str, int]]:
    """Tokens of a block, and for each source its blocks and its quota of slots."""
    usable = {s: t for s, t in targets.items() if tokens.get(s) and t[0] > 0 and t[1] > 0}
    share = sum(t[0] for t in usable.values())
    if not usable:
        return 1, {}, {}
    total = min(tokens[s] * r * share / w for s, (w, r) in usable.items())
    if total_tokens is not None:
        total = min(total, total_tokens)
    size = block_tokens or max(1, min(MOST_BLOCK_TOKENS, int(total * PRECISION)))
    blocks = {s: -(-tokens[s] // size) for s in usable}
    # the last block of a source is shorter, so its quota goes by the tokens of a block on average
    quota = {s: min(blocks[s] * r, round(total * w / share * blocks[s] / tokens[s])) for s, (w, r) in usable.items()}
    return size, blocks, quota


def draw(quota: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Slots of each source for parts of the given sizes; columns add up to ``quota``."""
    left = quota.copy()
    out = np.zeros((len(sizes), len(quota)), np.int64)
    for k, size in enumerate(sizes):
        got = np.minimum(rng.multinomial(size, left / left.sum()), left) if left.sum() else np.zeros_like(left)
        while got.sum() < size:  # a source ran out: draw the rest from the others
            rest = left - got
            got = np.minimum(got + rng.multinomial(size - got.sum(), rest / rest.sum()), left)
        out[k], left = got, left - got
    return out


def shard_draws(spark, quota: dict[str, int], shards: int, seed: int) -> DataFrame:
    """(source, shard, first, n): the slots of each source that each shard got, from slot ``first`` on."""
    names = sorted(quota)
    all_ = np.array([quota[s] for s in names], np.int64)
    groups = math.isqrt(max(1, shards) - 1) + 1
    counts = np.diff(np.arange(groups + 1) * shards // groups)
    first_shard = np.concatenate([[0], np.cumsum(counts)[:-1]])
    slots = int(all_.sum())
    upto = [(int(f + c) * slots) // shards for f, c in zip(first_shard, counts, strict=True)]
    sizes = np.diff([0, *upto]).astype(np.int64)
    drawn = draw(all_, sizes, np.random.default_rng(seed))
    starts = np.cumsum(drawn, axis=0) - drawn
    rows = [(g, int(first_shard[g]), int(counts[g]), drawn[g].tolist(), starts[g].tolist()) for g in range(groups)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ends = np.array([((r.first_shard + i) * slots) // shards for i in range(r.n_shards + 1)], object)
                got = draw(np.array(r.drawn, np.int64), np.diff(ends).astype(np.int64), np.random.default_rng([seed, r.group]))
                first = np.cumsum(got, axis=0) - got + np.array(r.starts, np.int64)
                for i, name in enumerate(names):
                    yield pd.DataFrame({"source": name, "shard": np.arange(r.first_shard, r.first_shard + r.n_shards), "first": first[:, i], "n": got[:, i]})

    plan = spark.createDataFrame(rows, "group long, first_shard long, n_shards long, drawn array<long>, starts array<long>")
    return plan.mapInPandas(run, "source string, shard long, first long, n long").where("n > 0")


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int | None = None, shard_tokens: int = SHARD_TOKENS, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, block, first_token, tokens, repeat, shard): a row per document, block it lies in and use of the block.

    A use takes ``tokens`` tokens of the document from ``first_token`` (from 0)
    on; the tokens of a document that lie in one block are used equally often.
    ``documents`` is (doc_id, text, source, ...) with unique ids; ``targets``
    (source, target_share, max_repeats).
    """
    spark = documents.sparkSession
    goal = {r.s: (float(r.w or 0), int(r.r or 0)) for r in targets.select(spelling("source").alias("s"), F.col("target_share").alias("w"), F.col("max_repeats").alias("r")).where("s is not null").groupBy("s").agg(F.max("w").alias("w"), F.max("r").alias("r")).collect()}
    counted = spread(documents.select("doc_id", spelling("source").alias("source"), "text").where(F.col("doc_id").isNotNull() & F.col("source").isin(*goal))).select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("tokens")).where("tokens > 0")
    counted = checkpointed(counted)
    tokens = {r.source: r.t for r in counted.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # a row per target
    size, blocks, quota = planned(tokens, goal, total_tokens, block_tokens)
    quota = {s: q for s, q in quota.items() if q > 0}
    shards = max(1, round(sum(quota.values()) * size / shard_tokens))
    rng = np.random.default_rng(seed)
    how = spark.createDataFrame([(s, blocks[s], *_permutation(blocks[s], rng)) for s in sorted(quota)], "source string, _n long, _m long, _c long")
    drawn = shard_draws(spark, quota, shards, seed).join(F.broadcast(how), "source")  # a row per target
    slot = F.explode(F.sequence("first", F.col("first") + F.col("n") - 1))
    slots = drawn.select("source", "shard", "_n", "_m", "_c", slot.alias("slot")).select(
        "source", F.pmod(F.pmod(F.col("slot"), F.col("_n")) * F.col("_m") + F.col("_c"), F.col("_n")).alias("block"), (F.floor(F.col("slot") / F.col("_n")) + 1).cast("int").alias("repeat"), "shard"
    )
    ordered = running(counted.where(F.col("source").isin(*quota)), ["source"], ["doc_id"], F.col("tokens"), seed)
    first, last = F.expr(f"_before div {size}"), F.expr(f"(_before + tokens - 1) div {size}")
    parts = ordered.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * size - F.col("_before"), F.lit(0))
    stop = F.least((F.col("block") + 1) * size - F.col("_before"), F.col("tokens"))
    parts = parts.select("source", "block", "doc_id", start.cast("long").alias("first_token"), (stop - start).cast("long").alias("tokens"))
    return parts.join(slots, ["source", "block"]).select("doc_id", "source", "block", "first_token", "tokens", "repeat", "shard")


def shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, documents, most_repeats, actual_share) per target."""
    got = uses.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.max("repeat").alias("r")).groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("r").alias("most_repeats"))
    total = got.agg(F.sum("tokens").alias("_all"))
    want = targets.select(spelling("source").alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    zero = F.lit(0).cast("long")
    return want.join(got, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"),
    )
