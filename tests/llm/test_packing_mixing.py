import random
from collections import Counter

import numpy as np
import pytest

from veldspar.llm import mixing, packing, tokens


def test_nnls_finds_the_least_squares():
    r = np.random.default_rng(1)
    a, x = r.random((12, 6)), np.array([0, 2.0, 0, 1.5, 3, 0])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_the_histogram(seed):
    r = random.Random(seed)
    cap = r.choice([1, 7, 60, 1000, 24000])
    h = Counter(min(cap, max(1, int(r.expovariate(4 / cap)))) for _ in range(r.choice([1, 50, 3000])))
    plan = packing.plan(dict(h), cap)
    got = Counter()
    for lens, n in plan:
        assert 0 < sum(lens) <= cap and n > 0
        for v in lens:
            got[v] += n
    assert got == h
    if sum(h.values()) == 3000 and cap >= 1000:
        assert sum(k * n for k, n in h.items()) / cap / sum(n for _, n in plan) > 0.97


def test_packed_items(spark):
    r = random.Random(3)
    items = [("q", f"i{i}", r.choice([r.randrange(1, 90), 33])) for i in range(400)] + [("q", "big", 250), ("s", "one", 10), ("none", "x", 5), ("q", None, 5), ("q", "zero", 0), (None, "n", 4)]
    items += items[:7]
    df = spark.createDataFrame(items, "box string, key string, length long").selectExpr("*", "1 as part", "2 as call")
    out = packing.packed(df, {"q": 100, "s": 50})
    rows = out.collect()
    want = {(b, k): n for b, k, n in items if b in ("q", "s") and k and n > 0}
    size, room = Counter(), Counter()
    for x in rows:
        size[x.box, x.key] += x.length
        room[x.box, x.call] += x.length
    assert size == Counter(want)
    assert all(n <= (100 if b == "q" else 50) for (b, _), n in room.items())
    assert len([x for x in rows if x.key == "big"]) == 3 and max(Counter((x.box, x.key, x.part) for x in rows).values()) == 1
    assert sum(r.used for r in packing.fills(out, {"q": 100, "s": 50}).collect()) == sum(want.values())
    assert packing.packed(df.limit(0), {"q": 100}).count() == 0


def test_large_containers_are_planned_in_units(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_SIZES", 10)
    r = random.Random(4)
    items = [("q", f"k{i}", r.choice((1, 30, 47, 101, 150))) for i in range(200)]
    rows = packing.packed(spark.createDataFrame(items, "box string, key string, length long"), {"q": 101}).collect()
    room, size = Counter(), Counter()
    for x in rows:
        room[x.call] += x.length
        size[x.key] += x.length
    assert max(room.values()) <= 101 and size == Counter({k: n for _, k, n in items})


def test_token_count_of_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (4, "ab " * 100_000)], "i int, text string")
    got = {r.i: r.n for r in df.select("i", tokens.token_count(df.text).alias("n")).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 100_000


def test_mix_hits_the_targets(spark):
    r = random.Random(9)
    docs = [(i, "word " * r.randrange(20, 200), r.choice(["A-b", "a_b", "c", "c", "c", None, "other"])) for i in range(900)] + [(9001, None, "c"), (9002, "", "c"), (None, "x y", "c")]
    targets = [("a_b", 0.5, 2), ("c", 0.3, 3), ("absent", 0.2, 4), (None, 0.1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as block", "2 as tokens")
    goal = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    uses = mixing.mixed(df, goal, block_tokens=300, shard_tokens=5000)
    rows = uses.collect()
    cap = {x.doc_id: {"a_b": 2, "c": 3}[x.source] for x in rows}
    assert all(x.repeat <= cap[x.doc_id] for x in rows)
    assert len({(x.doc_id, x.block, x.repeat) for x in rows}) == len(rows)
    length = Counter()
    for x in {(x.source, x.block, x.repeat, x.doc_id): x for x in rows}.values():
        length[x.source, x.block, x.repeat] += x.tokens
    assert sum(n != 300 for n in length.values()) <= 2 * 3  # but for the last block of a source, all are full
    share = {x.source: x.actual_share for x in mixing.shares(uses, goal).collect()}
    assert abs(share["a_b"] - 0.625) < 0.03 and abs(share["c"] - 0.375) < 0.03 and share["absent"] == 0
    sizes = Counter()
    for x in rows:
        sizes[x.shard] += x.tokens
    assert len(sizes) > 3 and max(sizes.values()) <= 5400
    assert mixing.mixed(df.limit(0), goal).count() == 0


def test_a_plan_of_25_trillion_tokens(spark):
    import math

    import numpy as np

    tokens = {"a": 10**13, "b": 4 * 10**12, "c": 10**12}
    size, blocks, quota = mixing.planned(tokens, {"a": (0.5, 2), "b": (0.3, 2), "c": (0.2, 5)}, 25 * 10**12, None)
    total = sum(quota.values())
    assert size == 4096 and all(quota[s] <= blocks[s] * r for s, r in (("a", 2), ("b", 2), ("c", 5))) and abs(quota["a"] / total - 0.5) < 0.001
    shards = round(total * size / mixing.SHARD_TOKENS)
    groups = math.isqrt(shards - 1) + 1
    drawn = mixing.draw(np.array([quota[s] for s in "abc"]), np.diff([(g * total) // groups for g in range(groups + 1)]), np.random.default_rng(1))
    assert drawn.sum(axis=0).tolist() == [quota[s] for s in "abc"]


def test_draws_cover_every_slot_once(spark):
    quota = {"a": 700, "b": 290, "c": 1}
    rows = mixing.shard_draws(spark, quota, 37, 3).collect()
    for s, q in quota.items():
        got = sorted((r["first"], r["n"]) for r in rows if r["source"] == s)
        assert [f for f, _ in got] == [sum(n for _, n in got[:i]) for i in range(len(got))] and sum(n for _, n in got) == q
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["n"]
    assert len(sizes) == 37 and max(sizes.values()) - min(sizes.values()) <= 1
