import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veldspar.operators import prefix, skew


def rows(n=600):
    r = random.Random(7)
    return [("hot" if r.random() < 0.4 else f"k{r.randrange(30)}", f"m{r.randrange(50)}") for _ in range(n)] + [(None, "m"), ("k1", None)]


@pytest.mark.parametrize("target", [500_000, 40, 3])
def test_stats_match_brute_force(spark, target):
    data = rows()
    df = spark.createDataFrame(data, "node string, who string").withColumn("_k", F.lit(1)).withColumn("n_rows", F.lit(2))
    side = spark.createDataFrame([("hot", "H"), ("k1", "K")], "node string, name string")
    got = {r.node: (r.n_rows, r.n_members) for r in skew.balanced_key_stats(df, "node", "who", target).collect()}
    n, m = Counter(k for k, _ in data if k), defaultdict(set)
    for k, w in data:
        if k and w:
            m[k].add(w)
    assert got == {k: (n[k], len(m[k])) for k in n}
    joined = {r.node: (r.n_rows, r.n_side_rows, r.name) for r in skew.balanced_key_stats(df, "node", "who", target, side=side).collect()}
    assert joined["hot"] == (n["hot"], n["hot"], "H") and joined["k2"] == (n["k2"], 0, None)


def test_heavy_keys_are_split_over_tasks(spark):
    df = spark.createDataFrame(rows(), "node string, who string")
    plan = skew.packed_tasks(skew.key_loads(df, ["node"]), ["node"], 8, 30).collect()
    hot = [r for r in plan if r.node == "hot"]
    assert max(Counter(r._task for r in plan).values()) <= 17 * 4
    assert len(hot) >= 7 and len({r._task for r in hot}) >= 4


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_is_the_plain_join(spark, how):
    a = spark.createDataFrame([(k, w, i) for i, (k, w) in enumerate(rows(200))], "k string, w string, i int")
    b = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "k string, v int")
    got = skew.fragment_replicate_join(a, b, ["k"], how, F.col("i"), 10)
    want = a.join(b, "k", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "node string, who string")
    assert skew.balanced_key_stats(df, "node", "who").count() == 0


@pytest.mark.parametrize("parts", [1, 16])
def test_running_sums(spark, parts):
    df = spark.createDataFrame([("a" if i % 3 else None, i, i % 5) for i in range(100)], "g string, i int, w int")
    for g in ("a", None):
        got = sorted((r for r in prefix.running(df, ["g"], ["i"], F.col("w"), 3, parts).collect() if r.g == g), key=lambda r: r._rank)
        assert [r._rank for r in got] == list(range(len(got)))
        total = 0
        for r in got:
            assert r._before == total
            total += r.w
