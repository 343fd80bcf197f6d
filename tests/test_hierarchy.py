import random

import pytest

from veldspar.operators import hierarchy as hi

SCHEMA = "type string, src string, dst string, repo string"


def reach(links):
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    nodes = {x for p in links for x in p}
    full = {}
    for n in nodes:
        seen, todo = set(), list(out.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        full[n] = seen
    return full


def brute_cycles(links):
    full = reach(links)
    return {(min(m for m in full if m in full[n] and n in full[m]), n) for n in full if n in full[n]}


def random_links(seed):
    r = random.Random(seed)
    names = [f"{i:03x}" for i in range(60)]
    links = [(names[r.randrange(i)], names[i]) for i in range(1, 40)]
    links += [(r.choice(names), r.choice(names)) for _ in range(6)]
    links += [(names[i], names[i + 1]) for i in range(45, 55)] + [(names[55], names[45])]
    return links


@pytest.mark.parametrize(("seed", "local", "one_task"), [(1, 200_000, 1_000_000), (2, 5, 1_000_000), (3, 5, 0)])
def test_cycles_match_brute_force(spark, seed, local, one_task):
    links = random_links(seed)
    rows = [("contains", f" {a.upper()}\t", b, "r") if i % 2 else ("BELONGS_TO", b, a, "r") for i, (a, b) in enumerate(links)]
    rows += rows[:5] + [("CALLS", "000", "000", "r"), (None, "a", "b", "r"), ("CONTAINS", None, "b", "r"), ("CONTAINS", " ", "b", None)]
    got = {tuple(r) for r in hi.find_cycles(spark.createDataFrame(rows, SCHEMA), local_links=local, one_task_links=one_task).collect()}
    assert got == brute_cycles(links)


def test_self_link_is_a_cycle(spark):
    e = spark.createDataFrame([("CONTAINS", "a", "a", None), ("CONTAINS", "a", "b", None)], SCHEMA)
    assert [tuple(r) for r in hi.find_cycles(e).collect()] == [("a", "a")]


@pytest.mark.parametrize("local", [200_000, 2])
def test_paths_depth_and_descendants(spark, local):
    links = [("r", "a"), ("a", "b"), ("b", "c"), ("r", "d"), ("x", "y"), ("y", "x"), ("y", "z")]
    e = spark.createDataFrame([("CONTAINS", a, b, "q", 1) for a, b in links], SCHEMA + ", label int")
    names = spark.createDataFrame([("a", "Alpha"), ("r", "Root"), (None, "none")], "id string, name string")
    tree = {r.node_id: r for r in hi.hierarchy(e, names, local_links=local).collect()}
    assert (tree["c"].path, tree["c"].depth, tree["c"].root_id) == ("Root/Alpha/b/c", 3, "r")
    assert (tree["r"].path, tree["r"].depth) == ("Root", 0)
    assert tree["x"].on_cycle and tree["y"].on_cycle and tree["z"].below_cycle
    assert (tree["z"].path, tree["z"].depth, tree["z"].root_id, tree["x"].depth) == ("y/z", 1, "y", 0)
    pairs = {tuple(r) for r in hi.descendants(hi.hierarchy(e, local_links=local)).collect()}
    assert ("r", "c", 3) in pairs and ("b", "c", 1) in pairs and ("y", "z", 1) in pairs and len(pairs) == 8


def test_every_parent_has_a_row(spark):
    links = [("r", "a"), ("r", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "c")]
    e = spark.createDataFrame([("CONTAINS", a, b, None) for a, b in links], SCHEMA)
    rows = {(r.node_id, r.parent_id): r for r in hi.hierarchy(e).collect()}
    assert set(rows) == {(b, a) for a, b in links} | {("r", None)}
    assert [rows["c", p].path for p in "aby"] == ["r/a/c", "r/b/c", "y/c"] and [rows["c", p].primary for p in "aby"] == [True, False, False]
    assert rows["c", "y"].below_cycle and not rows["c", "a"].below_cycle and rows["d", "c"].path == "r/a/c/d"


def test_links_without_a_repository_share_the_work(spark):
    links = spark.range(20_000).selectExpr("'CONTAINS' as type", "cast(id div 7 as string) as src", "cast(id + 1 as string) as dst")
    heads = hi._heads(hi.parent_links(links), 500).persist()
    parts = hi._parts(heads, 500)
    sizes = [r["count"] for r in heads.repartition(parts, "shard").groupBy(hi.F.spark_partition_id()).count().collect()]
    assert heads.select("shard").distinct().count() >= 30 and len(sizes) > 20 and max(sizes) < 5_000


def test_deep_chain(spark):
    links = [(f"{i:04x}", f"{i + 1:04x}") for i in range(300)]
    e = spark.createDataFrame([("CONTAINS", a, b, None) for a, b in links], SCHEMA)
    assert hi.hierarchy(e, local_links=20).agg({"depth": "max"}).first()[0] == 300


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert hi.find_cycles(e).count() == 0
    assert hi.hierarchy(e).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_descendants_match_brute_force(spark, seed):
    links = [*random_links(seed), ("000", "03a"), ("02a", "03a"), ("03a", "03b"), ("03b", "03a"), ("03b", "03c"), ("03c", "03c")]
    rows = [("contains", f" {a.upper()}\t", b, "r") if i % 2 else ("BELONGS_TO", b, a, "r") for i, (a, b) in enumerate(links)]
    got = {(r.ancestor_id, r.node_id): r.distance for r in hi.all_descendants(spark.createDataFrame(rows + rows[:5], SCHEMA)).collect()}
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    want = {}
    for a in out:
        front, d = {a}, 0
        seen = {a}
        while front:
            d += 1
            front = {y for x in front for y in out.get(x, ())} - seen
            seen |= front
            want.update({(a, y): d for y in front})
    assert got == want and set(got) == {(a, b) for a, bs in reach(links).items() for b in bs if a != b}


@pytest.mark.parametrize(("local", "one_task"), [(200_000, 40), (30, 40), (30, 0)])
def test_many_junctions_match_brute_force(spark, local, one_task):
    r = random.Random(local + one_task)
    names = [f"{i:03x}" for i in range(240)]
    # groups of mutual links within a repository, a wide acyclic rest, and a few links between the repositories
    links = [(names[a], names[b]) for g in range(8) for a, b in ((r.randrange(g * 30, g * 30 + 30), r.randrange(g * 30, g * 30 + 30)) for _ in range(45))]
    links += [(names[r.randrange(g * 30, g * 30 + 30)], names[(g * 30 + 37) % 240]) for g in range(7)] + [("fff", "fff"), (names[1], "fff")]
    links += [(f"x{i:03}", f"x{j:03}") for i in range(120) for j in range(i + 1, min(i + 4, 120))]
    rows = [("CONTAINS", a, b, f"repo{int(a[-3:], 16) // 30}" if a[0] != "x" else "x") for a, b in links]
    got = [tuple(x) for x in hi.find_cycles(spark.createDataFrame(rows, SCHEMA), local_links=local, one_task_links=one_task).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_cycles(links)


def test_what_no_cycle_needs_is_cut_until_one_task_suffices(spark, monkeypatch):
    seen = []
    inner = hi._components
    monkeypatch.setattr(hi, "_components", lambda links, n, most: seen.append(n) or inner(links, n, most))
    # a thousand links of a tree, a ring in each of two places, the rings in one ring
    links = [(f"t{i // 2}", f"t{i}") for i in range(1, 1000)] + [(f"{p}{i}", f"{p}{(i + d) % 30}") for p in "ab" for i in range(30) for d in (1, 2)] + [("a0", "b0"), ("b1", "a1"), ("b0", "t3")]
    df = spark.createDataFrame(links, "a string, b string")
    places = spark.createDataFrame(sorted({(x, int(x[0] == "a")) for p in links for x in p}), "node string, shard long")
    got = {r.node: r.component for r in hi.components_with_cycles(df, 10, places).collect()}
    want = {n: c for c, n in brute_cycles(links)}
    assert got == want
    assert seen[0] <= 10
