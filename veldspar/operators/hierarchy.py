"""Parent-child links as whole trees: paths, roots, descendants and cycles.

Method: weighted disjoint-set forests. The links of one group (a repository,
or a salted part of a large one) meet in one partition, where every node is
tied to the top of its local tree together with its distance from it. What is
left are pointers between partitions; they are merged by pointer doubling,
which halves the distance to the top in each round. A node whose pointer
never comes to an end hangs below a cycle.

For cycles, nodes with several parents ("junctions") end a local tree. Between junctions
only the chains of single parents are left, so cycles through junctions are
strongly connected components of a graph with a node for each junction.

Nulls: a link without type, parent or child is no link. Ids are trimmed and in
lower case, repeated links count once, other columns are ignored. Where there
is no link at all the results are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.functions.keys import norm_id, trimmed
from veldspar.session import checkpointed, released

#: Links of one group that may meet in one partition; larger groups are salted.
LOCAL_LINKS = 200_000
#: Contracted links up to which components are found in one task: no more than a partition holds anyway.
ONE_TASK_LINKS = LOCAL_LINKS

_STEP = "node string, ptr string, dist long, kind int, ids array<string>, labels array<string>"
# kinds of a pointer: its end is a top or lies elsewhere, is a cycle the node is on, is a cycle above the node
END, ON, BELOW = 0, 1, 2


def parent_links(edges: DataFrame, types: dict[str, bool] | None = None) -> DataFrame:
    """Distinct (child, parent, hint) of the edges whose type is a link.

    ``types`` gives for each type whether ``src`` is the parent. ``hint`` is a
    repository in which the link occurs (null if there is no such column); it
    only steers which links meet in a partition.
    """
    types = types or {"CONTAINS": True, "BELONGS_TO": False}
    kind = F.upper(trimmed("type"))
    down = kind.isin(*[t for t, d in types.items() if d])
    return (
        edges.where(kind.isin(*types))
        .select(
            F.when(down, norm_id("dst")).otherwise(norm_id("src")).alias("child"),
            F.when(down, norm_id("src")).otherwise(norm_id("dst")).alias("parent"),
            (F.col("repo") if "repo" in edges.columns else F.lit(None).cast("string")).alias("hint"),
        )
        .where(F.col("child").isNotNull() & F.col("parent").isNotNull())
        .groupBy("child", "parent")
        .agg(F.min("hint").alias("hint"))
    )


def _heads(links: DataFrame, local_links: int) -> DataFrame:
    """(child, parent, n_parents, shard): the least parent of each child.

    Children of one hint, the null one too, share a shard; more of them than
    ``local_links`` are salted.
    """
    hint = F.coalesce("hint", F.lit("")).alias("hint")
    heads = links.groupBy("child").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_parents"), F.min("hint").alias("hint")).withColumn("hint", hint)
    salts = heads.groupBy("hint").agg(F.ceil(F.count(F.lit(1)) / local_links).alias("salts")).where("salts > 1")
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("child"), F.col("salts"))).otherwise(F.lit(0))
    return heads.join(F.broadcast(salts), "hint", "left").select("child", "parent", "n_parents", F.xxhash64("hint", salt).alias("shard"))  # at most links / local_links rows of salts


def _parts(heads: DataFrame, local_links: int) -> int:
    """Partitions for the shards of ``heads``, so that each holds a shard or two of full size."""
    return max(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * heads.count() // local_links))


def _compress(parent: dict[str, str], label: dict[str, str] | None) -> Iterator[tuple]:
    """Rows of ``_STEP`` for the links of one partition.

    ``ids`` and ``labels`` are those from below the pointer down to the node,
    and stay null without ``label``.
    """
    done: dict[str, tuple] = {}
    for start in parent:
        chain, at = [], start
        seen: dict[str, int] = {}
        while at in parent and at not in done and at not in seen:
            seen[at] = len(chain)
            chain.append(at)
            at = parent[at]
        if at in seen:  # a new cycle
            cycle = chain[seen[at] :]
            least = min(cycle)
            for x in cycle:
                done[x] = (least, 0, ON, None, None)
            chain = chain[: seen[at]]
        if at in done:
            ptr, dist, kind, ids, labels = done[at]
            if kind == ON:
                kind, dist = BELOW, 0
        else:
            ptr, dist, kind, ids, labels = at, 0, END, [], []
        for x in reversed(chain):
            dist += 1
            if kind == END and label is not None:
                ids, labels = [*ids, x], [*labels, label.get(x) or x]
            done[x] = (ptr, dist, kind, ids, labels)
    for x, (ptr, dist, kind, ids, labels) in done.items():
        yield x, ptr, dist, kind, *((ids, labels) if label is not None else (None, None))


def _local_forest(heads: DataFrame, with_paths: bool, parts: int) -> DataFrame:
    """One pass over the partitions: every child with its local pointer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[str, str] = {}
        label: dict[str, str] | None = {} if with_paths else None
        for b in batches:
            parent.update(zip(b["child"], b["parent"], strict=True))
            if label is not None:
                label.update(zip(b["child"], b["label"], strict=True))
        out: list[tuple] = []
        for row in _compress(parent, label):
            out.append(row)
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=["node", "ptr", "dist", "kind", "ids", "labels"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["node", "ptr", "dist", "kind", "ids", "labels"])

    columns = ["child", "parent", *(["label"] if with_paths else [])]
    return heads.repartition(parts, "shard").select(*columns).mapInPandas(run, _STEP)


def _doubled(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers followed to their ends, and those that never end.

    A round joins the open pointers with themselves. A pointer that ends at
    distance d is closed after log2(d) rounds; when a round closes none, all
    that are left lead into a cycle that no partition saw as a whole.
    """
    steps = checkpointed(steps)
    # open: the pointer's end is itself a child, so there is more above it
    inner = steps.select(F.col("node").alias("ptr"), F.lit(True).alias("_open"))
    open_ = steps.where(F.col("kind") == END).join(inner, "ptr", "left_semi").select(*steps.columns)
    left = open_.count()
    if not left:
        return steps, open_
    closed = steps.join(open_.select("node"), "node", "left_anti")
    open_ = checkpointed(open_)
    while left:
        up = closed.select(F.col("node").alias("ptr"), F.col("ptr").alias("u_ptr"), F.col("dist").alias("u_dist"), F.col("kind").alias("u_kind"), F.col("ids").alias("u_ids"), F.col("labels").alias("u_labels"), F.lit(True).alias("u_done"))
        up = up.unionByName(open_.select(F.col("node").alias("ptr"), F.col("ptr").alias("u_ptr"), F.col("dist").alias("u_dist"), F.col("kind").alias("u_kind"), F.col("ids").alias("u_ids"), F.col("labels").alias("u_labels"), F.lit(False).alias("u_done")))
        far = checkpointed(
            open_.join(up, "ptr").select(
                "node", F.col("u_ptr").alias("ptr"), (F.col("dist") + F.col("u_dist")).alias("dist"), F.when(F.col("u_kind") == END, END).otherwise(BELOW).cast("int").alias("kind"),
                F.concat("u_ids", "ids").alias("ids"), F.concat("u_labels", "labels").alias("labels"), "u_done",
            )
        )
        closed = closed.unionByName(far.where("u_done").drop("u_done"))
        open_ = far.where("not u_done").drop("u_done")
        still = open_.count()
        if still == left:
            break
        left = still
    return closed, open_


def _cycles_by_doubling(links: DataFrame) -> DataFrame:
    """(node_id, cycle_id) of the cycles among (child, parent), one parent each.

    Every node leads into a cycle. Jumps of 2^k steps map the nodes onto ever
    fewer ones; once their number stands still these are the nodes on cycles.
    """
    at = checkpointed(links.select(F.col("child").alias("node"), F.col("parent").alias("ptr"), F.col("child").alias("low")))
    before = (-1, "")
    while True:
        ends = at.select(F.col("ptr").alias("node")).distinct()
        now = (ends.count(), at.join(ends, "node", "left_semi").agg(F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()[0])
        if now == before:
            return at.join(ends, "node", "left_semi").select(F.col("node").alias("node_id"), F.col("low").alias("cycle_id"))
        before = now
        up = at.select(F.col("node").alias("ptr"), F.col("ptr").alias("u_ptr"), F.col("low").alias("u_low"))
        at = checkpointed(at.join(up, "ptr").select("node", F.col("u_ptr").alias("ptr"), F.least("low", "u_low").alias("low")))


def _tarjan(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Node -> least node of its component, of components with a cycle."""
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    found: dict[str, str] = {}
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, successors = work[-1]
            for w in successors:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        group.append(w)
                        if w == v:
                            break
                    if len(group) > 1 or v in out[v]:
                        least = min(group)
                        found.update(dict.fromkeys(group, least))
    return found


def _trimmed(links: DataFrame, n: int, enough: int) -> tuple[DataFrame, int]:
    """``links`` without nodes that have no link in or none out, and their number.

    Rounds go on while they cut off a tenth or more, and down to ``enough``.
    """
    while n > enough:
        into, out_of = links.select(F.col("b").alias("a")).distinct(), links.select(F.col("a").alias("b")).distinct()
        left = checkpointed(links.join(into, "a", "left_semi").join(out_of, "b", "left_semi").select("a", "b"))
        released(links)
        links, before, n = left, n, left.count()
        if n > 0.9 * before:
            break
    return links, n


def _components_in_places(links: DataFrame, places: DataFrame, local_links: int) -> DataFrame:
    """(node, component) of the components that the links within one place make.

    ``places`` is (node, shard). Where a shard has more links than
    ``local_links`` its nodes are salted, k ways for k * k times as many, since
    a link stays if both its nodes do. No node is in two places.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _tarjan([pair for b in batches for pair in zip(b["a"], b["b"], strict=True)])
        yield pd.DataFrame(list(found.items()), columns=["node", "component"])

    at = lambda node, shard: places.select(F.col("node").alias(node), F.col("shard").alias(shard))
    near = checkpointed(links.join(at("a", "shard"), "a").join(at("b", "_to"), "b").where("shard = _to").select("a", "b", "shard"))
    salts = near.groupBy("shard").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / local_links)).alias("salts")).where("salts > 1")
    salted = near.join(F.broadcast(salts), "shard", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))  # at most links / local_links rows of salts
    salt = lambda c: F.pmod(F.xxhash64(c), F.col("salts"))
    placed = salted.where(salt("a") == salt("b")).select("a", "b", F.xxhash64("shard", salt("a")).alias("shard"))
    found = checkpointed(placed.repartition(_parts(near, local_links), "shard").select("a", "b").mapInPandas(run, "node string, component string"))
    released(near)
    return found


def _merged(links: DataFrame, found: DataFrame) -> DataFrame:
    """``links`` with each component of ``found`` (node, component) as one node, without those inside it."""
    to = lambda node, c: found.select(F.col("node").alias(node), F.col("component").alias(c))
    ends = links.join(to("a", "_ca"), "a", "left").join(to("b", "_cb"), "b", "left").where("_ca is null or _cb is null or _ca <> _cb")
    return checkpointed(ends.select(F.coalesce("_ca", "a").alias("a"), F.coalesce("_cb", "b").alias("b")).distinct())


def components_with_cycles(links: DataFrame, one_task_links: int = ONE_TASK_LINKS, places: DataFrame | None = None, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, component) of the strongly connected components that hold a cycle.

    ``links`` is (a, b). Up to ``one_task_links`` one task finds them in one
    pass. Of more, nodes with no link in or out are cut off, and with ``places``
    (node, shard) what is a component within its shard becomes one node, until
    what is left fits one task. If it never does, colours spread.
    """
    links = checkpointed(links.select("a", "b").distinct())
    links, n = _trimmed(links, links.count(), one_task_links)
    if n <= one_task_links or places is None:
        return _components(links, n, one_task_links)
    found = _components_in_places(links, places, local_links)
    left = _merged(links, found)
    released(links)
    left, n = _trimmed(left, left.count(), one_task_links)
    rest = checkpointed(_components(left, n, one_task_links))
    released(left)
    wider = rest.select(F.col("node").alias("component"), F.col("component").alias("_wider"))
    whole = found.join(wider, "component", "left").select("node", F.coalesce("_wider", "component").alias("component"))
    return whole.unionByName(rest.join(found.select("node"), "node", "left_anti"))


def _components(links: DataFrame, n: int, one_task_links: int) -> DataFrame:
    """(node, component) of the components among ``n`` links, in one task or by colours.

    Colours spread along the links: nodes with no link in or out are cut off,
    the least id spreads forward until it stands still, and what reaches the
    colour's own node against the links is its component.
    """
    if n <= one_task_links:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(list(_tarjan(list(zip(pdf["a"], pdf["b"], strict=True))).items()), columns=["node", "component"])

        return links.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, "node string, component string")
    out = None
    while True:
        while True:  # trim
            n = links.count()
            links = checkpointed(links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            if links.count() == n:
                break
        if not n:
            break
        colour = checkpointed(links.select(F.col("a").alias("node"), F.col("a").alias("c")).distinct())
        while True:
            spread = colour.unionByName(links.join(colour.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "c")).groupBy("node").agg(F.min("c").alias("c"))
            new = checkpointed(spread)
            changed = not new.join(colour, ["node", "c"], "left_anti").isEmpty()
            colour = new
            if not changed:
                break
        same = checkpointed(links.join(colour.withColumnsRenamed({"node": "a", "c": "ca"}), "a").join(colour.withColumnsRenamed({"node": "b", "c": "cb"}), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")))
        reach = front = checkpointed(colour.where("node = c"))
        while not front.isEmpty():
            front = checkpointed(same.join(front.withColumnRenamed("node", "b"), ["b", "c"]).select(F.col("a").alias("node"), "c").distinct().join(reach, ["node", "c"], "left_anti"))
            reach = checkpointed(reach.unionByName(front))
        real = same.join(reach.withColumnsRenamed({"node": "a"}), ["a", "c"], "left_semi").join(reach.withColumnsRenamed({"node": "b"}), ["b", "c"], "left_semi")
        part = real.select(F.col("a").alias("node"), F.col("c").alias("component")).unionByName(real.select(F.col("b").alias("node"), F.col("c").alias("component"))).distinct()
        out = part if out is None else out.unionByName(part)
        gone = reach.select(F.col("node").alias("a"))
        links = checkpointed(links.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"))
    return out if out is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)


def _marked_chains(heads: DataFrame, marks: DataFrame, parts: int) -> DataFrame:
    """(node, component) of all nodes from each mark up to the next junction.

    ``marks`` is (node, component). A pass climbs within the partitions that
    hold marks; climbs that leave a partition go on in the next pass.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[str, str] = {}
        starts: list[tuple[str, str]] = []
        for b in batches:
            link = b[b["component"].isna()]
            parent.update(zip(link["child"], link["parent"], strict=True))
            mark = b[b["component"].notna()]
            starts += zip(mark["child"], mark["component"], strict=True)
        seen: set[tuple[str, str]] = set()
        on: set[tuple[str, str]] = set()
        for at, c in starts:
            while at in parent and (at, c) not in seen:
                seen.add((at, c))
                at = parent[at]
            if at not in parent:
                on.add((at, c))
        yield pd.DataFrame([(a, c, True) for a, c in seen] + [(a, c, False) for a, c in on], columns=["node", "component", "here"])

    single = heads.where("n_parents = 1").select("child", "parent", "shard")
    out, reached = None, marks
    while True:
        placed = checkpointed(reached.withColumnRenamed("node", "child").join(single.select("child", "shard"), "child").select("child", F.lit(None).cast("string").alias("parent"), "shard", "component"))
        if placed.isEmpty():
            return out if out is not None else marks.limit(0)
        near = single.join(placed.select("shard").distinct(), "shard", "left_semi").withColumn("component", F.lit(None).cast("string"))
        climbed = checkpointed(near.unionByName(placed).repartition(parts, "shard").select("child", "parent", "component").mapInPandas(run, "node string, component string, here boolean"))
        found = climbed.where("here").select("node", "component").distinct()
        if out is not None:
            found = found.join(out, ["node", "component"], "left_anti")
        out = checkpointed(found if out is None else out.unionByName(found))
        reached = climbed.where("not here").select("node", "component").distinct()


def find_cycles(edges: DataFrame, types: dict[str, bool] | None = None, local_links: int = LOCAL_LINKS, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """(cycle_id, node_id): nodes that reach themselves from parent to child.

    ``cycle_id`` is the least id of those that reach the node and are reached
    by it, itself included. A node that is its own parent is such a case.
    """
    links = checkpointed(parent_links(edges, types))
    heads = checkpointed(_heads(links, local_links))
    single, parts = heads.where("n_parents = 1"), _parts(heads, local_links)
    ends, endless = _doubled(_local_forest(single, False, parts))
    found = ends.where(F.col("kind") == ON).select(F.col("ptr").alias("cycle_id"), F.col("node").alias("node_id"))
    if not endless.isEmpty():
        crossing = endless.select(F.col("node").alias("child")).join(single, "child").select("child", "parent")
        found = found.unionByName(_cycles_by_doubling(crossing).select("cycle_id", "node_id"))
    junctions = heads.where("n_parents > 1").select(F.col("child").alias("b"))
    climbs = links.select(F.col("child").alias("b"), F.col("parent").alias("p")).join(junctions, "b", "left_semi")
    is_junction = junctions.select(F.col("b").alias("a"))
    tops = ends.where(F.col("kind") == END).select(F.col("node").alias("p"), F.col("ptr").alias("a"))
    # a junction's parent is a junction itself, or hangs below one
    contracted = checkpointed(climbs.join(tops, "p", "left").select("b", "p", F.coalesce("a", "p").alias("a")).join(is_junction, "a", "left_semi").select("a", "b", "p"))
    if contracted.isEmpty():
        return found
    places = heads.where("n_parents > 1").select(F.col("child").alias("node"), "shard")
    groups = checkpointed(components_with_cycles(contracted, one_task_links, places, local_links))
    inside = contracted.join(groups.withColumnsRenamed({"node": "a", "component": "ca"}), "a").join(groups.withColumnsRenamed({"node": "b", "component": "cb"}), "b").where("ca = cb")
    chains = _marked_chains(heads, checkpointed(inside.where("p <> a").select(F.col("p").alias("node"), F.col("ca").alias("component")).distinct()), parts)
    members = groups.unionByName(chains)
    least = members.groupBy("component").agg(F.min("node").alias("cycle_id"))
    return found.unionByName(members.join(least, "component").select("cycle_id", F.col("node").alias("node_id")))


def _on_cycles(heads: DataFrame, parts: int) -> DataFrame | None:
    """(node, cycle_id) of the children that reach themselves through least parents; null if there is none."""
    ends, endless = _doubled(_local_forest(heads, False, parts))
    near = ends.where(F.col("kind") == ON).select("node", F.col("ptr").alias("cycle_id"))
    if not endless.isEmpty():
        crossing = endless.select(F.col("node").alias("child")).join(heads, "child").select("child", "parent")
        near = near.unionByName(_cycles_by_doubling(crossing).select(F.col("node_id").alias("node"), "cycle_id"))
    near = checkpointed(near)
    return None if near.isEmpty() else near


def hierarchy(edges: DataFrame, names: DataFrame | None = None, types: dict[str, bool] | None = None, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node_id, parent_id, primary, root_id, depth, path_ids, path, on_cycle, below_cycle): a row per node and parent.

    ``primary`` marks the row of a node's least parent; the paths of the others
    lead through that parent and on through least parents. A root has no
    parent, depth 0 and itself as path. A node on a cycle of least parents is
    the root of its own path and of what hangs below it (``below_cycle``);
    :func:`find_cycles` finds cycles through other parents too. ``names`` is
    (id, name) with one row per id; a node without a name goes by its id.
    """
    links = checkpointed(parent_links(edges, types))
    named = None if names is None else names.select(norm_id("id").alias("node"), F.col("name").alias("label")).where("node is not null").groupBy("node").agg(F.max("label").alias("label"))

    def labelled(nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("label", F.lit(None).cast("string")) if named is None else nodes.join(named, "node", "left")

    heads = checkpointed(labelled(_heads(links, local_links).withColumnRenamed("child", "node")).withColumnRenamed("node", "child"))
    parts = _parts(heads, local_links)
    on = _on_cycles(heads, parts)
    tops = links.select(F.col("parent").alias("node")).distinct().join(heads.select(F.col("child").alias("node")), "node", "left_anti")
    tops = labelled(tops).select("node", F.coalesce("label", "node").alias("top"), F.lit(False).alias("cyclic"))
    inner = heads
    if on is not None:  # cut off above them, the rest is a forest
        inner = checkpointed(heads.join(on.select(F.col("node").alias("child")), "child", "left_anti"))
        tops = tops.unionByName(labelled(on.select("node")).select("node", F.coalesce("label", "node").alias("top"), F.lit(True).alias("cyclic")))
    tops = checkpointed(tops)
    ends, _ = _doubled(_local_forest(inner, True, parts))
    below = ends.join(tops.withColumnRenamed("node", "ptr"), "ptr").select("node", F.col("ptr").alias("root_id"), F.col("dist").alias("depth"), F.concat(F.array("ptr"), "ids").alias("path_ids"), F.concat(F.array("top"), "labels").alias("path"), F.lit(False).alias("on_cycle"), F.col("cyclic").alias("below_cycle"))
    own = tops.select("node", F.col("node").alias("root_id"), F.lit(0).cast("long").alias("depth"), F.array("node").alias("path_ids"), F.array("top").alias("path"), F.col("cyclic").alias("on_cycle"), F.lit(False).alias("below_cycle"))
    tree = checkpointed(below.unionByName(own))
    columns = ["node_id", "parent_id", "primary", "root_id", "depth", "path_ids", "path", "on_cycle", "below_cycle"]
    first = tree.join(heads.select(F.col("child").alias("node"), F.col("parent").alias("parent_id")), "node", "left").withColumn("primary", F.lit(True)).withColumnRenamed("node", "node_id")
    ends_at = tree.select(F.col("node").alias("node_id"), F.element_at("path", -1).alias("_label"), "on_cycle")
    other = links.join(heads.select("child", "parent"), ["child", "parent"], "left_anti").select(F.col("child").alias("node_id"), F.col("parent").alias("node"))
    more = other.join(tree.withColumnRenamed("on_cycle", "_on"), "node").join(ends_at, "node_id")
    more = more.select(
        "node_id", F.col("node").alias("parent_id"), F.lit(False).alias("primary"), "root_id", (F.col("depth") + 1).alias("depth"), F.concat("path_ids", F.array("node_id")).alias("path_ids"), F.concat("path", F.array("_label")).alias("path"),
        "on_cycle", (F.col("below_cycle") | F.col("_on")).alias("below_cycle"),
    )
    return first.select(*columns).unionByName(more.select(*columns)).withColumn("path", F.array_join("path", "/"))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) of the trees from :func:`hierarchy`.

    A row for each node on the primary path above each node; read off the
    paths, without another join. For all links see :func:`all_descendants`.
    """
    return (
        tree.where("primary and size(path_ids) > 1")
        .select("node_id", F.size("path_ids").alias("_n"), F.posexplode("path_ids").alias("_at", "ancestor_id"))
        .where(F.col("_at") < F.col("_n") - 1)
        .select("ancestor_id", "node_id", (F.col("_n") - 1 - F.col("_at")).cast("long").alias("distance"))
    )


def all_descendants(edges: DataFrame, types: dict[str, bool] | None = None) -> DataFrame:
    """(ancestor_id, node_id, distance): every node that another reaches from parent to child.

    Over all links, those of several parents and of cycles too. ``distance`` is
    the least number of links. That a node on a cycle reaches itself is left to
    :func:`find_cycles`.

    A round doubles the distance: a pair beyond 2^k has a node at 2^k links from
    its ancestor, so the pairs at 2^k are joined with all that are known.
    """
    found = checkpointed(parent_links(edges, types).select(F.col("parent").alias("ancestor_id"), F.col("child").alias("node_id"), F.lit(1).cast("long").alias("distance")).where("ancestor_id <> node_id"))
    reach = 1
    while True:
        far = found.where(F.col("distance") == reach).withColumnRenamed("node_id", "_via").withColumnRenamed("distance", "_up")
        near = found.withColumnRenamed("ancestor_id", "_via")
        grown = far.join(near, "_via").where("ancestor_id <> node_id").groupBy("ancestor_id", "node_id").agg(F.min(F.col("_up") + F.col("distance")).alias("distance"))
        new = checkpointed(grown.join(found.select("ancestor_id", "node_id"), ["ancestor_id", "node_id"], "left_anti"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        reach *= 2
