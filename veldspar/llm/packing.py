"""Items packed into containers of fixed capacity, as full as can be.

An item is split only if it alone exceeds the capacity: into parts of just
that size and a rest.

Method: pattern packing by non-negative least squares. The histogram of
lengths is all that is needed to plan: patterns of up to four documents that
fill a container are enumerated over length classes; how often to use each is
fitted to the histogram by non-negative least squares and rounded down; the
slots are filled with exact lengths from long to short; what remains goes,
longest first, into the tightest room left, at first into the room that the
patterns left over. The plan's size depends on the capacity (the number of
different lengths), not on the number of items.

The items are then ranked among those of equal length, and an item's rank says
which slot of which container it takes; no container is gathered anywhere.

Nulls: an item without a positive length must be given one by the caller. An
item without container class, key or a capacity of at least 1 gives no row.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.operators.prefix import running

#: Length classes and documents of an enumerated pattern.
CLASSES, DOCS = 60, 4
#: Lengths of a container's items that the plan tells apart, which bounds it on the driver.
MAX_SIZES = 4_000_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with least |a x - b|, by active sets."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-6 * (1 + np.abs(b).max()):
            break
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if (z > 1e-9).all():
                x[:] = 0
                x[idx] = z
                break
            low = z <= 1e-9
            step = np.min(x[idx][low] / np.maximum(x[idx][low] - z[low], 1e-12))
            x[idx] += step * (z - x[idx])
            active[idx[x[idx] <= 1e-9]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(classes: int, docs: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``docs`` class sizes (1..classes) that add up to ``classes``."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, most: int, have: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(have)
        elif len(have) < docs:
            for c in range(min(rest, most), 0, -1):
                if c * (docs - len(have)) < rest:
                    break
                grow(rest - c, c, (*have, c))

    grow(classes, classes, ())
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a container, how many such) for lengths of 1..capacity."""
    left = {k: n for k, n in histogram.items() if n > 0}
    if not left:
        return []
    classes = min(CLASSES, capacity)
    width = capacity / classes
    of = lambda length: min(classes, int(np.ceil(length / width - 1e-9)))
    h = np.zeros(classes)
    by_class: dict[int, list[int]] = {}
    for length in sorted(left):
        h[of(length) - 1] += left[length]
        by_class.setdefault(of(length), []).append(length)
    present = {c for c in by_class}
    shapes = [p for p in patterns(classes, DOCS) if present.issuperset(p)]
    packs: list[list] = []
    if shapes:
        a = np.zeros((classes, len(shapes)))
        for j, p in enumerate(shapes):
            for c in p:
                a[c - 1, j] += 1
        for j in np.argsort(-(x := nnls(a, h))):
            times = int(x[j])
            while times > 0:
                pick: list[int] = []
                for c in shapes[j]:
                    lens = by_class[c]
                    k = next((i for i in range(len(lens) - 1, -1, -1) if left[lens[i]] > pick.count(lens[i])), None)
                    if k is None:
                        break
                    pick.append(lens[k])
                if len(pick) < len(shapes[j]):
                    break
                n = min(times, *(left[v] // pick.count(v) for v in set(pick)))
                for v in pick:
                    left[v] -= n
                for c in set(shapes[j]):
                    while by_class[c] and left[by_class[c][-1]] == 0:
                        by_class[c].pop()
                packs.append([capacity - sum(pick), tuple(pick), n])
                times -= n
    rooms: dict[int, list[list]] = {}
    for room, lens, n in packs:
        rooms.setdefault(room, []).append([lens, n])
    order = sorted(rooms)
    full: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, lens: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            bisect.insort(order, room)
            rooms[room] = []
        rooms[room].append([lens, n])

    for length in sorted((v for v in left if left[v]), reverse=True):
        n = left[length]
        while n:
            i = bisect.bisect_left(order, length)
            if i < len(order):
                room = order[i]
                lens, have = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[i]
                fit = min(room // length, n)
                if fit * have <= n:
                    take, each = have, fit
                else:
                    each = fit if n >= fit else n
                    take = n // each
                if take < have:
                    put(room, lens, have - take)
                put(room - each * length, (*lens, *[length] * each), take)
                n -= take * each
            else:
                each = min(capacity // length, n)
                put(capacity - each * length, (length,) * each, n // each)
                n -= n // each * each
    for cells in rooms.values():
        full += [(lens, n) for lens, n in cells]
    return full


def packed(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(box, key, part, length, call) for every part of every item.

    ``items`` is (box, key, length): ``box`` names the kind of container,
    whose size is ``capacities[box]``. ``call`` numbers the containers of a
    kind from 0. Equal rows of ``items`` are one item. Containers above
    ``MAX_SIZES`` are planned in units of several tokens, lengths rounded up.
    """
    spark = items.sparkSession
    capacities = {box: c for box, c in capacities.items() if c >= 1}
    units = {box: -(-c // MAX_SIZES) for box, c in capacities.items()}
    sizes = F.broadcast(spark.createDataFrame([(box, c, units[box]) for box, c in sorted(capacities.items())], "box string, _cap long, _unit long"))
    one = items.select("box", "key", F.col("length").cast("long").alias("length")).where("key is not null and length >= 1").distinct().join(sizes, "box")
    parts = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / F.col("_cap")) - 1))).select(
        "box", "key", F.col("part").cast("int").alias("part"), F.least(F.col("_cap"), F.col("length") - F.col("part") * F.col("_cap")).alias("length"), "_cap", "_unit"
    )
    # a part that rounds up beyond the container has it for itself
    size = F.least(F.ceil(F.col("length") / F.col("_unit")), F.expr("_cap div _unit")).cast("long")
    parts = parts.select("box", "key", "part", F.col("length").alias("_tokens"), size.alias("length"))
    counts = parts.groupBy("box", "length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the sum of the capacities
    slots: list[tuple[str, int, int, int, int]] = []  # box, length, first rank, first call, items of this length in a call
    for box in sorted(capacities):
        taken: dict[int, int] = {}
        call = 0
        for lens, n in plan({r.length: r.n for r in counts if r.box == box}, capacities[box] // units[box]):
            for length in sorted(set(lens)):
                m = lens.count(length)
                slots.append((box, length, taken.get(length, 0), call, m))
                taken[length] = taken.get(length, 0) + n * m
            call += n
    slots.sort(key=lambda s: s[:3])
    shared = spark.sparkContext.broadcast(slots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.DataFrame(shared.value, columns=["box", "length", "from", "call", "each"])
        group = {k: i for i, k in enumerate(dict.fromkeys(zip(table["box"], table["length"], strict=True)))}
        big = 1 << 40
        at = np.array([group[k] for k in zip(table["box"], table["length"], strict=True)], np.int64) * big + table["from"].to_numpy(np.int64)
        first, base, each = (table[c].to_numpy(np.int64) for c in ("from", "call", "each"))
        for b in batches:
            if not len(b):
                continue
            mine = np.array([group[k] for k in zip(b["box"], b["length"], strict=True)], np.int64) * big + b["_rank"].to_numpy(np.int64)
            j = np.searchsorted(at, mine, side="right") - 1
            b["call"] = base[j] + (b["_rank"].to_numpy(np.int64) - first[j]) // each[j]
            b["length"] = b["_tokens"]
            yield b[["box", "key", "part", "length", "call"]]

    return running(parts, ["box", "length"], ["key", "part"]).select("box", "key", "part", "length", "_tokens", "_rank").mapInPandas(run, "box string, key string, part int, length long, call long")


def fills(parts: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(box, call, n_items, used, capacity, fill) per container."""
    sizes = F.broadcast(parts.sparkSession.createDataFrame(sorted(capacities.items()), "box string, capacity long"))
    return parts.groupBy("box", "call").agg(F.count(F.lit(1)).alias("n_items"), F.sum("length").alias("used")).join(sizes, "box").withColumn("fill", F.round(F.col("used") / F.col("capacity"), 6))
