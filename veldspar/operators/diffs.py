"""Unified diffs as tables of lines."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unified(versions: DataFrame) -> DataFrame:
    """(diff_id, text): the unified diff of ``versions`` (diff_id, relpath, old, new); null stands for no file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                old, new = (None if x is None or x != x else x for x in (r.old, r.new))
                names = ("/dev/null" if old is None else f"a/{r.relpath}", "/dev/null" if new is None else f"b/{r.relpath}")
                lines = difflib.unified_diff((old or "").split("\n"), (new or "").split("\n"), *names, lineterm="")
                out.append((r.diff_id, "\n".join([f"diff --git a/{r.relpath} b/{r.relpath}", *lines])))
            yield pd.DataFrame(out, columns=["diff_id", "text"])

    return versions.select("diff_id", "relpath", "old", "new").mapInPandas(run, "diff_id string, text string")


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, old_path, pos, side, new_line, text) of every changed or context line.

    ``diffs`` is (diff_id, text). ``side`` is ``+``, ``-`` or a blank; removed
    lines and notes about a missing line end do not advance ``new_line``. Lines
    in front of the first file header have no path and are left out.
    """
    lines = diffs.where("diff_id is not null and text is not null").select("diff_id", F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "line"))
    w = W.partitionBy("diff_id").orderBy("pos")
    header = F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]+)", 1)
    before = F.regexp_extract("line", r"^--- (?:a/)?([^\t]+)", 1)
    hunk = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    marked = lines.withColumn("path", F.last(F.when(header != "", header).when(F.col("line").startswith("diff --git"), F.lit("")), ignorenulls=True).over(w)).withColumn("hunk", F.last(F.when(hunk != "", F.struct("pos", hunk.cast("int").alias("start"))).when(F.col("line").rlike("^(diff --git|--- |\\+\\+\\+ )"), F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("start"))), ignorenulls=True).over(w))
    marked = marked.withColumn("old_path", F.last(F.when((before != "") & (F.coalesce(F.col("hunk.pos"), F.lit(-1)) < 0), before), ignorenulls=True).over(w))
    body = marked.where((F.col("path") != "") & (F.col("hunk.pos") >= 0) & (F.col("pos") > F.col("hunk.pos")) & F.substring("line", 1, 1).isin("+", "-", " "))
    moves = F.when(F.substring("line", 1, 1) == "-", 0).otherwise(1)
    seen = F.coalesce(F.sum(moves).over(W.partitionBy("diff_id", "path", "hunk.pos").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return body.select("diff_id", "path", "old_path", "pos", F.substring("line", 1, 1).alias("side"), (F.col("hunk.start") + seen).cast("int").alias("new_line"), F.expr("substring(line, 2)").alias("text"))


def file_diffs(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, is_new, is_deleted, added_lines, removed_text) per file that a diff names.

    A deleted file goes by its old path, the others by their new one.
    """
    lines = diffs.where("diff_id is not null and text is not null").select("diff_id", F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "line"))
    w = W.partitionBy("diff_id").orderBy("pos")
    heads = lines.withColumn("_next", F.lead("line").over(w)).where("line like '--- %' and _next like '+++ %'")
    name = lambda c: F.regexp_extract(c, r"^(?:---|\+\+\+) (?:[ab]/)?([^\t]+)", 1)
    files = heads.select("diff_id", name("line").alias("old"), name("_next").alias("new"))
    l = diff_lines(diffs)
    body = l.groupBy("diff_id", F.col("path").alias("new"), F.when(F.col("path") == "/dev/null", F.col("old_path")).alias("gone")).agg(
        F.sort_array(F.collect_set(F.when(F.col("side") == "+", F.col("new_line")))).alias("added_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == "-", F.struct("pos", "text")))), lambda s: s["text"]), "\n").alias("removed_text"),
    )
    dead = F.col("new") == "/dev/null"
    keyed = files.select("diff_id", "new", F.when(dead, F.col("old")).alias("gone"), (F.col("old") == "/dev/null").alias("is_new"), dead.alias("is_deleted")).distinct()
    same = (keyed["diff_id"] == body["diff_id"]) & (keyed["new"] == body["new"]) & keyed["gone"].eqNullSafe(body["gone"])
    return keyed.join(body, same, "left").select(keyed["diff_id"], F.coalesce(keyed["gone"], keyed["new"]).alias("path"), "is_new", "is_deleted", F.coalesce("added_lines", F.array().cast("array<int>")).alias("added_lines"), F.coalesce("removed_text", F.lit("")).alias("removed_text"))


def changed_nodes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(diff_id, node_id, change_type, lines): definitions that hold added lines.

    The innermost definition takes a line. A line up to five below the start
    changes the signature, other lines the behaviour. ``nodes`` is (id, path,
    start_line, end_line).
    """
    lines = files.select("diff_id", "path", F.explode("added_lines").alias("line"))
    hit = lines.join(nodes, "path").where("line between start_line and end_line")
    inner = hit.groupBy("diff_id", "path", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("id").alias("id"), F.col("start_line").alias("s"))).alias("n"))
    return inner.groupBy("diff_id", F.col("n.id").alias("node_id")).agg(
        F.when(F.max(F.when(F.col("line") <= F.col("n.s") + 5, 1).otherwise(0)) == 1, "signature").otherwise("behavior").alias("change_type"), F.sort_array(F.collect_set("line")).alias("lines")
    )
