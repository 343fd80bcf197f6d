"""Chunks above a size limit, cut into overlapping pieces at natural boundaries.

A chunk's text is a span of lines of the current version of its file. The
boundaries are its line ends; a line longer than the limit is cut inside. A
piece may end at any boundary within the limit; the last place in front of a
definition in the second half of what fits is preferred, then the last line
end. The next piece begins with the last ``overlap`` lines of the piece before.

Method: pointer doubling. Every boundary is joined to its farthest legal
successor, all at once; the table is squared again and again, and a marked
set of boundaries, at first the start alone, is carried through the squares
from the largest to the smallest. This marks every greedy cut after
log2(boundaries) vector operations.

The cuts need no text: a file is sent as the array of its line lengths.
Texts join only the pieces that are written out.

Nulls: a chunk whose file is missing or has a null text has no characters and
one empty piece. A span that is null or 0 is that of its ``node_ids``; without
any it is the whole file. A limit that is null or below 1 cuts nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.functions.keys import norm_id, spelling


def greedy_cuts(successor: np.ndarray, last: int) -> np.ndarray:
    """The boundaries reached from 0 by following ``successor`` up to ``last``."""
    tables, jump = [], successor
    while True:
        tables.append(jump)
        if jump[0] >= last:
            break
        jump = jump[jump]
    marked = np.zeros(len(successor), bool)
    marked[0] = True
    for jump in reversed(tables):
        marked[jump[np.flatnonzero(marked)]] = True
    cuts = np.flatnonzero(marked)
    return cuts[cuts <= last]


def cut_lines(lengths: np.ndarray, limit: int, overlap: int, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(first line, line after the last, first line that is new) per piece.

    ``lengths`` are the characters of the lines without their ends, ``starts``
    the lines at which a definition begins. A piece's text is joined with one
    newline between lines. Every line fits the limit, or stands alone.
    """
    n = len(lengths)
    if n == 0:
        return [(0, 0, 0)]
    ends = np.concatenate([[0], np.cumsum(lengths + 1)])  # a piece of lines a..b-1 has ends[b] - ends[a] - 1 characters
    at = np.arange(n)
    # overlap lines in front of a piece, as many as leave room for the piece's first line
    fits_from = np.searchsorted(ends, ends[at + 1] - 1 - limit, side="left")
    head = np.minimum(np.maximum(at - overlap, fits_from), at)
    head[0] = 0
    reach = np.searchsorted(ends, ends[head] + limit + 1, side="right") - 1
    reach = np.clip(np.maximum(reach, at + 1), 1, n)
    if len(starts):
        before = np.searchsorted(starts, reach, side="right") - 1
        natural = np.where(before >= 0, starts[np.maximum(before, 0)], 0)
        good = (reach < n) & (natural > at) & (ends[natural] - ends[head] > limit // 2)
        reach = np.where(good, natural, reach)
    cuts = greedy_cuts(np.append(reach, n), n)
    return [(int(head[a]), int(b), int(a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def current_files(files: DataFrame) -> DataFrame:
    """(repo, relpath, lens): the line lengths of each file's current version.

    ``lens`` is null for a null text. The text itself does not leave its task.
    """
    lines = F.split("text", "\n", -1)
    lens = F.transform(lines, F.length)
    # a final newline adds no line, and an empty text has none
    lens = F.when(F.element_at(lens, -1) == 0, F.slice(lens, 1, F.size(lens) - 1)).otherwise(lens)
    return files.select("repo", "relpath", "last_indexed", F.when(F.col("text").isNotNull(), lens).alias("lens")).groupBy("repo", "relpath").agg(F.max_by("lens", "last_indexed").alias("lens"))


def _spans(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per chunk with its span; from its definitions where none is given."""
    one = chunks.select("chunk_id", "repo", "file_path", "profile", "node_ids", "start_line", "end_line").where("chunk_id is not null")
    one = one.groupBy("chunk_id").agg(*[F.first(c).alias(c) for c in one.columns if c != "chunk_id"])
    given = (F.coalesce("start_line", F.lit(0)) > 0) & (F.coalesce("end_line", F.lit(0)) > 0)
    open_ = one.where(~given)
    defs = nodes.select(norm_id("id").alias("id"), F.struct("last_indexed", "ord").alias("v"), "start_line", "end_line").where("id is not null")
    wanted = open_.select("chunk_id", F.explode("node_ids").alias("id")).select("chunk_id", norm_id("id").alias("id")).distinct()
    span = (
        wanted.join(defs, "id")
        .groupBy("chunk_id", "id")
        .agg(F.max_by("start_line", "v").alias("s"), F.max_by("end_line", "v").alias("e"))
        .groupBy("chunk_id")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    return one.join(span, "chunk_id", "left").select(
        "chunk_id", "repo", "file_path", "profile", F.when(given, F.col("start_line")).otherwise(F.coalesce("s", F.lit(1))).alias("first"), F.when(given, F.col("end_line")).otherwise(F.coalesce("e", F.lit(2**31 - 1))).alias("last")
    )


def definition_lines(nodes: DataFrame) -> DataFrame:
    """(repo, relpath, defs): the lines (from 1) at which definitions begin."""
    rows = nodes.where("label in ('Function', 'Class') and start_line > 0").select("repo", F.regexp_replace(F.regexp_replace("file", r"\\", "/"), r"^(\./|/)+", "").alias("relpath"), "start_line")
    return rows.where("relpath <> ''").groupBy("repo", "relpath").agg(F.sort_array(F.collect_set("start_line")).alias("defs"))


def chunk_pieces(chunks: DataFrame, files: DataFrame, nodes: DataFrame, profiles: DataFrame) -> DataFrame:
    """(chunk_id, repo, file_path, n_chars, piece_limit_chars, piece, first_line, last_line, new_from, start_char, end_char, n_pieces).

    One row per piece, numbered from 0; lines count from 1 in the file. A line
    longer than the limit gives pieces of that one line; ``start_char`` and
    ``end_char`` are then positions (from 0) in it, else null.
    """
    limits = profiles.select(spelling("profile").alias("_p"), "piece_limit_chars", "overlap_lines").groupBy("_p").agg(F.max("piece_limit_chars").alias("piece_limit_chars"), F.max("overlap_lines").alias("overlap_lines"))
    located = _spans(chunks, nodes).withColumn("_p", spelling("profile")).join(F.broadcast(limits), "_p", "left").drop("_p")
    named = chunks.select("repo", F.col("file_path").alias("relpath")).distinct()
    lens = current_files(files.join(named, ["repo", "relpath"], "left_semi")).join(definition_lines(nodes), ["repo", "relpath"], "left").withColumnRenamed("relpath", "file_path")
    work = located.join(lens, ["repo", "file_path"], "left").select("chunk_id", "repo", "file_path", "first", "last", "piece_limit_chars", "overlap_lines", "lens", "defs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                every = np.asarray(r.lens, np.int64) if r.lens is not None else np.zeros(0, np.int64)
                first = max(int(r.first), 1)
                own = every[first - 1 : max(int(r.last), 0)]
                n_chars = int(own.sum() + max(len(own) - 1, 0))
                limit = int(r.piece_limit_chars) if r.piece_limit_chars is not None and r.piece_limit_chars == r.piece_limit_chars else 0
                overlap = int(r.overlap_lines) if r.overlap_lines is not None and r.overlap_lines == r.overlap_lines else 0
                if limit < 1 or n_chars <= limit:
                    pieces = [(0, len(own), 0, None, None)]
                else:
                    defs = np.asarray(r.defs, np.int64) - first if r.defs is not None else np.zeros(0, np.int64)
                    defs = defs[(defs > 0) & (defs < len(own))]
                    pieces = []
                    for a, z, new in cut_lines(own, limit, max(overlap, 0), defs):
                        if z - a == 1 and own[a] > limit:
                            pieces += [(a, z, new, c, min(c + limit, int(own[a]))) for c in range(0, int(own[a]), limit)]
                        else:
                            pieces.append((a, z, new, None, None))
                for i, (a, z, new, c, e) in enumerate(pieces):
                    out.append((r.chunk_id, r.repo, r.file_path, n_chars, limit, i, first + a, first + z - 1, first + new, c, e, len(pieces)))
            df = pd.DataFrame(out, columns=_PIECE_COLUMNS)
            df[["start_char", "end_char"]] = df[["start_char", "end_char"]].astype("Int64")
            yield df

    return work.mapInPandas(run, _PIECE)


_PIECE = "chunk_id long, repo string, file_path string, n_chars long, piece_limit_chars long, piece int, first_line long, last_line long, new_from long, start_char long, end_char long, n_pieces int"
_PIECE_COLUMNS = [c.split()[0] for c in _PIECE.split(", ")]


def oversized(pieces: DataFrame) -> DataFrame:
    """(chunk_id) of the chunks that had to be cut."""
    return pieces.where((F.col("piece") == 0) & (F.col("piece_limit_chars") > 0) & (F.col("n_chars") > F.col("piece_limit_chars"))).select("chunk_id")


def piece_texts(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """``pieces`` of cut chunks with their ``text`` from the current versions."""
    cut = pieces.where("n_pieces > 1")
    wanted = cut.select("repo", F.col("file_path").alias("relpath")).distinct()
    w = W.partitionBy("repo", "relpath").orderBy(F.desc("last_indexed"))
    texts = files.select("repo", "relpath", "last_indexed", "text").join(wanted, ["repo", "relpath"], "left_semi").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("repo", F.col("relpath").alias("file_path"), F.split("text", "\n", -1).alias("_lines"))
    line = F.element_at("_lines", F.col("first_line").cast("int"))
    lines = F.array_join(F.slice("_lines", F.col("first_line").cast("int"), (F.col("last_line") - F.col("first_line") + 1).cast("int")), "\n")
    text = F.when(F.col("start_char").isNotNull(), F.substring(line, (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))).otherwise(lines)
    return cut.join(texts, ["repo", "file_path"]).select(*pieces.columns, text.alias("text"))
