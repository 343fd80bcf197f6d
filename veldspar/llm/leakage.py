"""Held-out test items inside corpus documents.

Method: Wu-Manber multi-pattern search over words. The patterns are all runs
of ``span`` consecutive words of the items. A shift table over blocks of two
words says how far a window may jump; where the shift is zero, the runs that
end in the block are looked up by the hash of the window, and compared with it
word by word. A run is kept as its place in the item, not as a copy.

The items are the bounded side (a fixed test set): the runs they hold are
counted before anything is collected, and beyond ``max_runs`` they are
searched in several passes over the corpus, each with a part of the items of
about that many. So a task's memory is bounded whatever their number is.

Nulls: an item or document without text, or with fewer than ``span`` words,
gives no row. Repeated rows of a document or of an item give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.session import spread

#: Runs of letters and digits; an underscore separates.
WORD = re.compile(r"[^\W_]+")
#: Words of a block of the shift table.
BLOCK = 2
#: Runs of a pass: about 250 bytes each in every Python worker.
MAX_RUNS = 1_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Patterns:
    """Shift table, and per last block the places of the runs that end in it, by their hash."""

    def __init__(self, items: list[tuple[int, str]], span: int) -> None:
        self.span = span
        self.items = [(item_id, words_of(text)) for item_id, text in items]
        self.shift: dict[tuple[str, str], int] = {}
        self.ending: dict[tuple[str, str], dict[int, list[tuple[int, int]]]] = {}
        for no, (_, words) in enumerate(self.items):
            for i in range(len(words) - span + 1):
                run = tuple(words[i : i + span])
                self.ending.setdefault(run[-BLOCK:], {}).setdefault(hash(run), []).append((no, i))
                for j in range(span - BLOCK + 1):
                    block, jump = run[j : j + BLOCK], span - BLOCK - j
                    if self.shift.get(block, span) > jump:
                        self.shift[block] = jump

    def find(self, text: str) -> set[int]:
        """The items of which ``text`` holds ``span`` words in a row."""
        words = words_of(text)
        span, shift, far = self.span, self.shift, self.span - BLOCK + 1
        found: set[int] = set()
        end, n = span, len(words)
        while end <= n:
            block = (words[end - 2], words[end - 1])
            jump = shift.get(block, far)
            if jump == 0:
                window = words[end - span : end]
                for no, i in self.ending[block].get(hash(tuple(window)), ()):
                    item_id, own = self.items[no]
                    if item_id not in found and own[i : i + span] == window:
                        found.add(item_id)
                jump = 1
            end += jump
        return found


def leaked_items(documents: DataFrame, items: DataFrame, span: int = 12, max_runs: int = MAX_RUNS) -> DataFrame:
    """(doc_id, item_id): the document holds ``span`` words in a row of the item.

    ``documents`` is (doc_id, text, ...), ``items`` (item_id, text, ...).
    """
    items = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    runs = items.agg(F.coalesce(F.sum(F.greatest(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) - (span - 1), F.lit(0))), F.lit(0))).first()[0]
    passes = max(1, -(-runs // max_runs))
    documents = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"))
    out = None
    for k in range(passes):
        part = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]
        shared = documents.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            patterns = Patterns(shared.value, span)
            for b in batches:
                rows = [(doc, item) for doc, text in zip(b["doc_id"], b["text"], strict=True) for item in patterns.find(text)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        found = documents.mapInPandas(run, "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.lit(1).alias("_one")).drop("_one")


def leak_report(documents: DataFrame, items: DataFrame, span: int = 12) -> DataFrame:
    """(item_id, suite, n_documents) for every item, 0 where it did not leak."""
    hits = leaked_items(documents, items, span).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    every = items.select("item_id", "suite").where("item_id is not null").groupBy("item_id").agg(F.max("suite").alias("suite"))
    return every.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
