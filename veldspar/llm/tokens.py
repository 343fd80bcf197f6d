"""Token counts with a public tokenizer whose files lie in a given folder."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary cuts a text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for a null or empty one.

    ``path`` is read by the executors. Very long texts are encoded by lines,
    which changes no count by more than the tokens at a cut.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(path)
        for b in batches:
            yield pd.Series([_count(enc, t) for t in b], dtype="int64")

    return count(text)


def _count(enc, text: str | None, most: int = 200_000) -> int:
    if not text:
        return 0
    if len(text) <= most:
        return len(enc.encode_ordinary(text))
    return sum(len(enc.encode_ordinary(text[i : i + most])) for i in range(0, len(text), most))
