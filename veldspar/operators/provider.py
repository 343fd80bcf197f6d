"""Model providers as a step over rows: any object with ``complete(prompt) -> text``.

Answers are JSON arrays of objects with a title and a severity. A malformed
answer is asked for again, twice at most; a row without a usable answer gives
none, and does not stop the others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


class FirstLine:
    """Needs no model: the prompt's first line is the only finding."""

    def complete(self, prompt: str) -> str:
        return "```json\n" + json.dumps([{"title": prompt.split("\n", 1)[0], "severity": "info"}]) + "\n```"


def answers(text: str) -> list[dict] | None:
    """The array in a model's text, fenced or bare; null if there is none."""
    a, z = text.find("["), text.rfind("]")
    if a < 0 or z < a:
        return None
    try:
        got = json.loads(text[a : z + 1])
    except ValueError:
        return None
    return [x for x in got if isinstance(x, dict)]


def completed(rows: DataFrame, key: str, prompt: str, provider: Provider, retries: int = 2) -> DataFrame:
    """(key, title, severity) of the answers to each row's prompt; partitions take the place of threads."""

    def one(text: str) -> list[dict]:
        for _ in range(retries + 1):
            try:
                got = answers(provider.complete(text))
            except Exception:  # noqa: BLE001, a failed call is tried again
                got = None
            if got is not None:
                return got
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, x.get("title"), x.get("severity") or "info") for k, p in zip(b[key], b[prompt], strict=True) if p for x in one(p) if x.get("title")]
            yield pd.DataFrame(out, columns=[key, "title", "severity"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, title string, severity string")
