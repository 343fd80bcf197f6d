"""Column functions that bring keys and spellings to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that may pad a value.
WHITE_SPACE = " \t\n\r\f\v\u00a0\u2003\u3000\ufeff"
# Texts that stand for nothing.
NOTHING_TEXTS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "nan", "unknown", "tbd", "?", ".", "...", "not available", "undefined")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """The value without padding; null if nothing is left."""
    t = F.btrim(_col(c), F.lit(WHITE_SPACE))
    return F.when(t != "", t)


def norm_id(c: Column | str) -> Column:
    """Node ids compare after trimming and in lower case; blank is null."""
    return F.lower(trimmed(c))


def spelling(c: Column | str) -> Column:
    """Case, padding and separators aside: ``' SQL-Injection'`` is ``sql_injection``."""
    return F.regexp_replace(F.lower(trimmed(c)), r"[\s_\-./]+", "_")


def holds_something(c: Column | str) -> Column:
    """False for null, blank and texts that stand for nothing. Never null."""
    return F.coalesce(~F.lower(trimmed(c)).isin(*NOTHING_TEXTS), F.lit(False))


def holds_number(c: Column | str) -> Column:
    """False for null and NaN. Never null."""
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c)


def something(c: Column | str) -> Column:
    """The trimmed text, or null where it stands for nothing."""
    return F.when(holds_something(c), trimmed(c))
