"""Scalar text functions: names, routes, URLs, terms, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question that carry no meaning of their own.
STOPWORDS = ("the", "and", "for", "are", "how", "what", "does", "with", "from", "that", "this", "which", "where", "when", "who", "why", "into", "was", "is")


def stable_id(repo: Column, kind: Column, fqn: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts, NUL between them."""
    zero = F.lit("\x00")
    return F.substring(F.sha1(F.concat(repo, zero, kind, zero, fqn).cast("binary")), 1, 16)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def tail_name(name: Column) -> Column:
    """The part behind the last dot or hash sign."""
    return F.element_at(F.split(name, r"[.#]"), -1)


def simple_type(name: Column) -> Column:
    """Without type arguments and array brackets, and of that the tail."""
    return tail_name(F.regexp_replace(F.regexp_replace(name, r"<.*$", ""), r"\[\]", ""))


def visibility(name: Column) -> Column:
    """By the underscore convention."""
    return F.when(name.rlike(r"^__.*__$"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")


def event_name(name: Column) -> Column:
    """Camel case and separators become dots, in lower case."""
    dotted = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1.$2")
    return F.regexp_replace(F.regexp_replace(F.lower(dotted), r"[_\-/:\s.]+", "."), r"^\.|\.$", "")


def url_path(url: Column) -> Column:
    """The path without quotes, scheme, host, query and fragment."""
    bare = F.regexp_replace(url, r"^[\"'\s]+|[\"'\s]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", ""), r"[?#].*$", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"^[\"'\s]+", ""), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\"']*)", 1))


def route_key(route: Column) -> Column:
    """Parameters become ``*``; one slash in front, none behind."""
    starred = F.regexp_replace(F.regexp_replace(F.regexp_replace(route, r"\{[^}]*\}", "*"), r"<[^>]*>", "*"), r":[A-Za-z_]\w*", "*")
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(starred, r"/+", "/"), r"^/|/$", ""))


def api_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.concat(F.lit("/"), url_path(path)), r"/+", "/"))


def query_terms(text: Column, least: int = 3) -> Column:
    """Distinct lower-case alphanumeric words in order of first use, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS)))


def clean_terms(values: Column, cap: int = 12, longest: int = 60) -> Column:
    """Trimmed, cut, distinct without regard to case (the first spelling stays), capped."""
    cut = F.filter(F.transform(values, lambda v: F.substring(F.trim(v), 1, longest)), lambda v: v != "")
    first = F.filter(cut, lambda v, i: F.array_position(F.transform(cut, F.lower), F.lower(v)) == i + 1)
    return F.slice(first, 1, cap)


def clean_path(path: Column) -> Column:
    """Slashes one way, no dot or slash in front."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./|/)+", "")


def path_segments(path: Column) -> Column:
    return F.split(clean_path(path), "/")


def shannon_entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c)))


def line_slice(text: Column, first: Column, last: Column, cap: int | None = None) -> Column:
    """Lines first..last, from 1 and inclusive; a first line below 1 is 1."""
    lo = F.greatest(first, F.lit(1)).cast("int")
    out = F.array_join(F.slice(F.split(text, "\n", -1), lo, F.greatest(last - lo + 1, F.lit(0)).cast("int")), "\n")
    return F.substring(out, 1, cap) if cap else out
