"""Source files that are not valid source of the language of their extension.

Method: a file is cut into chunks at line ends. A chunk is represented by its
lexer-state map: for each state in which it may begin (code, or inside a
comment, template or long string) the state in which it ends and the brackets
it closes and opens. These maps are combined associatively; folded over a file
they say whether it ends in code with all brackets closed. If not, it is
invalid. What is balanced is cut into its top-level statements, which local
grammars parse one by one: recognizers for Java 17, ECMAScript modules and
TypeScript 5, and the interpreter's compiler for Python. The order of the
statements (package before imports, future imports first) is the last test.

All files go this way. A file of one chunk is mapped, cut and parsed where it
is read, each version of it, and only verdicts are moved; the chunks and then
the statements of a longer one are dealt out over the tasks. Where a map
cannot tell (a code string of Python that holds its own quotes, a template
over a cut, a line that begins with a slash at one), the file is taken as one
chunk, or if it is one already, as one statement.

Nulls: a null text is no case (null verdict); an empty one is valid. A file of
another extension is no case. A row without repo, relpath or last_indexed is
the oldest version of its key; null keys form keys of their own. A Python
statement that outgrows the interpreter's own stack has a null verdict too.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import threading
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.session import spread

# The language of an extension.
EXTENSIONS = {"py": "python", "pyi": "python", "java": "java", "js": "javascript", "mjs": "javascript", "ts": "typescript", "mts": "typescript"}
#: Characters of a chunk.
CHUNK_CHARS = 65_536
#: Bytes of stack, touched only as far as it is used, of a thread that judges a deeply nested text.
DEEP_STACK = 512 << 20

STATES = {"python": ("", "'''", '"""'), "java": ("", "/*", '"""'), "javascript": ("", "/*", "`"), "typescript": ("", "/*", "`")}
_ENDS = {"/*": re.compile(r"[\s\S]*?\*/"), "'''": re.compile(r"(?:\\[\s\S]|(?!''')[^\\])*'''"), '"""': re.compile(r'(?:\\[\s\S]|(?!""")[^\\])*"""'), "`": re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^\\`$])*(`|\$\{)")}
_CLOSES = {")": "(", "]": "[", "}": "{"}
_PY = re.compile(
    r"""\#[^\r\n]*
    |(?P<q>'''|\"\"\"|'(?:\\[\s\S]|[^'\\\r\n])*'|"(?:\\[\s\S]|[^"\\\r\n])*"|['"])
    |[()\[\]{}]
    |\\(?:\r\n|[\s\S])
    |(?P<nl>(?:\r\n|[\r\n])(?=[^\s\#]))""",
    re.X,
)
_PY_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b")
_PY_CODE_STRING = re.compile(r"(?<![A-Za-z0-9_])(?:[fF][rR]?|[rR][fF])$")
_PY_FUTURE = re.compile(r"(?:\s|\#[^\r\n]*[\r\n])*from\s+__future__\b")
_PY_STRING = re.compile(r"(?:\s|\#[^\r\n]*[\r\n])*[rRuU]?['\"]")
_PY_BLANK = re.compile(r"(?:\s|\#[^\r\n]*)*\Z")
#: End states of a map beside those of the language: a fault, and what the map cannot tell.
FAULT, UNSURE = "!", "?"


def language(relpath: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(relpath, r"\.(\w+)$", 1))
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), ext)


class Reading:
    """What one pass over a chunk gives, from one start state."""

    def __init__(self, end: str, closed: str = "", opened: str = "", found: object = None) -> None:
        self.end, self.closed, self.opened, self.found = end, closed, opened, found


def _python(text: str, state: str) -> Reading:
    """``found`` are the places at which a top-level statement begins."""
    closed: list[str] = []
    opened: list[str] = []
    cuts, line = [0], 0
    pos, n, lex = 0, len(text), _PY.search
    while pos < n:
        if state:
            m = _ENDS[state].match(text, pos)
            if m is None:
                break
            pos, state = m.end(), ""
            continue
        m = lex(text, pos)
        if m is None:
            break
        at, pos, v = m.start(), m.end(), m.group()
        if m["q"]:
            code = _PY_CODE_STRING.search(text, max(0, at - 3), at) is not None
            if code:
                whole = _ENDS[v].match(text, pos) if len(v) == 3 else m
                body = whole.group().replace("{{", "").replace("}}", "") if whole else ""
                if whole is None or len(v) == 1 or body.count("{") != body.count("}"):
                    return Reading(UNSURE)  # its code may hold the quotes that seem to end it
                pos = whole.end()
            elif len(v) == 1:
                return Reading(FAULT)
            elif v in _ENDS:
                state = v
        elif m["nl"]:
            if not opened and not closed:
                if text[line : line + 1] != "@" and not _PY_GOES_ON.match(text, pos):
                    cuts.append(pos)
                line = pos
        elif v in "([{":
            opened.append(v)
        elif v in ")]}":
            if not opened:
                closed.append(v)
            elif opened[-1] == _CLOSES[v]:
                opened.pop()
            else:
                return Reading(FAULT)
    return Reading(state, "".join(closed), "".join(opened), cuts)


def _by_tokens(lang: str, text: str, state: str) -> Reading:
    """``found`` are the tokens of the grammar."""
    from veldspar.llm import grammar_java, grammar_js
    from veldspar.llm.grammar_base import Invalid, Unfinished

    grammar = grammar_java if lang == "java" else grammar_js
    at, lead = 0, ""
    if state:
        m = _ENDS[state].match(text)
        if m is None:
            return Reading(state)
        at, lead = m.end(), "$" if state == "`" and m[1] == "${" else ""
    try:
        found, end = grammar.tokens(text, at), ""
    except Unfinished as e:
        found, end = e.found, e.state
    except Invalid:
        return Reading(FAULT)
    kinds, values = found[:2]
    closed, opened, last = [], list(lead), len(values) - 1
    for i, v in enumerate(values):
        if kinds[i] != "o":
            continue
        if v in ("(", "[", "{"):
            opened.append("$" if v == "(" and i and kinds[i - 1] in "tT" and values[i - 1] == "${" else v)
        elif v in (")", "]", "}"):
            want = "$" if v == ")" and i < last and kinds[i + 1] == "T" else _CLOSES[v]
            if not opened:
                closed.append(v)
            elif opened[-1] == want:
                opened.pop()
            else:
                return Reading(UNSURE if "$" in opened[-1] + want else FAULT)
    return Reading(end, "".join(closed), "".join(opened), found)


def read(lang: str, text: str, state: str = "") -> Reading:
    return _python(text, state) if lang == "python" else _by_tokens(lang, text, state)


_SLASH = re.compile(r"\s*/(?![/*])")


def lexer_map(lang: str, chunk: str, first: bool = False) -> dict[str, tuple[str, str, str]]:
    """Start state -> (end state, brackets closed, brackets opened). A first chunk begins in code."""
    out = {}
    for s in ("",) if first else STATES[lang]:
        if not first and not s and lang in ("javascript", "typescript") and _SLASH.match(chunk):
            out[s] = (UNSURE, "", "")
        else:
            r = read(lang, chunk, s)
            out[s] = (r.end, r.closed, r.opened)
    return out


def combined(a: dict, b: dict) -> dict:
    """The map of two chunks in a row; associative."""
    out = {}
    for start, (end, closed, opened) in a.items():
        if end in (FAULT, UNSURE):
            out[start] = (end, "", "")
            continue
        end2, closed2, opened2 = b[end]
        if end2 in (FAULT, UNSURE):
            out[start] = (end2, "", "")
            continue
        have, bad = list(opened), ""
        for i, v in enumerate(closed2):
            if not have:
                closed += closed2[i:]
                break
            if have[-1] != _CLOSES[v]:
                bad = UNSURE if have[-1] == "$" else FAULT  # a template goes on behind its brace
                break
            have.pop()
        out[start] = (bad, "", "") if bad else (end2, closed, "".join(have) + opened2)
    return out


def balanced(lexer: dict) -> bool | None:
    """Whether the whole text ends in code with all brackets closed; null where the map cannot tell."""
    return None if lexer[""][0] == UNSURE else lexer[""] == ("", "", "")


def _unbounded(check: Callable[..., int | None], found: tuple, *args: bool) -> int | None:
    """``check`` of a statement nested deeper than a grammar allows at first.

    It runs in a thread with a stack of its own, with frames in proportion to
    the tokens, since every level takes some of it.
    """
    got: list[object] = []

    def run() -> None:
        try:
            got.append(check(found, *args, deep=True))
        except BaseException as e:  # noqa: BLE001
            got.append(e)

    limit, size = sys.getrecursionlimit(), threading.stack_size(DEEP_STACK)
    sys.setrecursionlimit(max(limit, 80 * len(found[0])))
    try:
        t = threading.Thread(target=run)
        t.start()
        t.join()
    finally:
        threading.stack_size(size)
        sys.setrecursionlimit(limit)
    if isinstance(got[0], BaseException):
        raise got[0]
    return got[0]


def _compiled(statement: str) -> int | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        compile(statement.encode("utf-8", "surrogatepass"), "file", "exec", dont_inherit=True)
    if _PY_BLANK.match(statement):
        return None
    return 1 if _PY_FUTURE.match(statement) else 0 if _PY_STRING.match(statement) else 2


def _python_in_order(ranks: list[int | None]) -> bool:
    """Future imports stand before all but a first string."""
    some = [r for r in ranks if r is not None]
    return 1 not in some or all(r == 1 for r in some[some[0] == 0 : len(some) - some[::-1].index(1)])


def parsed(lang: str, statement: str | tuple) -> int | None:
    """The rank of a statement (a text of Python, else tokens) in the order of its file.

    Raises an error of the grammar if it is none.
    """
    from veldspar.llm import grammar_java, grammar_js

    if lang == "python":
        return _compiled(statement)
    check, args = (grammar_java.check, ()) if lang == "java" else (grammar_js.check, (lang == "typescript",))
    try:
        return check(statement, *args)
    except RecursionError:
        return _unbounded(check, statement, *args)


def in_order(lang: str, ranks: list[int | None]) -> bool:
    from veldspar.llm import grammar_java

    return _python_in_order(ranks) if lang == "python" else lang != "java" or grammar_java.in_order(ranks)


def source(lang: str, text: str) -> str:
    """The text as its lexer sees it: without a byte order mark, escapes of Java resolved."""
    from veldspar.llm import grammar_java

    text = text.removeprefix("\ufeff")
    return grammar_java.plain(text) if lang == "java" else text


def statements(lang: str, text: str, reading: Reading) -> list[str | tuple]:
    """The top-level statements of a balanced text."""
    from veldspar.llm import grammar_java, grammar_js

    if lang == "python":
        cuts = [*(reading.found or [0]), len(text)]
        return [text[a:z] for a, z in itertools.pairwise(cuts) if z > a]
    grammar = grammar_java if lang == "java" else grammar_js
    return [tuple(part[a:z] for part in reading.found) for a, z in grammar.statements(reading.found)]


def _whole(lang: str, text: str) -> str | tuple:
    """A text as one statement; raises an error of the grammar if it ends within a comment or literal."""
    from veldspar.llm import grammar_java, grammar_js

    return text if lang == "python" else (grammar_java if lang == "java" else grammar_js).tokens(text)


def _faults() -> tuple:
    from veldspar.llm.grammar_base import Invalid

    return Invalid, SyntaxError, ValueError, OverflowError, IndexError


def valid(lang: str, text: str) -> bool | None:
    """Verdict on a text taken as one chunk: its map, then its statements."""
    text = source(lang, text)
    reading = read(lang, text)
    told = balanced({"": (reading.end, reading.closed, reading.opened)})
    if told is False:
        return False
    try:
        return in_order(lang, [parsed(lang, x) for x in (statements(lang, text, reading) if told else [_whole(lang, text)])])
    except _faults():
        return False
    except (RecursionError, MemoryError):
        return None  # nested deeper than the interpreter's own parser can tell


def _pieces(text: str, size: int) -> list[str]:
    """Chunks that end at line ends that no backslash carries over."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if at + size < len(text):
            end = at + size
            while True:
                end = text.find("\n", end - 1) + 1
                if not end:
                    end = len(text)
                elif text[end - 2 : end - 1] == "\\" or text[end - 3 : end - 1] == "\\\r":
                    end += 1
                    continue
                break
        out.append(text[at:end])
        at = end
    return out


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["valid"] = pd.array([valid(lang, text) for lang, text in zip(b["lang"], b["text"], strict=True)], dtype="boolean")
        yield b[["repo", "relpath", "lang", "last_indexed", "valid"]]


_KEY = "repo string, relpath string, lang string, last_indexed timestamp_ntz"
_KEYS = ["repo", "relpath", "lang", "last_indexed"]


def verdicts(files: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(repo, relpath, lang, valid) of the current version of each file.

    ``valid`` is null where the current text is null. Only files of a known
    extension are in the result.
    """
    rows = files.select("repo", "relpath", language("relpath").alias("lang"), F.col("last_indexed").cast("timestamp_ntz").alias("last_indexed"), "text").where("lang is not null")
    long = F.length("text") > chunk_chars
    short = spread(rows.where(~F.coalesce(long, F.lit(True)))).mapInPandas(_judge, f"{_KEY}, valid boolean")
    none = rows.where("text is null").select(*_KEYS, F.lit(None).cast("boolean").alias("valid"))
    out = short.unionByName(none).unionByName(_long_verdicts(rows.where(long), chunk_chars))
    return out.groupBy("repo", "relpath", "lang").agg(F.max_by("valid", F.struct("last_indexed", "valid")).alias("valid"))


def _long_verdicts(rows: DataFrame, chunk_chars: int) -> DataFrame:
    """Verdicts on files of several chunks: maps, fold and statements are spread over the tasks."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                for i, piece in enumerate(_pieces(source(r.lang, r.text), chunk_chars)):
                    yield pd.DataFrame([(r.repo, r.relpath, r.lang, r.last_indexed, i, piece)], columns=[*_KEYS, "no", "piece"])

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["states"] = [[(k, *v) for k, v in lexer_map(lang, piece, no == 0).items()] for lang, piece, no in zip(b["lang"], b["piece"], b["no"], strict=True)]
            yield b[[*_KEYS, "no", "states"]]

    @F.pandas_udf("boolean")
    def folds(maps: pd.Series) -> pd.Series:
        def fold(chunks) -> bool | None:
            ones = [{s["a"]: (s["z"], s["closed"], s["opened"]) for s in c["states"]} for c in chunks]
            return balanced(functools.reduce(combined, ones))

        return pd.Series([fold(m) for m in maps], dtype="boolean")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                text = source(r.lang, r.text)
                reading = read(r.lang, text)
                told = balanced({"": (reading.end, reading.closed, reading.opened)})
                if told is False:
                    yield pd.DataFrame([(*r[:4], 0, None)], columns=[*_KEYS, "no", "statement"])
                    continue
                if not told:
                    texts = [text]
                elif r.lang == "python":
                    texts = statements(r.lang, text, reading)
                else:
                    starts = [part[2][0] for part in statements(r.lang, text, reading)]
                    texts = [text[a:z] for a, z in itertools.pairwise([*starts, len(text)])]
                yield pd.DataFrame([(*r[:4], i, x) for i, x in enumerate(texts)], columns=[*_KEYS, "no", "statement"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(lang: str, x: str | None) -> tuple[bool | None, int | None]:
            if x is None:
                return False, None
            try:
                return True, parsed(lang, _whole(lang, x))
            except _faults():
                return False, None
            except (RecursionError, MemoryError):
                return None, None

        for b in batches:
            got = [one(lang, x) for lang, x in zip(b["lang"], b["statement"], strict=True)]
            b["ok"] = pd.array([g[0] for g in got], dtype="boolean")
            b["rank"] = pd.array([g[1] for g in got], dtype="Int32")
            yield b[[*_KEYS, "no", "ok", "rank"]]

    @F.pandas_udf("boolean")
    def ordered(lang: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([in_order(x, [None if r["rank"] is None or r["rank"] != r["rank"] else int(r["rank"]) for r in rs]) for x, rs in zip(lang, ranks, strict=True)], dtype="boolean")

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = "array<struct<a string, z string, closed string, opened string>>"
    maps = rows.select(*_KEYS, "text").mapInPandas(cut, f"{_KEY}, no int, piece string").repartition(n, "repo", "relpath", "no").mapInPandas(summarize, f"{_KEY}, no int, states {states}")
    folded = maps.groupBy(*_KEYS).agg(F.sort_array(F.collect_set(F.struct("no", "states"))).alias("m")).select(*[F.col(k).alias(f"_{k}") for k in _KEYS], folds("m").alias("balanced"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in _KEYS]
    known = rows.join(folded, same[0] & same[1] & same[2] & same[3])
    unbalanced = folded.where("not balanced").select(*[F.col(f"_{k}").alias(k) for k in _KEYS], F.lit(False).alias("valid"))
    parts = known.where(F.coalesce("balanced", F.lit(True))).select(*_KEYS, "text").mapInPandas(split, f"{_KEY}, no int, statement string")
    done = parts.repartition(n, "repo", "relpath", "no").mapInPandas(parse, f"{_KEY}, no int, ok boolean, rank int")
    # false where a statement is none, else null where one could not be told
    judged = done.groupBy(*_KEYS).agg(F.bool_and("ok").alias("all"), F.count_if(F.col("ok").isNull()).alias("untold"), F.sort_array(F.collect_set(F.struct("no", "rank"))).alias("ranks"))
    verdict = F.when(~F.coalesce("all", F.lit(True)), F.lit(False)).when(F.col("untold") > 0, F.lit(None)).otherwise(ordered("lang", "ranks"))
    return unbalanced.unionByName(judged.select(*_KEYS, verdict.alias("valid")))


def invalid_rates(judged: DataFrame) -> DataFrame:
    """(repo, lang, n_files, n_invalid, rate) over the files with a text."""
    return judged.where("valid is not null").groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid")).withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
