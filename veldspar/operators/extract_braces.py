"""Java, JavaScript and TypeScript source text as nodes, structural edges and references.

The facts have the columns of :mod:`veldspar.operators.extract`. A file is cut
into tokens once; brackets are matched over the tokens, and declarations are
read off their heads, so that bodies are passed over as spans. A text whose
brackets do not match gives an ``error`` fact and what a scan by lines finds.

Nulls: null and empty texts give the File node alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from veldspar.operators.extract import _COLUMNS, SCHEMA

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/)
    |(?P<s>\"\"\"[\s\S]*?\"\"\"|"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*')
    |(?P<i>[#@]?[^\W\d][\w$]*|\$[\w$]*)
    |(?P<n>\d[\w.]*)
    |(?P<o>=>|->|::|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|[-+*/%&|^]=|[^\w\s])""",
    re.X,
)
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_OPEN = {"(": ")", "[": "]", "{": "}"}
# Words that are followed by a bracket without being calls.
_NO_CALL = frozenset("if for while switch catch return synchronized super this function new throw typeof await do else try import export constructor assert in of instanceof case void delete yield".split())
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed async readonly declare override export get set".split())
_PRIMITIVES = frozenset("int long short byte char boolean float double void var".split())
_TYPES = {"class": "Class", "interface": "Class", "enum": "Class", "record": "Class"}
_MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
_VERBS = frozenset("get post put delete patch head options".split())
_INJECT = frozenset("Autowired Inject Resource".split())


class Broken(Exception):  # noqa: N818
    """Brackets do not match."""


class _Source:
    def __init__(self, repo: str | None, relpath: str, text: str, java: bool) -> None:
        self.repo, self.relpath, self.java, self.rows = repo, relpath, java, []
        self.module = re.sub(r"\.\w+$", "", relpath).replace("/", ".")
        self.kind: list[str] = []
        self.v: list[str] = []
        self.line: list[int] = []
        self.cut(text)
        self.match()

    def cut(self, text: str) -> None:
        pos, line, n = 0, 1, len(text)
        while pos < n:
            c = text[pos]
            if c == "`":
                m_end, depth = pos + 1, 0
                while m_end < n and (text[m_end] != "`" or depth):
                    if text[m_end] == "\\":
                        m_end += 1
                    elif text.startswith("${", m_end):
                        depth += 1
                        m_end += 1
                    elif depth and text[m_end] == "}":
                        depth -= 1
                    m_end += 1
                kind, v, end = "s", text[pos : m_end + 1], m_end + 1
            else:
                m = None
                if c == "/" and not self.java and (not self.v or self.kind[-1] == "o" and self.v[-1] not in (")", "]", "}") or self.v[-1] == "return"):
                    m = _REGEX.match(text, pos)
                if m is not None:
                    kind, v, end = "s", m.group(), m.end()
                else:
                    m = _TOKEN.match(text, pos)
                    if m is None:
                        pos += 1
                        continue
                    kind, v, end = m.lastgroup, m.group(), m.end()
            if kind != "skip":
                self.kind.append(kind)
                self.v.append(v)
                self.line.append(line)
            line += v.count("\n")
            pos = end
        self.lines = line

    def match(self) -> None:
        self.end = list(range(len(self.v)))
        stack: list[int] = []
        for i, v in enumerate(self.v):
            if self.kind[i] != "o":
                continue
            if v in _OPEN:
                stack.append(i)
            elif v in (")", "]", "}"):
                if not stack or _OPEN[self.v[stack[-1]]] != v:
                    raise Broken
                self.end[stack.pop()] = i
        if stack:
            raise Broken

    def add(self, fact: str, kind: str, src: str | None, name: str | None, fqn: str | None = None, value: str | None = None, line: int | None = None, end: int | None = None, arity: int | None = None, args: list[str] | None = None) -> None:
        self.rows.append((self.repo, self.relpath, fact, kind, src, name, fqn, value, line, end, arity, args))

    def items(self, a: int, z: int) -> list[list[int]]:
        """Token positions between ``a`` and ``z`` parted at commas outside brackets."""
        out: list[list[int]] = [[]]
        i, angle = a, 0
        while i < z:
            v = self.v[i]
            if v == "," and angle <= 0:
                out.append([])
            else:
                out[-1] += range(i, self.end[i] + 1)
                angle += (v == "<") - (v == ">")
            i = self.end[i] + 1
        return [x for x in out if x]

    def annotations(self, at: list[int]) -> tuple[list[tuple[str, str | None, int]], list[int]]:
        """((name, first string, line) of each, the other positions)."""
        found, rest, i = [], [], 0
        while i < len(at):
            p = at[i]
            if self.v[p].startswith("@") and self.kind[p] == "i" and self.v[p] != "@interface":
                text = None
                j = i + 1
                if j < len(at) and self.v[at[j]] == "(":
                    close = self.end[at[j]]
                    text = next((self.v[k].strip("\"'`") for k in range(at[j], close) if self.kind[k] == "s"), None)
                    while j < len(at) and at[j] <= close:
                        j += 1
                found.append((self.v[p][1:], text, self.line[p]))
                i = j
            else:
                rest.append(p)
                i += 1
        return found, rest

    def body(self, a: int, z: int, fqn: str, name: str, cls: str | None, first: int) -> None:
        """Calls, state, errors and metrics of the tokens between ``a`` and ``z``."""
        branches = loops = logic = 0
        held: set[tuple[str, str]] = set()
        for i in range(a, z):
            v, k = self.v[i], self.kind[i]
            nxt = self.v[i + 1] if i + 1 < z else ""
            if k == "o":
                branches += v == "?" and nxt not in (".", ":")
                logic += v in ("&&", "||")
                continue
            if k != "i":
                continue
            prev = self.v[i - 1] if i > a else ""
            branches += v in ("if", "case", "catch") and prev != "."
            loops += v in ("for", "while") and prev != "."
            if v == "this" and nxt == "." and cls and i + 2 < z and self.kind[i + 2] == "i":
                field, after = f"{cls}.{self.v[i + 2]}", self.v[i + 3] if i + 3 < z else ""
                if after != "(":
                    both = after in ("+=", "-=", "*=", "/=", "++", "--")
                    for kind in ["WRITES"] * (after == "=" or both) + ["READS"] * (after != "="):
                        if (kind, field) not in held:
                            held.add((kind, field))
                            self.add("ref", kind, fqn, field, None, None, self.line[i])
            if v == "catch" and nxt == "(":
                if self.java:
                    names = [self.v[p] for p in range(i + 2, self.end[i + 1]) if self.kind[p] == "i" and self.v[p] not in _MODIFIERS]
                    for t in names[:-1]:
                        self.add("ref", "CATCHES", fqn, t, None, None, self.line[i])
            elif v == "throw" and nxt == "new" and i + 2 < z:
                self.add("ref", "THROWS", fqn, self.v[i + 2], None, None, self.line[i])
            elif (nxt == "(" or prev == "new" and nxt == "<") and v not in _NO_CALL and prev != "function":
                paren = next((p for p in range(i + 1, min(z, i + 40)) if self.v[p] == "("), None)
                if paren is None:
                    continue
                args = self.items(paren + 1, self.end[paren])
                recv = self.v[i - 2] if prev in (".", "?.") and i - 2 >= a and self.kind[i - 2] == "i" else None
                plain = [self.v[x[0]] for x in args if len(x) == 1 and self.kind[x[0]] == "i"]
                self.add("ref", "INSTANTIATES" if prev == "new" else "CALLS", fqn, v, f"{recv}.{v}" if recv else v, recv, self.line[i], None, len(args), plain)
                text = self.v[args[0][0]].strip("\"'`") if args and self.kind[args[0][0]] == "s" else None
                if text and (v == "fetch" or recv in ("axios", "http", "client", "restTemplate") and (v in _VERBS or v.endswith(("ForObject", "ForEntity")))):
                    method = next((w for w in ("delete", "post", "put", "patch", "get") if v.lower().startswith(w)), "get")
                    self.add("ref", "CALLS_API", fqn, text, None, method.upper(), self.line[i])
                elif text and text.startswith("/") and v in _VERBS and recv in ("app", "router", "server") and not self.java:
                    self.add("node", "Endpoint", fqn, f"{v.upper()} {text}", f"{v.upper()} {text}", None, self.line[i])
                    self.add("edge", "EXPOSES", fqn, f"{v.upper()} {text}", f"{v.upper()} {text}")
        last = self.line[z] if z < len(self.line) else self.lines
        cyclomatic = 1 + branches + loops + (0 if self.java else logic)
        self.add("metric", "cyclomatic", fqn, name, None, None, first, last, cyclomatic, [str(branches), str(loops), str(last - first + 1)])

    def type_names(self, at: list[int]) -> list[str]:
        return [self.v[p] for p in at if self.kind[p] == "i" and self.v[p] not in _PRIMITIVES and self.v[p] not in _MODIFIERS and self.v[p] not in ("extends", "super", "string", "number", "unknown", "any", "null", "undefined", "never", "keyof", "as")]

    def typed(self, kind: str, fqn: str, at: list[int]) -> None:
        for n, t in enumerate(self.type_names(at)):
            self.add("ref", kind if n == 0 else "HAS_GENERIC", fqn, t, t, None, self.line[at[0]])

    def params(self, a: int, z: int, fqn: str) -> tuple[list[str], list[list[int]]]:
        names, types = [], []
        for item in self.items(a, z):
            _, item = self.annotations(item)
            item = [p for p in item if self.v[p] not in _MODIFIERS]
            if not item:
                continue
            if self.java:
                names.append(("..." if any(self.v[p] == "..." for p in item) else "") + self.v[item[-1]])
                types.append(item[:-1])
            else:
                rest = self.v[item[0]] == "..."
                p = item[1] if rest and len(item) > 1 else item[0]
                names.append(("..." if rest else "") + (self.v[p] if self.kind[p] == "i" else "{}"))
                colon = next((i for i, q in enumerate(item) if self.v[q] == ":"), None)
                stop = next((i for i, q in enumerate(item) if self.v[q] == "="), len(item))
                types.append(item[colon + 1 : stop] if colon is not None and self.kind[p] == "i" else [])
        for t in types:
            if t:
                self.typed("PARAM_TYPE", fqn, t)
        return names, types


class _Java(_Source):
    def unit(self) -> None:
        self.package = self.module
        i, n = 0, len(self.v)
        self.add("node", "File", None, self.relpath.rsplit("/", 1)[-1], self.module, None, 1, self.lines)
        while i < n:
            if self.v[i] == "package":
                stop = self.v.index(";", i)
                self.package = "".join(self.v[i + 1 : stop])
                i = stop + 1
            elif self.v[i] == "import":
                stop = self.v.index(";", i)
                words = [w for w in self.v[i + 1 : stop] if w != "static"]
                wild = words[-1] == "*"
                full = "".join(words[:-2] if wild else words)
                self.add("ref", "IMPORTS", self.module, "*" if wild else words[-1], full, "wildcard" if wild else None, self.line[i])
                i = stop + 1
            else:
                i = self.members(i, n, self.package, self.module, None)

    def members(self, i: int, z: int, owner: str, parent: str, cls: str | None, prefix: str = "", enum: bool = False) -> int:
        """Declarations between ``i`` and ``z``; ``cls`` is the class's simple name."""
        ctors: list[tuple[str, list[list[int]], bool, int]] = []
        if enum:  # constants first
            while i < z and self.v[i] != ";":
                i = self.end[i] + 1
            i += 1
        while i < z:
            head: list[int] = []
            while i < z and self.v[i] not in (";", "{", "="):
                head += range(i, self.end[i] + 1)
                i = self.end[i] + 1
            stop = self.v[i] if i < z else ";"
            marks, rest = self.annotations(head)
            plain = [p for p in rest if self.v[p] not in _MODIFIERS]
            word = next((p for p in plain if self.v[p] in _TYPES and (p == 0 or self.v[p - 1] != ".")), None)
            if word is not None and stop == "{" and word + 1 < len(self.v):
                name = self.v[word + 1]
                fqn = f"{owner}.{name}"
                close = self.end[i]
                self.add("node", "Class", parent, name, fqn, self.v[word], self.line[word], self.line[close])
                self.add("edge", "CONTAINS" if parent == self.module else "DEFINES", parent, name, fqn)
                tail = [p for p in plain if p > word + 1]
                kind = None
                depth = 0
                for p in tail:
                    depth += (self.v[p] == "<") - (self.v[p] == ">")
                    if self.v[p] in ("extends", "implements") and depth == 0:
                        kind = self.v[p].upper()
                    elif kind and depth == 0 and self.kind[p] == "i" and self.v[p + 1] != ".":
                        self.add("ref", kind, fqn, self.v[p], self.v[p], None, self.line[p])
                route = ""
                for m, text, line in marks:
                    self.add("ref", "ANNOTATED_WITH", fqn, m, m, None, line)
                    if m == "RequestMapping" and text:
                        route = text.rstrip("/")
                self.members(i + 1, close, fqn, fqn, name, route, self.v[word] == "enum")
                i = close + 1
                continue
            paren = next((p for p in plain if self.v[p] == "(" and p > plain[0] and self.kind[p - 1] == "i"), None)
            if cls and paren is not None and stop in ("{", ";"):
                name = self.v[paren - 1]
                fqn = f"{owner}.{name}"
                before = [p for p in plain if p < paren - 1]
                close = self.end[i] if stop == "{" else i
                first = self.line[head[0]]
                names, types = self.params(paren + 1, self.end[paren], fqn)
                self.add("node", "Function", parent, name, fqn, "constructor" if name == cls else "method", first, self.line[close], len(names), names)
                self.add("edge", "DEFINES", parent, name, fqn)
                if before and name != cls:
                    self.typed("RETURN_TYPE", fqn, before)
                for p in plain:
                    if self.v[p] == "throws":
                        for t in [self.v[q] for q in plain if q > p and self.kind[q] == "i"]:
                            self.add("ref", "THROWS", fqn, t, None, "declared", self.line[p])
                self.marks(marks, fqn, prefix)
                if name == cls:
                    ctors.append((fqn, types, any(m in _INJECT for m, *_ in marks), first))
                if stop == "{":
                    self.body(i + 1, close, fqn, name, owner, first)
                i = close + 1
                continue
            if cls and len(plain) >= 2 and stop in (";", "=") and self.kind[plain[-1]] == "i":
                name = self.v[plain[-1]]
                self.add("node", "Field", parent, name, f"{owner}.{name}", "class", self.line[plain[-1]])
                self.typed("FIELD_TYPE", f"{owner}.{name}", plain[:-1])
                if any(m in _INJECT for m, *_ in marks):
                    for t in self.type_names(plain[:-1])[:1]:
                        self.add("ref", "AUTOWIRED", owner, t, t, "field", self.line[plain[-1]])
            if stop == "=":
                while i < z and self.v[i] != ";":
                    i = self.end[i] + 1
                i += 1
            else:
                i = self.end[i] + 1 if i < z else z
        marked = [c for c in ctors if c[2]]
        for _, types, _, line in marked or (ctors if len(ctors) == 1 else []):
            for t in types:
                for name in self.type_names(t)[:1]:
                    self.add("ref", "AUTOWIRED", owner, name, name, "constructor", line)
        return i

    def marks(self, marks: list[tuple[str, str | None, int]], fqn: str, prefix: str) -> None:
        for m, text, line in marks:
            self.add("ref", "ANNOTATED_WITH", fqn, m, m, None, line)
            method = _MAPPINGS.get(m) or ("GET" if m == "RequestMapping" else None)
            if method:
                route = f"{method} {prefix}/{(text or '').lstrip('/')}".rstrip("/")
                self.add("node", "Endpoint", fqn, route, route, None, line)
                self.add("edge", "EXPOSES", fqn, route, route)
            elif m in ("PreAuthorize", "Secured", "RolesAllowed"):
                self.add("ref", "REQUIRES_AUTH", fqn, text or "AUTH_REQUIRED", None, "sure", line)
            elif m in ("EventListener", "KafkaListener", "RabbitListener") and text:
                self.add("ref", "CONSUMES_EVENT", fqn, text, None, "sure", line)


class _Script(_Source):
    def unit(self) -> None:
        self.add("node", "File", None, self.relpath.rsplit("/", 1)[-1], self.module, None, 1, self.lines)
        self.scope(0, len(self.v), self.module)
        self.body(0, len(self.v), self.module, self.relpath.rsplit("/", 1)[-1], None, 1)

    def imports(self, i: int) -> None:
        stop = i + 1
        while stop < len(self.v) and self.kind[stop] != "s" and stop - i < 200:
            stop += 1
        if stop >= len(self.v) or self.kind[stop] != "s":
            return
        spec = self.v[stop].strip("\"'")
        names = [p for p in range(i + 1, stop) if self.kind[p] == "i" and self.v[p] not in ("from", "as", "type") and not (p + 1 < stop and self.v[p + 1] == "as")]
        for p in names:
            original = self.v[p - 2] if self.v[p - 1] == "as" and self.v[p - 2] != "*" else self.v[p]
            how = "namespace" if self.v[p - 1] == "as" and self.v[p - 2] == "*" else "named" if any(self.v[q] == "{" and q < p < self.end[q] for q in range(i, p)) else "default"
            self.add("ref", "IMPORTS", self.module, original, f"{spec}#{original}", self.v[p] if self.v[p] != original else how, self.line[i])
        if not names:
            self.add("ref", "IMPORTS", self.module, spec, spec, "effect", self.line[i])

    def scope(self, i: int, z: int, owner: str) -> None:
        """Declarations between ``i`` and ``z`` outside nested functions."""
        while i < z:
            v = self.v[i]
            nxt = self.v[i + 1] if i + 1 < z else ""
            prev = self.v[i - 1] if i else ""
            if v == "import" and nxt not in ("(", "."):
                self.imports(i)
                i += 1
            elif v == "class" and i + 1 < z and self.kind[i + 1] == "i" and prev != ".":
                i = self.class_(i, z, owner)
            elif v in ("interface", "enum") and i + 2 < z and self.kind[i + 1] == "i" and prev != ".":
                brace = next((p for p in range(i + 2, min(z, i + 80)) if self.v[p] == "{"), None)
                if brace is None:
                    i += 1
                    continue
                self.define("Class", owner, nxt, v, i, self.end[brace])
                i = self.end[brace] + 1
            elif v == "type" and i + 2 < z and self.kind[i + 1] == "i" and self.v[i + 2] in ("=", "<"):
                self.define("Class", owner, nxt, "type_alias", i, i + 2)
                i += 2
            elif v == "function" and (nxt == "*" or i + 1 < z and self.kind[i + 1] == "i"):
                at = i + 2 if nxt == "*" else i + 1
                paren = next((p for p in range(at, min(z, at + 60)) if self.v[p] == "("), None)
                i = self.function(owner, self.v[at], "function", i, paren, z) if paren is not None else i + 1
            elif v in ("const", "let", "var") and i + 3 < z and self.kind[i + 1] == "i":
                eq = next((p for p in range(i + 2, min(z, i + 40)) if self.v[p] in ("=", ";")), None)
                p = eq + 1 if eq is not None and self.v[eq] == "=" else None
                if p is not None and p < z and self.v[p] == "async":
                    p += 1
                if p is not None and p < z and self.v[p] == "function":
                    paren = next((q for q in range(p, min(z, p + 10)) if self.v[q] == "("), None)
                    i = self.function(owner, nxt, "function", i, paren, z) if paren is not None else i + 1
                elif p is not None and p < z and self.v[p] == "(" and self.arrow(self.end[p], z) is not None:
                    i = self.function(owner, nxt, "arrow", i, p, z)
                else:
                    if owner == self.module:
                        self.add("node", "Field", owner, nxt, f"{owner}.{nxt}", "module", self.line[i])
                    i += 2
            elif v == "{" and self.kind[i] == "o":
                i += 1  # a block belongs to the scope
            else:
                i = self.end[i] + 1 if v in ("(", "[") else i + 1

    def arrow(self, close: int, z: int) -> int | None:
        """The position of the arrow behind a parameter list, past a return type."""
        for p in range(close + 1, min(z, close + 30)):
            if self.v[p] == "=>":
                return p
            if self.v[p] in (";", "{", "="):
                return None
        return None

    def define(self, label: str, owner: str, name: str, kind: str, i: int, stop: int, arity: int | None = None, args: list[str] | None = None) -> str:
        fqn = f"{owner}.{name}"
        self.add("node", label, owner, name, fqn, kind, self.line[i], self.line[min(stop, len(self.line) - 1)], arity, args)
        self.add("edge", "CONTAINS" if owner == self.module else "DEFINES", owner, name, fqn)
        return fqn

    def function(self, owner: str, name: str, kind: str, i: int, paren: int, z: int, cls: str | None = None) -> int:
        close = self.end[paren]
        arrow = self.arrow(close, z) if kind == "arrow" else None
        start = arrow + 1 if arrow is not None else next((p for p in range(close + 1, min(z, close + 60)) if self.v[p] in ("{", ";")), None)
        if start is not None and kind != "arrow" and self.v[start] == "{" and any(self.v[p] == ":" for p in range(close + 1, start)) is False and start > close + 1:
            start = None
        block = start is not None and start < z and self.v[start] == "{"
        stop = self.end[start] if block else start if start is not None else close
        fqn = f"{owner}.{name}"
        names, _ = self.params(paren + 1, close, fqn)
        self.define("Function", owner, name, kind, i, stop, len(names), names)
        if close + 1 < z and self.v[close + 1] == ":" and start is not None:
            types = [p for p in range(close + 2, arrow if arrow is not None else start)]
            if types:
                self.typed("RETURN_TYPE", fqn, types)
        if block:
            self.body(start + 1, stop, fqn, name, cls, self.line[i])
            self.scope(start + 1, stop, fqn)
        return max(stop, close) + 1

    def class_(self, i: int, z: int, owner: str) -> int:
        name = self.v[i + 1]
        brace, depth = i + 2, 0
        kind = None
        heads: list[tuple[str, int]] = []
        while brace < z and not (self.v[brace] == "{" and depth <= 0):
            depth += (self.v[brace] == "<") - (self.v[brace] == ">")
            if self.v[brace] in ("extends", "implements") and depth == 0:
                kind = self.v[brace].upper()
            elif kind and depth == 0 and self.kind[brace] == "i" and self.v[brace + 1] != ".":
                heads.append((kind, brace))
            brace += 1
        if brace >= z:
            return i + 1
        close = self.end[brace]
        fqn = self.define("Class", owner, name, "class", i, close)
        for k, p in heads:
            self.add("ref", k, fqn, self.v[p], self.v[p], None, self.line[p])
        p = brace + 1
        while p < close:
            head = p
            while p < close and self.v[p] not in (";", "{", "=", "("):
                p += 1
            stop = self.v[p] if p < close else ";"
            words = [q for q in range(head, p) if self.kind[q] == "i" and self.v[q] not in _MODIFIERS and not self.v[q].startswith("@")]
            if stop == "(" and words:
                end = self.end[p]
                if self.v[head].startswith("@") and words[-1:] == words[:1] and self.v[p - 1].startswith("@"):
                    p = end + 1
                    continue
                p = self.function(fqn, self.v[words[0]], "method", head, p, close, fqn)
            elif stop in (";", "=") and words:
                self.add("node", "Field", fqn, self.v[words[0]], f"{fqn}.{self.v[words[0]]}", "class", self.line[words[0]])
                colon = next((q for q in range(head, p) if self.v[q] == ":"), None)
                if colon is not None and colon + 1 < p:
                    self.typed("FIELD_TYPE", f"{fqn}.{self.v[words[0]]}", list(range(colon + 1, p)))
                line = self.line[p] if p < close else 0
                while p < close and self.v[p] != ";" and (self.line[p] == line or self.v[p - 1] in ("=", "(", "{", "[", ",", "+", "=>", "?", ":", "&&", "||")):
                    line = self.line[self.end[p]]
                    p = self.end[p] + 1
                p += p < close and self.v[p] == ";"
            else:
                p = self.end[p] + 1 if p < close else close
        return close + 1


_LINE = re.compile(r"^[ \t]*(?:(?:export|default|public|protected|private|static|abstract|final|async)\s+)*(?:(class|interface|enum|function|def)\s+([A-Za-z_$][\w$]*)|[\w<>\[\], .]+\s([A-Za-z_$][\w$]*)\s*\([^;{]*\)\s*(?:throws [\w, ]+)?\{)", re.M)


def line_facts(repo: str | None, relpath: str, text: str) -> list[tuple]:
    """What a scan by lines finds in a text that does not parse; a function belongs to the last type above it."""
    module = re.sub(r"\.\w+$", "", relpath).replace("/", ".")
    rows, owner = [], module
    for m in _LINE.finditer(text):
        line = text.count("\n", 0, m.start(m.lastindex)) + 1
        if m[1] in ("class", "interface", "enum"):
            owner = f"{module}.{m[2]}"
            rows.append((repo, relpath, "node", "Class", module, m[2], owner, "fallback", line, None, None, None))
        else:
            name = m[2] or m[3]
            if name not in _NO_CALL:
                rows.append((repo, relpath, "node", "Function", owner, name, f"{owner}.{name}", "fallback", line, None, None, None))
    return rows


def brace_facts(repo: str | None, relpath: str, text: str | None) -> list[tuple]:
    java = relpath.lower().endswith(".java")
    text = text or ""
    try:
        source = (_Java if java else _Script)(repo, relpath, text, java)
        source.unit()
        return source.rows
    except (Broken, ValueError, IndexError, RecursionError) as e:
        return [(repo, relpath, "error", "SyntaxError", None, str(e) or type(e).__name__, None, None, None, None, None, None), *line_facts(repo, relpath, text)]


def extract_braces(files: DataFrame) -> DataFrame:
    """All facts of the Java, JavaScript and TypeScript files among ``files`` (repo, relpath, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                df = pd.DataFrame(brace_facts(r.repo, r.relpath, r.text), columns=_COLUMNS)
                df[["line", "end_line", "arity"]] = df[["line", "end_line", "arity"]].astype("Int32")
                yield df

    return files.select("repo", "relpath", "text").where("relpath rlike '(?i)[.](java|m?js|m?ts|jsx|tsx)$'").mapInPandas(run, SCHEMA)
