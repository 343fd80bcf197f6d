"""Python source text as nodes, structural edges and unresolved references.

One file is one row and is parsed in the task that reads it; the result is one
long table of facts, so a file's nodes, edges and references are read off it
by plain filters. A text that does not parse gives a single ``error`` fact.

Nulls: null and empty texts give the File node alone.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Vocabularies of receivers, verbs and decorators.
HTTP_CLIENTS = frozenset("requests httpx session client http aiohttp".split())
HTTP_VERBS = frozenset("get post put delete patch head options".split())
EMIT_VERBS = frozenset("emit publish produce send_message dispatch_event".split())
CONSUME_DECORATORS = frozenset("subscribe consumer listener on_event event_handler".split())
BUSES = frozenset("bus broker producer events queue topic".split())
AUTH_EXACT = frozenset("login_required requires_auth permission_required roles_required authenticated".split())
LOCKS = frozenset("Lock RLock Semaphore BoundedSemaphore Condition".split())
INERT = frozenset("len print range isinstance str int float list dict set tuple bool repr sorted enumerate zip min max sum".split())

SCHEMA = "repo string, relpath string, fact string, type string, src string, name string, fqn string, value string, line int, end_line int, arity int, args array<string>"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _dotted(node: ast.AST) -> list[str]:
    """Name parts of a.b.c, or nothing if it is no such chain."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return [node.id, *reversed(parts)]
    return ["", *reversed(parts)] if parts else []


def _first_string(call: ast.Call) -> str | None:
    for a in call.args:
        if isinstance(a, ast.Constant) and isinstance(a.value, str):
            return a.value
    return None


def _own(body: list[ast.stmt]) -> Iterator[ast.AST]:
    """All nodes of a body that do not lie in a nested definition."""
    todo: list[ast.AST] = list(reversed(body))
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda):
            todo += reversed(list(ast.iter_child_nodes(n)))


class _File:
    def __init__(self, repo: str | None, relpath: str, tree: ast.Module, n_lines: int) -> None:
        self.rows: list[tuple] = []
        self.repo, self.relpath = repo, relpath
        self.module = re.sub(r"\.pyi?$", "", relpath).replace("/", ".")
        self.globals = {t.id for s in tree.body if isinstance(s, ast.Assign | ast.AnnAssign) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)}
        self.add("node", "File", None, relpath.rsplit("/", 1)[-1], self.module, line=1, end=n_lines)
        for g in sorted(self.globals):
            self.add("node", "Field", self.module, g, f"{self.module}.{g}", "module")
        self.imports(tree)
        self.definitions(tree.body, self.module, None)

    def add(self, fact: str, kind: str, src: str | None, name: str | None, fqn: str | None = None, value: str | None = None, line: int | None = None, end: int | None = None, arity: int | None = None, args: list[str] | None = None) -> None:
        self.rows.append((self.repo, self.relpath, fact, kind, src, name, fqn, value, line, end, arity, args))

    def imports(self, tree: ast.Module) -> None:
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.add("ref", "IMPORTS", self.module, a.name.split(".")[-1], a.name, a.asname, n.lineno)
            elif isinstance(n, ast.ImportFrom):
                base = "." * n.level + (n.module or "")
                for a in n.names:
                    self.add("ref", "IMPORTS", self.module, a.name, f"{base}.{a.name}" if base.strip(".") else base + a.name, a.asname, n.lineno)

    def definitions(self, body: list[ast.stmt], owner: str, cls: str | None) -> None:
        for n in _own(body):
            if isinstance(n, ast.ClassDef):
                fqn = f"{owner}.{n.name}"
                self.add("node", "Class", owner, n.name, fqn, ast.get_docstring(n), n.lineno, n.end_lineno)
                self.add("edge", "CONTAINS" if owner == self.module else "DEFINES", owner, n.name, fqn)
                for b in n.bases:
                    if parts := _dotted(b.value if isinstance(b, ast.Subscript) else b):
                        self.add("ref", "EXTENDS", fqn, parts[-1], ".".join(parts), None, n.lineno)
                self.decorators(n, fqn)
                for s in n.body:
                    targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
                    for t in targets:
                        if isinstance(t, ast.Name):
                            self.field(fqn, t.id, s.value, s.lineno)
                self.definitions(n.body, fqn, fqn)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                self.function(n, owner, cls)

    def field(self, cls: str, name: str, value: ast.AST | None, line: int) -> None:
        lock = isinstance(value, ast.Call) and bool(p := _dotted(value.func)) and p[-1] in LOCKS
        row = ("node", "Field", cls, name, f"{cls}.{name}")
        if not any(r[2:7] == row for r in self.rows):
            self.add(*row, value="lock" if lock else "class", line=line)

    def decorators(self, n: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef, fqn: str) -> None:
        for d in n.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            parts = _dotted(call.func if call else d)
            if not parts:
                continue
            tail = parts[-1]
            self.add("ref", "ANNOTATED_WITH", fqn, tail, ".".join(parts), None, d.lineno)
            text = _first_string(call) if call else None
            if call and text and text.startswith("/") and (tail in HTTP_VERBS or tail in ("route", "api_route")):
                methods = [tail.upper()] if tail in HTTP_VERBS else [e.value for k in call.keywords if k.arg == "methods" and isinstance(k.value, ast.List | ast.Tuple) for e in k.value.elts if isinstance(e, ast.Constant)] or ["GET"]
                for m in methods:
                    self.add("node", "Endpoint", fqn, f"{m} {text}", f"{m} {text}", None, d.lineno)
                    self.add("edge", "EXPOSES", fqn, f"{m} {text}", f"{m} {text}")
            elif tail in CONSUME_DECORATORS and text:
                self.add("ref", "CONSUMES_EVENT", fqn, text, None, "sure", d.lineno)
            elif tail in AUTH_EXACT:
                self.add("ref", "REQUIRES_AUTH", fqn, text or "AUTH_REQUIRED", None, "sure", d.lineno)
            elif "auth" in tail.lower() or "permission" in tail.lower():
                self.add("ref", "REQUIRES_AUTH", fqn, text or "AUTH_REQUIRED", None, "fuzzy", d.lineno)

    def function(self, n: ast.FunctionDef | ast.AsyncFunctionDef, owner: str, cls: str | None) -> None:
        fqn = f"{owner}.{n.name}"
        a = n.args
        params = [*a.posonlyargs, *a.args]
        names = [p.arg for p in params] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [p.arg for p in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
        if cls and names and names[0] in ("self", "cls"):
            names = names[1:]
        self.add("node", "Function", owner, n.name, fqn, "method" if cls == owner else "function", n.lineno, n.end_lineno, len(names), names)
        self.add("edge", "CONTAINS" if owner == self.module else "DEFINES", owner, n.name, fqn)
        self.decorators(n, fqn)
        for p in [*params, *a.kwonlyargs]:
            self.types("PARAM_TYPE", fqn, p.annotation)
        self.types("RETURN_TYPE", fqn, n.returns)
        own = list(_own(n.body))
        branches = sum(isinstance(x, ast.If | ast.IfExp | ast.ExceptHandler | ast.match_case) for x in own)
        loops = sum(isinstance(x, ast.For | ast.AsyncFor | ast.While | ast.comprehension) for x in own)
        self.add("metric", "cyclomatic", fqn, n.name, None, None, n.lineno, n.end_lineno, 1 + branches + loops, [str(branches), str(loops), str(n.end_lineno - n.lineno + 1)])
        self.state(own, n, fqn, cls)
        held = self.receivers(own, n)
        for x in own:
            if isinstance(x, ast.Call):
                self.call(x, fqn, held)
            elif isinstance(x, ast.Raise) and x.exc is not None:
                if parts := _dotted(x.exc.func if isinstance(x.exc, ast.Call) else x.exc):
                    self.add("ref", "THROWS", fqn, parts[-1], None, None, x.lineno)
            elif isinstance(x, ast.ExceptHandler) and x.type is not None:
                for t in x.type.elts if isinstance(x.type, ast.Tuple) else [x.type]:
                    if parts := _dotted(t):
                        self.add("ref", "CATCHES", fqn, parts[-1], None, None, x.lineno)
        self.flow(n, fqn, names, cls)
        self.definitions(n.body, fqn, cls)

    def types(self, kind: str, fqn: str, annotation: ast.AST | None) -> None:
        """The primary type, and HAS_GENERIC for each type argument."""
        if annotation is None:
            return
        if isinstance(annotation, ast.Subscript):
            self.types(kind, fqn, annotation.value)
            inner = annotation.slice
            for t in inner.elts if isinstance(inner, ast.Tuple) else [inner]:
                self.types("HAS_GENERIC", fqn, t)
        elif isinstance(annotation, ast.BinOp):
            self.types(kind, fqn, annotation.left)
            self.types(kind, fqn, annotation.right)
        elif parts := _dotted(annotation):
            self.add("ref", kind, fqn, parts[-1], ".".join(parts), None, annotation.lineno)

    def receivers(self, own: list[ast.AST], n: ast.FunctionDef | ast.AsyncFunctionDef) -> dict[str, str]:
        """Local names whose class shows from ``v = C()`` or an annotation."""
        out = {p.arg: parts[-1] for p in [*n.args.args, *n.args.kwonlyargs] if p.annotation is not None and (parts := _dotted(p.annotation))}
        for x in own:
            if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name) and (parts := _dotted(x.value.func)) and parts[-1][:1].isupper():
                out[x.targets[0].id] = parts[-1]
        return out

    def call(self, x: ast.Call, fqn: str, held: dict[str, str]) -> None:
        parts = _dotted(x.func)
        if not parts:
            return
        tail, recv = parts[-1], parts[-2] if len(parts) > 1 else None
        text = _first_string(x)
        splat = any(isinstance(a, ast.Starred) for a in x.args) or any(k.arg is None for k in x.keywords)
        args = [a.id for a in x.args if isinstance(a, ast.Name)] + [k.value.id for k in x.keywords if isinstance(k.value, ast.Name)]
        self.add("ref", "INSTANTIATES" if tail[:1].isupper() else "CALLS", fqn, tail, ".".join(parts), held.get(recv, None) if recv else None, x.lineno, None, -1 if splat else len(x.args) + len(x.keywords), args)
        if recv and recv.lower() in HTTP_CLIENTS and text and (tail in HTTP_VERBS and re.match(r"(https?:)?/", text)):
            self.add("ref", "CALLS_API", fqn, text, None, tail.upper(), x.lineno)
        if recv and text and (tail in EMIT_VERBS or tail == "send" and recv.lower() in BUSES):
            self.add("ref", "EMITS_EVENT", fqn, text, None, "sure", x.lineno)
        elif recv and text and tail == "send":
            self.add("ref", "EMITS_EVENT", fqn, text, None, "fuzzy", x.lineno)

    def state(self, own: list[ast.AST], n: ast.FunctionDef | ast.AsyncFunctionDef, fqn: str, cls: str | None) -> None:
        declared = {g for x in own if isinstance(x, ast.Global) for g in x.names}
        local = {x.id for x in own if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)} - declared
        local |= {p.arg for p in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]}
        seen: set[tuple[str, str]] = set()

        def touch(kind: str, target: str, line: int) -> None:
            if (kind, target) not in seen:
                seen.add((kind, target))
                self.add("ref", kind, fqn, target, None, None, line)

        augmented = {id(x.target) for x in own if isinstance(x, ast.AugAssign)}
        stored = {id(x.value) for x in own if isinstance(x, ast.Subscript | ast.Attribute) and isinstance(x.ctx, ast.Store)}
        values = {id(t): x.value for x in own if isinstance(x, ast.Assign) for t in x.targets}
        for x in own:
            if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self" and cls:
                if isinstance(x.ctx, ast.Store):
                    self.field(cls, x.attr, values.get(id(x)), x.lineno)
                    touch("WRITES", f"{cls}.{x.attr}", x.lineno)
                if isinstance(x.ctx, ast.Load) or id(x) in augmented:
                    touch("READS", f"{cls}.{x.attr}", x.lineno)
            elif isinstance(x, ast.Name) and x.id in self.globals and x.id not in local:
                full = f"{self.module}.{x.id}"
                if isinstance(x.ctx, ast.Store) or id(x) in stored:
                    touch("WRITES", full, x.lineno)
                if isinstance(x.ctx, ast.Load) or id(x) in augmented:
                    touch("READS", full, x.lineno)

    def flow(self, n: ast.FunctionDef | ast.AsyncFunctionDef, fqn: str, names: list[str], cls: str | None) -> None:
        """One forward pass: which parameters (by number) and fields (by name) reach arguments, fields and the result."""
        origin: dict[str, set[str]] = {p.lstrip("*"): {str(i)} for i, p in enumerate(names)}

        def of(x: ast.AST | None) -> set[str]:
            out: set[str] = set()
            for y in ast.walk(x) if x is not None else ():
                if isinstance(y, ast.Name):
                    out |= origin.get(y.id, set())
                elif cls and isinstance(y, ast.Attribute) and isinstance(y.value, ast.Name) and y.value.id == "self" and isinstance(y.ctx, ast.Load):
                    out.add(f"{cls}.{y.attr}")
            return out

        for s in _statements(n.body):
            for x in _expressions(s):
                if isinstance(x, ast.Call) and (parts := _dotted(x.func)):
                    given = [(str(i), a) for i, a in enumerate(x.args)] + [(k.arg or "**", k.value) for k in x.keywords]
                    for where, a in given:
                        who = of(a)
                        if who or parts[-1] not in INERT:
                            self.add("flow", "PASSES", fqn, parts[-1], ".".join(parts), where, x.lineno, None, 1 if isinstance(a, ast.Constant) else 0, sorted(who))
            if isinstance(s, ast.Assign | ast.AnnAssign | ast.AugAssign) and s.value is not None:
                who = of(s.value)
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    for y in t.elts if isinstance(t, ast.Tuple | ast.List) else [t]:
                        if isinstance(y, ast.Name):
                            origin[y.id] = who | (origin.get(y.id, set()) if isinstance(s, ast.AugAssign) else set())
                        elif isinstance(y, ast.Attribute) and isinstance(y.value, ast.Name) and y.value.id == "self" and cls and who:
                            self.add("flow", "FIELD_WRITE", fqn, f"{cls}.{y.attr}", None, None, s.lineno, None, None, sorted(who))
            elif isinstance(s, ast.For | ast.AsyncFor) and isinstance(s.target, ast.Name):
                origin[s.target.id] = of(s.iter)
            elif isinstance(s, ast.Return) and (who := of(s.value)):
                self.add("flow", "RETURNS", fqn, None, None, None, s.lineno, None, None, sorted(who))


def _statements(body: list[ast.stmt]) -> Iterator[ast.stmt]:
    for s in body:
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            continue
        yield s
        for part in ("body", "orelse", "finalbody"):
            yield from _statements(getattr(s, part, []))
        for h in getattr(s, "handlers", []):
            yield from _statements(h.body)
        for c in getattr(s, "cases", []):
            yield from _statements(c.body)


def _expressions(s: ast.stmt) -> Iterator[ast.AST]:
    """The nodes of a statement's own expressions, without the statements inside it."""
    todo: list[ast.AST] = [c for c in ast.iter_child_nodes(s) if isinstance(c, ast.expr | ast.withitem | ast.keyword)]
    while todo:
        n = todo.pop(0)
        yield n
        if not isinstance(n, ast.Lambda):
            todo += list(ast.iter_child_nodes(n))


def python_facts(repo: str | None, relpath: str, text: str | None) -> list[tuple]:
    text = text or ""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
            return _File(repo, relpath, tree, text.count("\n") + 1).rows
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(repo, relpath, "error", "SyntaxError", None, getattr(e, "msg", None) or str(e), None, None, getattr(e, "lineno", None), None, None, None)]


def extract_python(files: DataFrame) -> DataFrame:
    """All facts of the Python files among ``files`` (repo, relpath, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                df = pd.DataFrame(python_facts(r.repo, r.relpath, r.text), columns=_COLUMNS)
                df[["line", "end_line", "arity"]] = df[["line", "end_line", "arity"]].astype("Int32")
                yield df

    return files.select("repo", "relpath", "text").where("relpath rlike '[.]pyi?$'").mapInPandas(run, SCHEMA)
