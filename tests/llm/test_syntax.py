import datetime as dt

import pytest

from veldspar.llm import syntax

JAVA = """package a.b;
import java.util.*;
@Deprecated(since = "1")
public sealed class C<T extends Comparable<T>> extends Base implements Runnable permits D {
    private final Map<String, List<Integer>> m = new HashMap<>(), n[] = {};
    static { int[] a = new int[3], b = {1, 2,}; a[0] >>>= 2; }
    C(int... xs) throws Exception { this(); super.f(); }
    public <U> U run(final U u, Map<? super T, ?>[] k) {
        for (int i = 0, j = 1; i < 3 && j > 1; i++, j--) { if (i >> 1 == 0) continue; else break; }
        for (var x : m.keySet()) label: while (true) break label;
        try (var r = open(); s) { } catch (A | B e) { throw new X("a\\"b" + 'c'); } finally { }
        Function<Integer, int[]> f = int[]::new; Supplier<List<String>> g = ArrayList<String>::new;
        int v = switch (k) { case A, B -> 1; case "x" -> { yield 2; } default -> throw new Y(); };
        Object o = (Runnable & Serializable) () -> { }; String t = \"\"\"
            text "block" {
            \"\"\";
        if (o instanceof String q && q.length() > 2) return (U) (Object) q;
        return cond ? (a, b) -> a + b : x -> x;
    }
    enum E { A(1) { void f() {} }, B; int z; }
    record R(int a, String... b) { R { } }
    @interface I { String value() default "x"; int[] n() default {}; }
}
"""
JS = """#!/usr/bin/env node
import d, { a as b, default as c } from './x.js';
import * as ns from "y";
export * from 'z'; export { b as default2, c };
export default class extends (A, B) { static #p = 1; static { this.x = 2; } get v() { return this.#p; } async *gen() { yield* other(); } [k + 1] = 3; }
const re = /[/]\\/(x)/g, t = `a ${b + `${c}`} }`, n = 1_000n, h = 0xFF, { q = 1, ...rest } = obj, [x, , ...y] = z
let f = async ({ a, b: [c] } = {}) => { for await (const i of g) { await i } }
label: for (const k in o) { if (k) continue label; else do { x++ } while (x < 3) }
for (let i = 0, n = 3; i < n; ) { switch (i) { case 1: default: } }
a?.b?.[c]?.(d) ?? e
var u = typeof x === 'y' ? function* () {} : class {}
if (a) b / c / d; else try { throw e } catch { } finally { }
[a, b.c] = [b, a]; ({ a, b: c = 2 } = d);
x = y
++z
"""
TS = """import type { A } from './a'; import fs = require('fs');
export abstract class C<T extends object = {}> extends B<T> implements I, J {
  private readonly x?: number = 1; static y!: string; [key: string]: any;
  constructor(public a: string, protected b?: number) { super(a!); }
  abstract m(this: C, ...xs: Array<number>): asserts xs is string[];
  get v(): number { return <number>this.x; }
  @dec() f<U>(x: U | null, y = (z: number): z is 1 => true): Promise<Array<U>> { return x as unknown as Promise<Array<U>>; }
}
declare module 'm' { export function f(a: number): void; }
namespace N.M { export const enum E { A = 1, B = 'x' } }
type F = { readonly [K in keyof T as `get${K}`]?: T[K] } & (new (...a: any[]) => void) | typeof import('x');
type G<T> = T extends (infer U extends string)[] ? U : T extends [a: string, b?: number, ...rest: T[]] ? never : unique symbol;
interface I extends J<K>, L { (a: number): string; new (x): I; m?(): void; p: string[][], get z(): number }
function over(a: string): void;
function over(a: any) { const x = a satisfies string; let v = f<string>(a) < g; return x!; }
export = C;
"""


@pytest.mark.parametrize(("lang", "text"), [("java", JAVA), ("javascript", JS), ("typescript", TS), ("typescript", "let a = b < c && d > e; f(a < b, c > d)"), ("python", "match x:\n    case {'a': 1}:\n        print(f\"{x['a']}\")\n"), ("java", ""), ("javascript", "// only"), ("python", "")])
def test_valid(lang, text):
    assert syntax.valid(lang, text)


@pytest.mark.parametrize(
    ("lang", "text"),
    [
        ("java", JAVA[:-3]), ("java", "class A { void f() { int x = ; } }"), ("java", "class A { void f() { a + b; } }"), ("java", "<<<<<<< HEAD\nclass A {}\n"), ("java", "class A { String s = \"x; }"), ("java", "def f(): pass"), ("java", "class A { void f() { return 1 } }"),
        ("javascript", "let x: number = 1"), ("javascript", "{\"a\": 1}"), ("javascript", "const a;"), ("javascript", "x = `a ${b"), ("javascript", "function f( {}"), ("javascript", "a\n=======\nb"), ("javascript", "return = 3"), ("javascript", "for (const x of) {}"),
        ("typescript", "interface A { x: }"), ("typescript", "class A { f( }"), ("typescript", "const x = <div>a</div>;"), ("python", "def f(:\n"), ("python", "x = 'a\n"), ("python", "if x:\n"), ("python", "<<<<<<< a\nx\n"),
    ],
)
def test_invalid(lang, text):
    assert not syntax.valid(lang, text)


def test_maps_combine_associatively():
    text = "function f() {\n  x = `a ${g({\n b: 1})} c`; /* {\n */ return [1,\n 2]; // }\n}\n"
    parts = [syntax.lexer_map("javascript", p) for p in text.splitlines(keepends=True)]
    left = parts[0]
    for p in parts[1:]:
        left = syntax.combined(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = syntax.combined(p, right)
    whole = syntax.lexer_map("java", "class A { /* { */ String s = \"}\"; }")
    assert syntax.balanced(whole)
    assert left[""][1] == right[""][1] == ""
    j = "class A {\n /* {\n } */ int[] a = {1,\n 2};\n}\n"
    acc = None
    for line in j.splitlines(keepends=True):
        m = syntax.lexer_map("java", line)
        acc = m if acc is None else syntax.combined(acc, m)
    assert syntax.balanced(acc)


def test_current_version_and_long_files(spark):
    t0, t1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    long_ok = "class A {\n" + "  int a = 1; // {\n" * 500 + "}\n"
    rows = [
        ("r", "a.py", "def f(:", t0, 1), ("r", "a.py", "x = 1", t1, 1), ("r", "a.py", "x = 1", t1, 1), ("r", "b.py", "x = 1", t0, 1), ("r", "b.py", "x = (", t1, 1), ("r", "c.java", None, t1, 1), ("r", "d.java", "", t1, 1),
        ("r", "e.txt", "((", t1, 1), ("r", "L.java", long_ok, t1, 1), ("r", "M.java", long_ok[:-2], t1, 1), ("r", "N.js", "let a = `${\n1}`;\n" * 900, t1, 1), (None, "z.py", "(", t1, 1),
    ]
    df = spark.createDataFrame(rows, "repo string, relpath string, text string, last_indexed timestamp_ntz, valid int")
    got = {(r.repo, r.relpath): r.valid for r in syntax.verdicts(df, chunk_chars=2000).collect()}
    assert got == {("r", "a.py"): True, ("r", "b.py"): False, ("r", "c.java"): None, ("r", "d.java"): True, ("r", "L.java"): True, ("r", "M.java"): False, ("r", "N.js"): True, (None, "z.py"): False}
    rate = {(r.repo, r.lang): (r.n_files, r.n_invalid) for r in syntax.invalid_rates(syntax.verdicts(df)).collect()}
    assert rate[("r", "java")] == (3, 1)
    assert syntax.verdicts(df.limit(0)).count() == 0


N = 1500
CHAIN = " else ".join("if (x) { y(); }" for _ in range(N)) + " else { z(); }"


@pytest.mark.parametrize(
    ("lang", "text"),
    [("javascript", CHAIN), ("typescript", CHAIN), ("java", f"class A {{ void f() {{ {CHAIN} }} }}"), ("javascript", "x = " + "[" * N + "]" * N + ";"), ("typescript", "f(" * N + ")" * N + ";"), ("java", "class A { int x = " + "(" * N + "1" + ")" * N + "; }"), ("java", "class A { void f() { " + "{" * N + "}" * N + " } }")],
)
def test_nesting_has_no_bound(lang, text):
    assert syntax.valid(lang, text)
    assert not syntax.valid(lang, text.replace("x", "x x", 1) if "x" in text else text[:-2] + ";")


def test_else_without_an_if_stays_invalid():
    assert not syntax.valid("javascript", "if (x) y(); else z(); else if (a) b();")
    assert not syntax.valid("java", "class A { void f() { if (x) y(); else z(); else if (a) b(); } }")
    assert not syntax.valid("typescript", "if (x) y(); else if z();")


CASES = [
    ("java", JAVA, True), ("javascript", JS, True), ("java", JAVA[:-3], False), ("java", "import a.B;\npackage c;\n", False), ("java", "package c;\nimport a.B;\nclass A {}\nimport d.E;\n", False), ("java", "class A {\n /* {\n } */ String s = \"\"\"\n  {{\n \"\"\";\n}\n", True),
    ("javascript", "if (a) b();\nelse c();\nexport {};\nlet x = 1;\n", True), ("javascript", "if (a) b();\nlet x = ;\n", False), ("typescript", "function f(a: string): void;\nfunction f(a: any) {}\n", True),
    ("python", "'doc'\nfrom __future__ import annotations\nx = 1\n", True), ("python", "x = 1\nfrom __future__ import annotations\n", False), ("python", "@dec\ndef f():\n    pass\nif x:\n    y\nelse:\n    z\n", True), ("python", "x = f\"{d[\"}\"]}\"\ny = 1\n", True), ("python", "else:\n    z\n", False), ("python", "x = '''\ndef (\n'''\n", True),
]


@pytest.mark.parametrize(("lang", "text", "want"), CASES)
def test_statements_decide(lang, text, want):
    assert syntax.valid(lang, text) is want


def test_chunks_and_whole_files_agree(spark):
    ext = {"java": "java", "javascript": "js", "typescript": "ts", "python": "py"}
    rows = [("r", f"{i}.{ext[lang]}", text, dt.datetime(2025, 1, 1)) for i, (lang, text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "repo string, relpath string, text string, last_indexed timestamp_ntz")
    for size in (7, 40):
        got = {r.relpath: r.valid for r in syntax.verdicts(df, chunk_chars=size).collect()}
        assert got == {r[1]: c[2] for r, c in zip(rows, CASES, strict=True)}


def test_the_fold_decides(monkeypatch):
    assert not syntax.valid("python", "x = (\n")
    monkeypatch.setattr(syntax, "balanced", lambda _: False)
    assert not syntax.valid("python", "x = 1\n")


def test_the_statements_decide(monkeypatch):
    monkeypatch.setattr(syntax, "parsed", lambda *_: 2)
    assert syntax.valid("javascript", "let x = ;")


@pytest.mark.parametrize("text", ["x = `${ f( }`;", "x = `${ a ) }`;", "x = `${ a] } ${ (b }`;", "x = `${ (`a ${ b( }`) }`;", "x = `a ${ [1 } ` /* open"])
@pytest.mark.parametrize("lang", ["javascript", "typescript"])
def test_brackets_crossing_a_template_are_judged(lang, text):
    assert syntax.read(lang, text).end == syntax.UNSURE
    assert syntax.valid(lang, text) is False


def test_a_file_the_map_cannot_tell_fails_no_task(spark):
    rows = [("r", "a.js", "x = `${ f( }`;", dt.datetime(2025, 1, 1)), ("r", "b.ts", "let x = `${ f() }`;", dt.datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "repo string, relpath string, text string, last_indexed timestamp_ntz")
    for size in (65_536, 8):
        assert {r.relpath: r.valid for r in syntax.verdicts(df, chunk_chars=size).collect()} == {"a.js": False, "b.ts": True}
