"""Operators behind the context and resolver queries, on rows written for the case."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from veldspar.operators import diffs, provider, ranking, resolve
from veldspar.plans import context
from veldspar.session import shared_folder
from veldspar.sources import advisories, paged

T0, T1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
FILE = "repo string, relpath string, text string, last_indexed timestamp_ntz"


def put(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{table}.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    rows = [
        ("r", "a/x.ts", "import { f } from './y';\nexport * from '../lib/z';\nimport q from 'pkg';\n", T1), ("r", "a/y.ts", "export * from './w'\n", T1), ("r", "a/w/index.js", "let x = 1;\n", T1), ("r", "lib/z.mjs", "", T1), ("r", "a/far.ts", "import './gone';\nimport k from '../../up';\n", T1),
        ("r", "m.py", "total = {'old_key': 1}\nkeep = 2\n", T0), ("r", "m.py", "sum_all = {'new_key': 1}\nkeep = 2\nrow['k2']\n", T1), ("r", "same.py", "x", T0), ("r", "same.py", "x", T1), ("r", None, None, T1),
    ]
    return put(spark, tmp_path_factory.mktemp("files"), "files", rows, FILE)


def test_import_paths_and_reach(spark, files):
    got = {(r.relpath, r.spec): r.target for r in context.x_import_paths(spark, files).collect()}
    assert got == {("a/x.ts", "./y"): "a/y.ts", ("a/x.ts", "../lib/z"): "lib/z.mjs", ("a/y.ts", "./w"): "a/w/index.js"}
    far = {(r.relpath, r.reaches): r.depth for r in context.g_reexports(spark, files).collect()}
    assert far == {("a/x.ts", "a/y.ts"): 1, ("a/x.ts", "lib/z.mjs"): 1, ("a/y.ts", "a/w/index.js"): 1, ("a/x.ts", "a/w/index.js"): 2}


def test_changes_between_versions(spark, files):
    assert [tuple(r) for r in context.diff_removed_lines(spark, files).collect()] == [("r", "m.py", 1, "total = {'old_key': 1}")]
    assert {(r.side, r.field) for r in context.x_field_delta(spark, files).collect()} == {("removed", "old_key"), ("added", "new_key"), ("added", "k2")}
    assert [(r.repo, r.field) for r in context.u_except(spark, files).collect()] == [("r", "old_key")]
    assert [(r.old_name, r.new_name) for r in context.f_rename_pair(spark, files).collect()] == [("total", "sum_all")]
    assert [(r.path, r.is_new, r.is_deleted, r.added_lines) for r in context.diff_parse(spark, files).collect()] == [("m.py", False, False, "1,3")]


def test_unified_diffs_come_back(spark):
    r = random.Random(1)
    rows, want = [], {}
    for i in range(30):
        old = [f"l{r.randrange(9)}" for _ in range(r.randrange(1, 30))]
        new = [x for x in old if r.random() < 0.8] + ["-- new"] * r.randrange(3)
        kind = i % 5
        o, n = (None if kind == 3 else "\n".join(old)), (None if kind == 4 else "\n".join(new))
        if o == n:
            continue
        rows.append((f"d{i}", f"f{i}.py", o, n))
        want[f"d{i}"] = (f"f{i}.py", kind == 3, kind == 4)
    got = {x.diff_id: x for x in diffs.file_diffs(diffs.unified(spark.createDataFrame(rows, "diff_id string, relpath string, old string, new string"))).collect()}
    assert {k: (x.path, x.is_new, x.is_deleted) for k, x in got.items()} == want
    for d, _, o, n in rows:
        added = [(n or "").split("\n")[i - 1] for i in got[d].added_lines] if n is not None else []
        a, b = (o or "").split("\n") if o is not None else [], n.split("\n") if n is not None else []
        gone = got[d].removed_text.split("\n") if got[d].removed_text else []
        assert sorted([x for x in a if x] + [x for x in added if x]) == sorted([x for x in b if x] + [x for x in gone if x])


def test_pieces_match_a_loop(spark):
    r = random.Random(3)
    sizes = [[r.randrange(1, 30) for _ in range(r.randrange(1, 40))] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, s array<int>")
    got = {x.i: [tuple(p) for p in x.p] for x in df.select("i", context.greedy("s", 40).alias("p")).collect()}
    for i, s in enumerate(sizes):
        out, n, used = [], 0, 0
        for x in s:
            if n and used + x > 40:
                out.append((len(out), n, used))
                n, used = 0, 0
            n, used = n + 1, used + x
        assert got[i] == [*out, (len(out), n, used)]


@pytest.mark.parametrize("width", [None, 7])
def test_sessions_match_a_loop(spark, width):
    r = random.Random(8)
    rows = [(r.choice(("a", "a", "a", None)), r.choice((None, *range(0, 200))), i) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, t int, i int")
    got = {x.i: x.session for x in ranking.gap_sessions(df, ["g"], F.col("t"), ["t", "i"], 4, width).collect()}
    for g in ("a", None):
        session, last = 0, None
        for _, t, i in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
            if last is None or t is None or t - last > 4:
                session += 1
            last = t
            assert got[i] == session


def test_places_in_order(spark):
    rows = [(i, (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(5)
    got = {r.v: r.pos for r in ranking.numbered_in_order(df, [F.desc("v")]).collect()}
    assert got == {v: 101 - v for v in range(101)}


def test_provider_retries_and_fails_alone(spark):
    class Flaky:
        """Answers properly at the third call only, never for some prompts."""

        def __init__(self):
            self.calls = {}

        def complete(self, prompt):
            self.calls[prompt] = self.calls.get(prompt, 0) + 1
            if prompt == "never" or self.calls[prompt] < 3:
                raise TimeoutError
            return 'text [{"title": "t of ' + prompt + '"}, {"severity": "high"}, 3] more'

    df = spark.createDataFrame([(1, "a"), (2, "never"), (3, None), (4, "b")], "k int, p string").coalesce(1)
    got = sorted(tuple(r) for r in provider.completed(df, "k", "p", Flaky()).collect())
    assert got == [(1, "t of a", "info"), (4, "t of b", "info")]
    assert provider.answers("no array") is None and provider.answers("[1, {}]") == [{}]


def test_paged_source_and_advisories(spark):
    df = spark.createDataFrame([(f"r{i}",) for i in range(5)], "repo string")
    back = paged.read_saved(df, 2)
    assert sorted(r.repo for r in back.collect()) == [f"r{i}" for i in range(5)] and back.rdd.getNumPartitions() == 3
    known = spark.createDataFrame([("p", "A-1"), ("p", "A-1"), ("p", "A-2")], "package string, advisory string")
    packages = spark.createDataFrame([("p",), ("q",), ("q",), ("",)], "package string")
    assert {tuple(r) for r in advisories.lookup(packages, known).collect()} == {("p", "ok", 2), ("q", "ok", 0)}
    assert json.dumps("x") and shared_folder(spark)


def test_call_cascade_prefers_scope_then_imports_then_receivers(spark):
    nodes = spark.createDataFrame(
        [
            ("f1", "r", "File", "a.py", "a", "a.py", "", "", None), ("c1", "r", "Class", "Box", "a.Box", "a.py", "", "", None), ("m1", "r", "Function", "run", "a.Box.run", "a.py", "", "method", 1), ("m2", "r", "Function", "go", "a.Box.go", "a.py", "", "method", 0),
            ("c2", "r", "Class", "Box", "b.Box", "b.py", "", "", None), ("m3", "r", "Function", "run", "b.Box.run", "b.py", "", "method", 1), ("g1", "r", "Function", "far", "z.far", "z.py", "", "function", 2), ("g2", "r", "Function", "far", "y.far", "y.py", "", "function", 1),
        ],
        "id string, repo string, label string, name string, fqn string, file string, package string, kind string, param_count int",
    )
    parents = spark.createDataFrame([("m1", "c1"), ("m2", "c1"), ("m3", "c2"), ("c1", "f1")], "child string, parent string")
    schema = "ref_id int, type string, repo string, src string, target string, recv string, recv_type string, import_fqn string, kind_hint string, ref_file string, call_arity int"
    refs = spark.createDataFrame(
        [
            (1, "CALLS", "r", "m2", "run", "self", None, None, None, "a.py", 1), (2, "CALLS", "r", "g1", "run", None, "Box", None, None, "z.py", 1), (3, "IMPORTS", "r", "f9", "Box", None, None, "b.Box", None, "z.py", -1),
            (4, "CALLS", "r", "m2", "far", None, None, None, None, "a.py", 2), (5, "CALLS", "r", "m2", "nothing", None, None, None, None, "a.py", 2), (6, "OF_TYPE", "r", "g1", "Box", None, None, None, None, "z.py", -1),
        ],
        schema,
    )
    got = {(r.ref_id, r.id): r.strategy for r in resolve.resolved_calls(refs, nodes, parents).collect()}
    assert got == {(1, "m1"): "same_scope", (2, "m3"): "imports_qualified_exact", (4, "g1"): "name"}
    assert [(r.ref_id, r.id, r.strategy) for r in resolve.resolved_types(refs, nodes, parents, ("OF_TYPE",)).collect()] == [(6, "c2", "imports_qualified_exact")]
    assert resolve.resolved_calls(refs.limit(0), nodes, parents).count() == 0


def test_secrets_and_links_between_languages(spark, tmp_path):
    from veldspar.plans import audit, resolver

    key, loose = "AKIA" + "Z" * 16, "q8Zr2LkP0xWv7NbT4mYc9HsDfG1jKe"
    docs = [(1, f"id {key} here"), (2, f"blob {loose}= end"), (3, "password = 'dummy-value-1'"), (4, "a" * 40), (5, None), (6, "")]
    put(spark, tmp_path, "documents", docs, "doc_id long, text string")
    rows = [("r", "srv.py", "@app.get('/items')\ndef f(): pass\n@app.post(\"/twice\")\n", T1), ("r", "other.py", "@app.post('/twice')\ntoken: \"s3cr3t-s3cr3t\"\n", T1), ("r", "ui.ts", "fetch('/items'); axios.post('/twice'); fetch('/none')\n", T1), ("r", "ui.py", "requests.get('/items')\n", T1)]
    d = put(spark, tmp_path, "files", rows, FILE)
    found = {(r.place, r.kind, r.grade) for r in audit.x_secrets(spark, d).collect()}
    assert {("d1", "aws", "high"), ("d2", "entropy", "medium"), ("d3", "assigned", "low"), ("r:other.py", "assigned", "high")} <= found and not any(p in ("d4", "d5", "d6") for p, *_ in found)
    assert {(r.caller, r.target, r.route) for r in resolver.j_cross_lang(spark, d).collect()} == {("r:ui.ts", "r:srv.py", "/items")}
    routes = {(r.kind, r.method, r.route): r.n for r in audit.x_route_regex(spark, d).collect()}
    assert routes[("route", "POST", "/twice")] == 2 and routes[("client", "GET", "/items")] == 1
