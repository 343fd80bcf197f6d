"""Queries that take every row, on small tables written for the case."""

import datetime as dt

from veldspar.plans import graphs, texts


def put(spark, tmp_path, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    return str(tmp_path)


EDGE = "type string, src string, dst string, confidence string"


def test_reverse_dependents_of_every_node(spark, tmp_path):
    hot = [("CALLS", f"c{i}", "hot", None) for i in range(9)]
    more = [(" calls ", "X ", "c0", "SURE"), ("IMPORTS", "hot", "c0", None), ("CALLS", "y", "x", "AMBIGUOUS"), ("USES", "z", "x", None), ("CALLS", None, "x", None)]
    d = put(spark, tmp_path, "edges", hot + more, EDGE)
    got = {(r.origin, r.node): r.hops for r in graphs.g_reverse_dependents(spark, d).collect()}
    want = {("hot", f"c{i}"): 1 for i in range(9)} | {("hot", "x"): 2, ("c0", "x"): 1, ("c0", "hot"): 1} | {("c0", f"c{i}"): 2 for i in range(1, 9)}
    assert got == want


def test_paths_of_any_length_are_matched(spark, tmp_path):
    paths = ["a.py", "b.py", "x/a.py", "x/b.py", "y/a.py", "p/q/r/a.py", "p/q/r/b.py", "p/q/s/a.py", "1/2/3/4/5/6.py", "p/q/r/a.py"]
    d = put(spark, tmp_path, "files", [("r", x) for x in paths] + [("o", "a.py"), ("o", None), (None, "a.py")], "repo string, relpath string")
    got = {(r.repo, r.path): r.n_like for r in texts.j_endpoint_match(spark, d).collect()}
    same = lambda x, y: x.count("/") == y.count("/") and x.rpartition("/")[0] == y.rpartition("/")[0]
    assert got == {("r", x): sum(same(x, y) for y in set(paths)) for x in paths} | {("o", "a.py"): 1}


def test_components_over_all_linking_edges(spark, tmp_path):
    edges = [("CALLS", "a", "b"), ("INSTANTIATES", "b", "c"), ("extends ", "D ", "c"), ("OVERRIDES", "e", "d"), ("IMPORTS", "e", "x"), ("CALLS", "p", "q"), ("CALLS", "p", "p")]
    edges += [("EXTENDS", "sub", "sup"), ("CONTAINS", "sub", "m1"), ("DEFINES", "sup", "m2"), ("CALLS", "m1", "far")]
    put(spark, tmp_path, "edges", [(*e, None) for e in edges], EDGE)
    nodes = [(i, "run", "Function", 1, 1, dt.datetime(2024, 1, 1)) for i in ("m1", "m2")]
    d = put(spark, tmp_path, "nodes", nodes, "id string, name string, label string, param_count int, ord int, last_indexed timestamp_ntz")
    assert {(r.component, r.n_nodes) for r in graphs.g_components(spark, d).collect()} == {("a", 5), ("p", 2), ("sub", 2), ("far", 3)}
