import datetime as dt
import random

import pytest

from veldspar.operators import references as rf

T = [dt.datetime(2025, 1, 1) + dt.timedelta(days=i) for i in range(40)]


@pytest.mark.parametrize("target", [500_000, 20])
def test_orphans_match_brute_force(spark, target):
    r = random.Random(5)
    keys = ["hot", *"abcdefg"]
    refs = [(r.choice(keys) if r.random() < 0.6 else "hot", r.choice([*T, None]), i) for i in range(300)] + [(None, T[0], 999)]
    spans = [(r.choice(keys), r.choice(T), r.choice([None, *T])) for _ in range(12)] + [("a", None, None)]
    refs_df = spark.createDataFrame(refs, "key string, t timestamp_ntz, i int")
    changes = [(k, a, 1) for k, a, _ in spans] + [(k, max(a, z), -1) for k, a, z in spans if a and z]
    changes_df = spark.createDataFrame(changes, "key string, t timestamp_ntz, delta int")
    far = dt.datetime(9999, 12, 31)
    good = lambda k, t: any(s[0] == k and s[1] and s[1] <= (t or far) and (s[2] is None or s[2] > (t or far)) for s in spans)
    want = {i for k, t, i in refs if k is None or not good(k, t)}
    assert len(want) > 10
    assert {x.i for x in rf.orphans_at(refs_df, changes_df, ["key"], target).collect()} == want


def test_current_orphans(spark):
    refs = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", -1), ("c", 1), (None, 1)], "key string, delta int")
    have = spark.createDataFrame([("a", 1), ("a", -1), ("c", 1), ("d", 1)], "key string, delta int")
    assert [tuple(r) for r in rf.orphan_keys(rf.maintained(None, refs, have, ["key"])).collect()] == [("a", 2, 0)]


def test_state_of_many_batches_is_that_of_one(spark):
    r = random.Random(2)
    refs = [(r.choice("abcdef"), r.choice((1, -1))) for _ in range(200)]
    have = [(r.choice("abcdef"), r.choice((1, -1))) for _ in range(60)]
    state = None
    for i in range(3):
        one = [spark.createDataFrame(x[i::3], "key string, delta int") for x in (refs, have)]
        state = rf.checkpointed(rf.maintained(state, *one, ["key"]))
    whole = rf.maintained(None, spark.createDataFrame(refs, "key string, delta int"), spark.createDataFrame(have, "key string, delta int"), ["key"])
    assert sorted(state.collect()) == sorted(whole.collect())


def test_dangling_on_empty_tables(spark):
    e = spark.createDataFrame([], "dst string, ord long, seen_at timestamp_ntz")
    r = spark.createDataFrame([], "ref_id long, src string, target_name string, repo string, seen_at timestamp_ntz")
    n = spark.createDataFrame([], "id string, name string, fqn string, repo string, last_indexed timestamp_ntz")
    g = spark.createDataFrame([], "id string, removed_at timestamp_ntz")
    assert rf.dangling(e, r, n, n, g).count() == 0


def test_dangling_cases(spark):
    n = spark.createDataFrame([("AA", "f", "m.f", "r", T[5]), ("bb", "g", "m.g", "r", T[5])], "id string, name string, fqn string, repo string, last_indexed timestamp_ntz")
    s = spark.createDataFrame([("cc", "log", "lib.log", "lib", T[0])], "id string, name string, fqn string, repo string, last_indexed timestamp_ntz")
    g = spark.createDataFrame([(" BB ", T[9])], "id string, removed_at timestamp_ntz")
    e = spark.createDataFrame([(" aa\t", 1, T[6]), ("aa", 2, T[4]), ("bb", 3, T[9]), ("bb", 4, T[8]), ("zz", 5, T[8]), ("zz", 5, T[8]), (None, 6, T[1]), ("CC", 7, T[1])], "dst string, ord long, seen_at timestamp_ntz")
    r = spark.createDataFrame(
        [(1, "aa", " f ", "r", T[6]), (2, "aa", "F", "r", T[6]), (3, " ", "m.g", "r", T[10]), (4, None, "log", "r", T[3]), (5, "aa", "f", "other", T[6])], "ref_id long, src string, target_name string, repo string, seen_at timestamp_ntz"
    )
    got = {(x.tbl, x.field, x.row_id) for x in rf.dangling(e, r, n, s, g).collect()}
    assert got == {("edges", "dst", 2), ("edges", "dst", 3), ("edges", "dst", 5), ("refs", "target_name", 2), ("refs", "target_name", 3), ("refs", "target_name", 5)}
