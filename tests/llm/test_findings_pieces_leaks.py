import datetime as dt
import random

import numpy as np
import pytest

from veldspar.llm import defects, leakage, splitting

T = [dt.datetime(2025, 1, 1) + dt.timedelta(days=i) for i in range(30)]
F_SCHEMA = "ord long, repo string, owning_fqn string, subcategory string, line int, reported_at timestamp_ntz, message string, severity double, confidence string, source string, trust int, complete string"


def finding(o, line, t, msg="m", sev=1.0, conf="HIGH", src="rule", owner="f", sub="sql_injection", repo="r"):
    return (o, repo, owner, sub, line, T[t] if t is not None else None, msg, sev, conf, src, 1, "x")


def test_best_records(spark):
    rows = [
        finding(1, 10, 1), finding(2, 13, 5, owner=" f ", sub="SQL-Injection "), finding(3, 16, 3, msg="n/a"), finding(4, 20, 9), finding(4, 20, 9),
        finding(5, 50, 9, src="unknown"), finding(6, 50, 1), finding(7, None, 2), finding(8, None, 2), finding(9, 10, 2, sev=float("nan"), repo=None),
    ]
    trust = spark.createDataFrame([("rule", 3), (None, 9)], "source string, trust int")
    got = {r.first_ord: r for r in defects.best_records(spark.createDataFrame(rows, F_SCHEMA), trust).collect()}
    assert sorted(got) == [1, 4, 5, 7, 8, 9]
    assert (got[1].n_records, got[1].best_ord, got[1].is_best, got[1].message) == (3, 2, True, "m")
    assert got[4].n_records == 1 and got[5].n_records == 2 and not got[5].is_best
    empty = spark.createDataFrame([], F_SCHEMA)
    assert defects.best_records(empty, trust).count() == 0


def test_votes_trust_the_agreeing_source(spark):
    rows = []
    for i in range(30):
        for k, src in enumerate(("good", "good2", "bad")):
            rows.append(finding(i * 10 + k, 100 * i, 1, msg=("true" if src != "bad" else f"false{i}"), src=src))
    recs = defects.numbered(defects.with_defects(defects.records(spark.createDataFrame(rows, F_SCHEMA), spark.createDataFrame([("bad", 5)], "source string, trust int"))))
    winners, reliability = defects.discovered(defects._field_claims(recs), {"bad": 1.0, "good": 1 / 6, "good2": 1 / 6})
    assert reliability["good"] > reliability["bad"]
    assert {r.value for r in winners.where("field = 'message'").collect()} == {"true"}


def test_repetition_does_not_outvote(spark):
    rows = [finding(i, 10, 1, msg="often", src="bad") for i in range(9)] + [finding(20 + i, 10, 1, msg="once", src=s) for i, s in enumerate(("good", "good2"))]
    recs = defects.numbered(defects.with_defects(defects.records(spark.createDataFrame(rows, F_SCHEMA), spark.createDataFrame([], "source string, trust int"))))
    winners, _ = defects.discovered(defects._field_claims(recs), {})
    assert [r.value for r in winners.where("field = 'message'").collect()] == ["once"]


def test_representatives_are_the_dominating_records(spark, monkeypatch):
    rng = random.Random(3)
    rows = [finding(i, rng.choice((1, 2, 9, 30, 33, 37)), rng.choice((None, 1, 2)), msg=rng.choice(("m", "n/a")), src=rng.choice(("rule", "scan", "-")), owner=rng.choice("fg"), repo=rng.choice(("r", None, "s"))) for i in range(90)]
    rows += rows[:20]
    trust = spark.createDataFrame([("rule", 3), ("scan", 1)], "source string, trust int")
    df = spark.createDataFrame(rows, F_SCHEMA)
    groups: dict[int, list] = {}
    recs = defects.numbered(defects.with_defects(defects.records(df, trust))).collect()
    for r in recs:
        groups.setdefault(r.gid, []).append((r.complete, r.reported_at or dt.datetime.min, r.trust, -r.ord))
    want = set()
    for gid, grades in groups.items():
        best = [g for g in grades if all(g[k] >= max(x[k] for x in grades) for k in range(3))]
        if len(grades) > 1 and best:
            want.add((gid, -max(best)[3]))
    got = {(r.first_ord, r.best_ord) for r in defects.representatives(df, trust).where("is_best").collect()}
    assert got == want and want
    whole = {(r.first_ord, r.best_ord) for r in defects.best_records(df, trust).where("is_best and n_records > 1").collect()}
    assert whole == want
    monkeypatch.setattr(defects, "PLAN_WITNESSES", 0)
    assert {(r.first_ord, r.best_ord) for r in defects.representatives(df, trust).where("is_best").collect()} == want
    monkeypatch.setattr(defects, "_elected", lambda values, *_: values.limit(0).withColumn("votes", defects.F.lit(0.0)))
    assert defects.representatives(df, trust).count() == 0  # the rows come from the votes


def test_rounds_go_on_until_reliabilities_settle(spark):
    m, rows = 14, []  # one claim after the other turns, each a round after the one before

    def claim(line, msg, src):
        rows.append(finding(len(rows), line, 1, msg=msg, sev=float("nan"), conf=None, src=src))

    for i in range(m):
        for src, msg in ((f"s{i}", "new"), (f"s{i + 1}", "new"), (f"r{i}", "old")):
            claim(100 * i, msg, src)
    for i in range(20):
        claim(100 * (m + i), "alone", "s0")
    trust = spark.createDataFrame([(f"r{i}", 5) for i in range(m)] + [(f"s{i}", 0) for i in range(m + 1)], "source string, trust int")
    recs = defects.numbered(defects.with_defects(defects.records(spark.createDataFrame(rows, F_SCHEMA), trust)))
    claims, start = defects._field_claims(recs), {f"r{i}": 1.0 for i in range(m)} | {f"s{i}": 1 / 6 for i in range(m + 1)}
    winners, reliability = defects.discovered(claims, start)
    assert {r.value for r in winners.where("field = 'message'").collect()} == {"new", "alone"}
    assert reliability[f"r{m - 1}"] == pytest.approx(1 / 3) and reliability[f"s{m - 1}"] == pytest.approx(3 / 4)
    bounded, _ = defects.discovered(claims, start, max_rounds=10)
    assert "old" in {r.value for r in bounded.where("field = 'message'").collect()}


@pytest.mark.parametrize("seed", range(40))
def test_cuts(seed):
    r = np.random.default_rng(seed)
    n, limit, overlap = int(r.integers(1, 80)), int(r.integers(20, 90)), int(r.integers(0, 5))
    lens = r.integers(0, 30, n)
    starts = np.sort(r.choice(np.arange(1, n + 1), r.integers(0, n), replace=False))
    starts = starts[starts < n]
    pieces = splitting.cut_lines(lens, limit, overlap, starts)
    at = 0
    for i, (a, z, new) in enumerate(pieces):
        assert new == at and a <= new < z
        assert int(lens[a:z].sum()) + z - a - 1 <= limit or z - a == 1
        if i and a > max(new - overlap, 0):  # fewer lines are repeated only where more would not fit
            assert int(lens[a - 1 : new + 1].sum()) + new + 1 - a > limit
        at = z
    assert at == n


def test_pieces_of_chunks(spark):
    text = "\n".join(f"line {i} " + "x" * 10 for i in range(1, 21)) + "\n"
    files = spark.createDataFrame([("r", "a.py", "old", T[0]), ("r", "a.py", text, T[1]), ("r", "n.py", None, T[1]), ("r", "w.py", "y" * 500, T[1])], "repo string, relpath string, text string, last_indexed timestamp_ntz")
    nodes = spark.createDataFrame([("N1", "r", "./a.py", "Function", 3, 6, T[0], 1), ("n2", "r", "a.py", "Function", 9, 12, T[0], 2)], "id string, repo string, file string, label string, start_line int, end_line int, last_indexed timestamp_ntz, ord long")
    chunks = spark.createDataFrame(
        [(1, "r", "a.py", "p", ["n1"], 1, 20), (1, "r", "a.py", "p", ["n1"], 1, 20), (2, "r", "a.py", "P", [" n1 ", "n2"], 0, None), (3, "r", "n.py", "p", None, 1, 5), (4, "r", "gone.py", "p", [], 1, 5), (5, "r", "w.py", "p", [], 1, 9), (6, "r", "a.py", None, [], 1, 2), (7, "r", "a.py", "p", [], 18, 99)],
        "chunk_id long, repo string, file_path string, profile string, node_ids array<string>, start_line int, end_line int",
    )
    profiles = spark.createDataFrame([("p", 120, 2)], "profile string, piece_limit_chars int, overlap_lines int")
    pieces = splitting.chunk_pieces(chunks, files, nodes, profiles)
    assert {r.chunk_id for r in splitting.oversized(pieces).collect()} == {1, 2, 5}
    texts = {}
    for r in sorted(splitting.piece_texts(pieces, files).collect(), key=lambda r: (r.chunk_id, r.piece)):
        assert len(r.text) <= 120
        texts.setdefault(r.chunk_id, []).append(r)
    lines = text.split("\n")
    assert "\n".join(lines[i - 1] for r in texts[1] for i in range(r.new_from, r.last_line + 1)) + "\n" == text
    assert all(r.new_from - r.first_line == 2 for r in texts[1][1:])
    assert "".join(r.text for r in texts[5]) == "y" * 500
    assert splitting.oversized(splitting.chunk_pieces(chunks.limit(0), files, nodes, profiles)).count() == 0


def brute(text, item, span):
    a, b = leakage.words_of(text), leakage.words_of(item)
    runs = {tuple(b[i : i + span]) for i in range(len(b) - span + 1)}
    return any(tuple(a[i : i + span]) in runs for i in range(len(a) - span + 1))


def test_leaks_match_brute_force(spark):
    r = random.Random(2)
    vocab = ["al", "be", "ga", "de"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(3, 14)))) for i in range(20)] + [(99, None), (98, ""), (3, "al be ga de al be ga")]
    docs = [(i, r.choice(["  ", "_", "\n> **", ", "]).join(r.choice(vocab).upper() for _ in range(r.randrange(0, 60)))) for i in range(60)] + [(70, None), (71, "")]
    docs += docs[:3]
    for span, chars in ((5, 64_000_000), (5, 300), (2, 64_000_000)):
        got = sorted(tuple(x) for x in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id"), span, chars).collect())
        assert got == sorted({(d, i) for d, t in docs for i, s in items if t and s and brute(t, s, span)})
