import json

from veldspar.streaming.ingest import ingest


def test_ingest_is_incremental_and_idempotent(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()

    def deliver(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("repo", "relpath", "text"), r, strict=True))) for r in rows))
        ingest(spark, str(inbox), str(out), str(tmp_path / "check")).awaitTermination()

    deliver("1.json", ("r", "a.py", "def f(): pass\n"), ("r", "a.py", "def f(): pass\n"), ("r", "b.py", None))
    deliver("2.json", ("r", "a.py", "def f(): pass\n"), ("r", "a.py", "def g(): pass\n"))
    files = spark.read.parquet(str(out / "files"))
    assert files.count() == 3
    facts = spark.read.parquet(str(out / "facts"))
    assert sorted(r.name for r in facts.where("type = 'Function' and fact = 'node'").collect()) == ["f", "g"]
