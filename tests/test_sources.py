import json
import subprocess

import pytest
from pyspark.sql import functions as F

from lectern.operators import incremental as I
from lectern.sources import logs, markdown, scope
from lectern.sources.snapshot import Conflict, Index, NewerSchema
from lectern.streaming.ingest import calls_by_window, ingest


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    for path, text in {"b.md": "# B\n\ntext", "sub/a.MARKDOWN": "# A\n", "node_modules/x.md": "# no", "skip/y.md": "# no", "z.txt": "no", ".d/c.md": "intro"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_scan_and_parse(spark, tree):
    found = markdown.scan(spark, str(tree), ["skip"])
    assert [r["file_path"] for r in markdown.in_walk_order(found).collect()] == ["b.md", "sub/a.MARKDOWN", ".d/c.md"]
    made = markdown.parsed(found.select(F.xxhash64("file_path").alias("doc_id"), "file_path", "text")).cache()
    assert {r["file_path"]: r["title"] for r in made.collect()} == {"b.md": "B", "sub/a.MARKDOWN": "A", ".d/c.md": "c"}
    rows = markdown.passages(markdown.sections(made)).select("content", "embedded").collect()
    assert sorted(map(tuple, rows)) == [("intro", "[Overview / Preamble]: intro"), ("text", "B: text")]


def test_snapshots(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    assert index.current() is None
    first = index.commit({"documents": spark.range(3)}, None, high_water=3)
    assert index.table("documents").count() == 3 and first["generation"] == 1
    index.commit({"documents": spark.range(5)}, first)
    assert index.table("documents").count() == 5 and index.table("documents", first["snapshot"]).count() == 3 and index.current()["generation"] == 2
    with pytest.raises(Conflict):
        index.commit({"documents": spark.range(1)}, first)
    (tmp_path / "index" / "_CURRENT").write_text(json.dumps(index.current() | {"schema": 99}))
    for crc in (tmp_path / "index").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(NewerSchema):
        index.current()


def test_streamed_ingestion(spark, tree, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ingest(spark, str(tree), out, checkpoint).awaitTermination(120)
    assert spark.read.parquet(out).filter("heading_level = 1").select("heading_title").distinct().count() == 3
    (tree / "new.md").write_text("# New\n")
    ingest(spark, str(tree), out, checkpoint).awaitTermination(120)
    assert spark.read.parquet(out).filter("heading_title = 'New'").count() == 1


def test_windows_of_calls(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = calls_by_window(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == events.count()


def test_logs(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": {"b": 1}}\nbroken\n{"a": {"b": "x"}}\n')
    assert [r["b"] for r in logs.json_lines(spark, str(tmp_path / "l.jsonl"), {"b": "$.a.b bigint"}).collect()] == [1, None]
    (tmp_path / "q.json").write_text(json.dumps({"dev": {"identifier": [{"query": "x", "expected": "a::b", "also_valid": {"c": 2}}]}}))
    queries = logs.labelled_queries(spark, str(tmp_path / "q.json"))
    assert sorted((r["label"], r["grade"]) for r in logs.qrels(queries).collect()) == [("a::b", 3), ("c", 2)]


def test_ids_are_never_reused(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 101).alias("k"))
    found = I.numbered(rows, [F.col("k")], 500).orderBy("k").collect()
    assert [r["section_id"] for r in found] == list(range(501, 601))


def test_scope(spark, tree, tmp_path):
    subprocess.run(["git", "init", "-q", str(tree)], check=True)
    assert scope.ignored(str(tmp_path / "index"))[0] != "applied"
    (tree / ".gitignore").write_text("skip/\nb.md\n")
    state, prefixes = scope.ignored(str(tree))
    assert state == "applied" and sorted(prefixes) == ["b.md", "skip/"]
    files = spark.createDataFrame([("b.md",), ("skip/y.md",), ("skip.md",), ("sub/b.md",)], "file_path string")
    assert sorted(r[0] for r in scope.without_ignored(files, prefixes).collect()) == ["skip.md", "sub/b.md"]
    with scope.exclusive(spark, str(tmp_path / "home")), pytest.raises(scope.Busy), scope.exclusive(spark, str(tmp_path / "home")):
        pass
    with scope.exclusive(spark, str(tmp_path / "home")):
        pass
    assert scope.home_of(str(tree), "/x").startswith("/x/docs-") and len(scope.home_of(str(tree), "/x").rpartition("-")[2]) == 12
