import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.engine import Ambiguous, Engine, ForeignWeights
from lectern.operators import keyword
from lectern.sources.snapshot import NewerSchema

GUIDE = """# Guide

How the tool is set up.

## Retries

The client tries again with `--max-retries` when a request fails. Waits grow between tries.

## Storage

Files are kept below the data folder, and old ones are removed each night.
"""
LONG = "# Flags\n\n" + "\n\n".join(f"Paragraph {i} talks about topic{i} in some words." for i in range(8)) + "\n\nThe switch --dry-run prints what would happen.\n\n" + "\n\n".join(f"More text {i} follows here." for i in range(5))


@pytest.fixture
def engine(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "a").mkdir(parents=True)
    (root / "guide.md").write_text(GUIDE)
    (root / "a" / "flags.md").write_text(LONG)
    (root / "a" / "guide.md").write_text("# Other\n\nNothing here.\n")
    made = Engine(spark, str(tmp_path / "index"))
    report = made.index_directory(str(root))
    assert report.states == {"new": 3} and not report.failures and report.sections == 5
    made.root = root
    return made


def test_round(engine):
    assert [(r["file_path"], r["title"], r["sections"]) for r in engine.list_documents().collect()] == [("guide.md", "Guide", 3), ("a/flags.md", "Flags", 1), ("a/guide.md", "Other", 1)]
    assert [r["base_path"] for r in engine.outline("guide.md").collect()] == ["Guide", "Guide > Retries", "Guide > Storage"]
    assert engine.read_section("guide.md") == GUIDE.rstrip("\n")
    assert engine.read_section("guide.md", "retries").startswith("## Retries")
    with pytest.raises(Ambiguous):
        engine.read_section("guide.md", "nowhere")
    page = engine.search("--max-retries")
    assert page.hits[0].heading_path == "Guide > Retries" and page.keyword_match == "matched"
    assert engine.search("where are files kept", limit=1).hits[0].heading_path == "Guide > Storage"
    assert engine.search("--no-such-flag").hits == [] and engine.search("  ").keyword_match == "no_terms"
    top = engine.search("--dry-run").hits[0]
    assert top.heading_path == "Flags" and top.excerpt is not None and "--dry-run" in "\n".join(top.content.split("\n")[slice(*top.excerpt)])
    assert all(h.file_path.startswith("a/") for h in engine.search("text words", scope="a").hits)
    assert engine.status(str(engine.root))["verdict"] == "complete"
    ids = {r["section_id"] for r in engine.sections().collect()}
    (engine.root / "guide.md").write_text(GUIDE + "\n## New\n\nAdded later.\n")
    (engine.root / "a" / "guide.md").unlink()
    assert engine.status(str(engine.root))["stale"] == 2
    report = engine.index_directory(str(engine.root))
    assert report.states == {"changed": 1, "unchanged": 1, "vanished": 1} and report.sections == 5 and report.generation == 2
    fresh = {r["section_id"] for r in engine.sections().filter("file_path = 'guide.md'").collect()}
    assert len(fresh) == 4 and not fresh & ids and engine.search("added later").hits[0].heading_path == "Guide > New"


def test_trust(engine, spark):
    """Vectors are taken over by text, revoked ones are refused and made anew, and status reads only what moved."""
    root = str(engine.root)
    (engine.root / "copy.md").write_text(GUIDE)
    report = engine.index_directory(root)
    assert report.states == {"new": 1, "unchanged": 3} and report.embedded == 0 and report.reused == 3
    assert engine.index_directory(root).states == {"unchanged": 4}
    engine.revoke("a test")
    with pytest.raises(ForeignWeights, match="a test"):
        engine.search("retries")
    assert engine.notices() == ["vectors revoked: a test"] and engine.notices() == []
    report = engine.index_directory(root)
    assert report.states == {"changed": 4} and report.reused == 0 and engine.search("retries").hits
    other = Engine(spark, engine.index.root, weights="others")
    with pytest.raises(ForeignWeights):
        other.search("retries")
    assert {r["state"] for r in engine.changes(root).collect()} == {"unchanged"}
    assert len(list((Path(engine.index.root)).glob("snapshot-*"))) == 2
    forced = engine.index_directory(root, force=True)
    assert forced.states == {"changed": 4} and forced.reused == 0 and forced.sections == 8


def test_failures_and_reasons(engine, monkeypatch):
    from lectern.sources import markdown

    root = engine.root
    (root / "big.md").write_bytes(b"x" * (10 * 1024 * 1024 + 1))
    (root / "notes.txt").write_text("x")
    (root / "venv").mkdir()
    (root / "venv" / "a.md").write_text("x")
    (root / "link.md").symlink_to(root / "guide.md")
    report = engine.index_directory(str(root), ["skip*"])
    assert report.states == {"unchanged": 3} and report.failed == 0
    why = lambda p: engine.why_not(str(root), p, ["skip*"])
    (root / "skipped.md").write_text("x")
    (root / "late.md").write_text("x")
    assert [why(p) for p in ("guide.md", "../x.md", "a\x00", "~root/x", "none.md", "a", "notes.txt", "venv/a.md", "skipped.md", "big.md", "link.md", "late.md")] == [
        "indexed", "outside the folder", "a path cannot hold a NUL character", "another user's home is not read", "no such file", "a folder", "not Markdown by its suffix", "in a folder that is never searched",
        "excluded by a pattern", "larger than 10 MB", "a second name of a file that is indexed", "not indexed yet",
    ]
    assert engine.document("./a/../guide.md") == "guide.md" and engine.document(str(root / "a" / "guide.md")) == "a/guide.md" and engine.document("guide.md", cwd="a") == "guide.md"
    # A folder that cannot be listed: what is below it stays, as its absence is no evidence.
    walked = markdown.walk(engine.spark, str(root))
    monkeypatch.setattr(markdown, "walk", lambda spark, r: markdown.Walk(walked.hidden, ["a"], walked.aliases))
    (root / "late.md").unlink()
    (root / "skipped.md").unlink()
    report = engine.index_directory(str(root))
    assert report.states == {"unchanged": 1, "vanished": 2} and {r["file_path"] for r in engine.list_documents().collect()} == {"guide.md", "a/flags.md", "a/guide.md"}
    assert engine.status(str(root))["verdict"] in ("unverified", "stale")


def test_lanes_that_fail(engine):
    """A lane that fails leaves the answer to the other one."""
    good = engine.embed
    engine.embed = lambda texts: texts.selectExpr("owner_id", "array(double(raise_error('no model'))) AS embedding")
    page = engine.search("retries fails")
    assert page.keyword_match == "matched" and page.hits[0].heading_path == "Guide > Retries"
    engine.embed, good_analyze = good, engine.analyze
    engine.analyze = lambda c: F.array(F.raise_error(F.lit("no analyzer")).cast("string"))
    page = engine.search("where are files kept")
    assert page.keyword_match == "unavailable" and page.hits and "meaning" in page.message
    engine.embed = lambda texts: texts.selectExpr("owner_id", "array(double(raise_error('no model'))) AS embedding")
    with pytest.raises(Exception, match="no "):
        engine.search("where are files kept")
    engine.embed, engine.analyze = good, good_analyze
    missed = engine.search("--no-such-flag")
    assert missed.abstained and missed.as_dict()["message"].startswith("No section in scope") and "preview" in engine.search("text words").as_dict()["results"][1]


def test_snapshots_are_checked_and_migrated(engine, spark):
    root, home = str(engine.root), Path(engine.index.root)
    before = engine.index.current()
    engine.embed = lambda texts: texts.selectExpr("owner_id", "CASE WHEN owner_id % 2 = 0 THEN array(1D, 0D) ELSE array(1D) END AS embedding")
    (engine.root / "more.md").write_text("# More\n\nOne.\n\nTwo.\n\nThree.\n\n## Again\n\nFour.\n\nFive.\n")
    with pytest.raises(Exception):
        engine.index_directory(root, force=True)
    assert engine.index.current() == before and len(list(home.glob("snapshot-*"))) == 1 and not (home / "_LOCK").exists()
    fresh = Engine(spark, engine.index.root)
    pointer = home / "_CURRENT"
    (home / "._CURRENT.crc").unlink(missing_ok=True)
    old = json.loads(pointer.read_text())
    pointer.write_text(json.dumps({k: v for k, v in old.items() if k not in ("weights", "history")} | {"schema": 6}))
    report = fresh.index_directory(root)
    assert report.states["new"] == 1 and fresh.index.current()["schema"] == 7 and any("schema 6 to 7" in n for n in fresh.notices())
    assert fresh.search("where are files kept").hits
    (home / "._CURRENT.crc").unlink(missing_ok=True)
    pointer.write_text(json.dumps(old | {"schema": 8}))
    with pytest.raises(NewerSchema):
        fresh.search("x")


def test_only_the_terms_row_groups_are_read(engine, spark):
    lexicon = keyword.Lexicon(engine.index.table("postings"), engine.index.table("lengths"))
    terms = keyword.term_table(spark.createDataFrame([(0, "retries")], "query_id int, query string"), analyze=engine.analyze)
    plan = keyword.occurrences(lexicon, terms)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and ("In(term" in plan or "EqualTo(term" in plan)
