import json
from datetime import UTC, datetime

import pytest

from lectern import config
from lectern.engine import Engine
from lectern.sources import scope, sinks
from lectern.streaming.catch_up import CatchUp, Due


def test_settings_order():
    found = config.resolved({"root": "/docs", "model": None}, {"LECTERN_ROOT": "/other", "LECTERN_MODEL": "big", "LECTERN_GIT": "Off", "LECTERN_EXCLUDE": "a/*, b\n c", "LECTERN_DUE_AFTER_WALK": "5"})
    assert (found.root, found.model, found.git, found.exclude, found.due_after_walk, found.due_after_change) == ("/docs", "big", False, ("a/*", "b", "c"), 5.0, 10.0)
    assert found.home.startswith("lectern-index/docs-") and found.home.endswith("-big") and found.home != config.resolved({"root": "/elsewhere/docs", "model": "big"}, {}).home
    for given, environment, match in (({}, {"LECTERN_ROOT": "${HOME}/docs"}, "never filled in"), ({}, {"LECTERN_GIT": "maybe"}, "neither"), ({"colour": "red"}, {}, "no such setting")):
        with pytest.raises(ValueError, match=match):
            config.resolved(given, environment)


def test_due():
    at = [0.0]
    due = Due(clock=lambda: at[0])
    assert due.now()
    due.ran()
    assert not due.now()
    due.saw_change()
    at[0] = 9
    due.saw_change()
    assert not due.now()
    at[0] = 10
    assert due.now()
    due.was_refused()
    at[0] = 39
    assert not due.now()
    at[0] = 40
    assert due.now()
    due.ran()
    at[0] = 339
    assert not due.now()
    at[0] = 340
    assert due.now()


def test_catching_up(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# A\n\ntext\n")
    engine = Engine(spark, str(tmp_path / "index"))
    up = CatchUp(engine, str(tmp_path / "docs"))
    assert up.touch() and not up.touch()
    up.wait(120)
    assert up.error is None and up.report.states == {"new": 1} and not up.touch()
    with scope.exclusive(spark, engine.index.root):
        up.due.walked = None
        assert up.touch()
        up.wait(120)
        assert up.due.refused is not None and engine.status(str(tmp_path / "docs"))["indexing"]
    with pytest.raises(InterruptedError):
        engine.index_directory(str(tmp_path / "docs"), force=True, stop=lambda: True)
    assert engine.index.current()["generation"] == 1


def test_trees():
    trees = scope.Trees("base", most=2)
    home = trees.add("/w/one")
    trees.add("/w/one/deep")
    assert trees.of("/w/one/deep/a.md")[0] == "/w/one/deep" and trees.of("/w/one/a.md") == ("/w/one", home) and trees.of("/x/a.md") is None
    assert trees.counterpart("/w/one/a/b.md", "/w/one/deep") == "/w/one/deep/a/b.md"
    trees.add("/w/two")
    assert len(trees.homes) == 2 and "/w/two" in trees.homes
    assert scope.inside("/a", "b/../c") and not scope.inside("/a", "../b") and scope.inside("/a", "/a") and not scope.inside("/a", "/ab")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é", None), (2, "b", 0.5)], "n int, a string, z double")
    sinks.write_json_lines(rows, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":"b","n":2,"z":0.5}', '{"a":"é","n":1,"z":null}']
    line = sinks.record("dev", {"top1": 0.5}, {"code": "c", "corpus": "d", "cases": "e"}, datetime(2026, 1, 1, tzinfo=UTC))
    assert json.loads(line)["identity"]["cases"] == "e" and line == sinks.record("dev", {"top1": 0.5}, {"cases": "e", "corpus": "d", "code": "c"}, datetime(2026, 1, 1, tzinfo=UTC))
    with pytest.raises(ValueError, match="cases, corpus"):
        sinks.record("dev", {}, {"code": "c"})


def test_bootstrap_spread(spark):
    """Draws are independent: the spread of the resampled mean is that of resampling by NumPy."""
    import numpy as np

    from lectern.operators.evaluate import bootstrap_ratio, upper_bound

    rng = np.random.default_rng(1)
    for n in (40, 150):
        values = rng.exponential(1.0, n)
        clusters = spark.createDataFrame([(i, float(v), 1) for i, v in enumerate(values)], "place long, top double, bottom int")
        found = bootstrap_ratio(clusters, 2000)
        ratios = np.array([r["ratio"] for r in found.collect()])
        plain = values[rng.integers(0, n, (20000, n))].mean(axis=1)
        assert abs(ratios.std() / plain.std() - 1) < 0.06 and abs(ratios.mean() - values.mean()) < 4 * plain.std() / 2000**0.5
        bound = upper_bound(found).first()
        assert bound["rounds"] == 2000 and bound["bound"] == np.sort(ratios)[int(0.95 * 2000) - 1]
