"""The keyword lane against SQLite's own full-text index, and the literal pairs of its smaller parts."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import vectors as V
from lectern.functions.stem import stem, stemmed
from lectern.operators import keyword as K
from lectern.operators import vector as N
from lectern.operators.evaluate import binomial_tail, tail_column


def test_bm25_agrees_with_sqlite(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(1, n)))
    rows = [(i, text(4), text(5), text(40)) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, c, tokenize = 'unicode61')")
    con.executemany("INSERT INTO t(rowid, a, b, c) VALUES (?, ?, ?, ?)", rows)
    asked = [(q, [rng.choice(words) if rng.random() < 0.7 else f"{rng.choice(words)} {rng.choice(words)}" for _ in range(3)]) for q in range(12)]
    asked = [(q, list(dict.fromkeys(terms))) for q, terms in asked]
    sections = spark.createDataFrame(rows, "section_id long, heading_title string, heading_path string, content string")
    terms = spark.createDataFrame([(q, i, t, t.split(), False) for q, own in asked for i, t in enumerate(own)], "query_id long, term_id int, term string, tokens array<string>, identifier boolean")
    found = {(r["query_id"], r["section_id"]): r["score"] for r in K.bm25(K.Lexicon.of(sections), terms).collect()}
    expected = {}
    for q, own in asked:
        match = " OR ".join(f'"{t}"' for t in own)
        for rowid, rank in con.execute("SELECT rowid, bm25(t, 5.0, 3.0, 1.0) FROM t WHERE t MATCH ?", (match,)):
            expected[q, rowid] = -rank
    assert found.keys() == expected.keys() and all(math.isclose(found[k], expected[k], abs_tol=2e-6) for k in expected)


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("how do I install it", ["install"]), ("where is the WHERE clause", ["WHERE", "clause"]), ("to be or not", ["to", "be", "or", "not"]), ("--all -i", ["--all", "-i"]), ("all() of rate(x[5m])", ["all()", "rate()"]),
        ("flag(s) Flag FLAG", ["flag(s)", "Flag"]), ("?! ...", []), ("APP_DB_PATH.", ["APP_DB_PATH."]), ("rate(x[5m]))", ["rate(x[5m]))"]),
    ],
)
def test_query_terms(spark, query, expected):
    assert spark.createDataFrame([(query,)], "q string").select(X.query_terms(F.col("q"))).first()[0] == expected


def test_identifiers(spark):
    yes = ["--flag", "-i", "a_b", "a.b", "HTTP", "camelCase", "v2x", "rate()", "`--x`", "C:\\x", "@Before", "a/b"]
    no = ["word", "Word", "end.", "A", "plain-dash", "x1"]
    found = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", X.is_identifier(F.col("t")).alias("x")).collect()}
    assert [t for t in yes if not found[t]] == [] and [t for t in no if found[t]] == []


def test_literals(spark):
    cases = [("--pre", "use --pre-glob", False), ("--pre", "use --pre now", True), ("a.b", "see a.b.", True), ("a.b", "see a.b.c", False), ("name", "the_name", False)]
    for name, text, expected in cases:
        assert spark.range(1).select(F.regexp_like(F.lit(text), F.lit(X.literal_pattern(name)))).first()[0] is expected
    call = X.literal_pattern("rate", call=True)
    assert spark.range(1).select(F.regexp_like(F.lit("rate (x)"), F.lit(call))).first()[0] and not spark.range(1).select(F.regexp_like(F.lit("rates(x)"), F.lit(call))).first()[0]


def test_walk_order(spark):
    paths = ["b.md", "a.md", "z/a.md", ".hid/x.md", "c/d/e.md", "c/a.md"]
    found = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").orderBy(X.walk_key(F.col("p"))).collect()]
    assert found == ["a.md", "b.md", "c/a.md", "c/d/e.md", "z/a.md", ".hid/x.md"]


def test_fusion_and_ties(spark):
    ranks = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 20, 1), (1, 30, 2)], "query_id long, item long, position int")
    assert {r["item"]: r["score"] for r in N.fuse(ranks).collect()} == {10: round(1 / 61, 9), 20: round(1 / 62 + 1 / 61, 9), 30: round(1 / 62, 9)}
    scored = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate([5, 4, 4, 4, 1])], "query_id long, section_id long, score double")
    assert K.with_ties(scored, 2).count() == 4


def test_pooling_falls_back(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 0, [3.0, 4.0])]
    found = {r["owner_id"]: r["embedding"] for r in N.pooled(spark.createDataFrame(rows, "owner_id long, ordinal int, embedding array<float>")).collect()}
    assert found == {1: [1.0, 0.0], 2: [0.6, 0.8]}


def test_embedding_without_words(spark):
    found = {r["owner_id"]: r["embedding"] for r in N.hashed_embeddings(spark.createDataFrame([(1, "a a"), (2, ""), (3, None)], "owner_id long, text string"), 8).collect()}
    assert found[2] == found[3] == [1.0] + [0.0] * 7 and sum(found[1]) == 1.0
    assert spark.range(1).select(V.usable(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] is False


def test_exact_tests(spark):
    for wins, losses in ((0, 0), (3, 1), (10, 2), (7, 7), (0, 5)):
        for two in (True, False):
            found = spark.createDataFrame([(wins, losses)], "w int, l int").select(tail_column(F.col("w"), F.col("l"), two)).first()[0]
            assert math.isclose(found, binomial_tail(wins, losses, two), abs_tol=1e-9)


def test_scores_read_no_more_than_they_need(spark, tmp_path):
    """Filters and columns reach the scan, and no Python stands in a ranking plan."""
    spark.createDataFrame([(1, "a/b.md", "t", "p", "text", 1, 0)], "section_id long, file_path string, heading_title string, heading_path string, content string, start_line int, part_index int").write.parquet(str(tmp_path / "s"))
    own = spark.read.parquet(str(tmp_path / "s"))
    plan = own.filter(F.col("file_path").startswith("a/")).select("section_id")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan and "content" not in plan
    terms = K.term_table(spark.createDataFrame([(1, "text")], "query_id long, query string"))
    ranked = K.with_ties(K.bm25(K.Lexicon.of(own), terms), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in ranked and "Python" not in ranked and "Pandas" not in ranked


def test_stems_agree_with_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    rng = random.Random(9)
    parts = ["ation", "al", "iz", "e", "ing", "ed", "s", "ness", "ful", "ous", "iv", "y", "b", "l", "t", "ll", "ee", "o", "able", "ion", "h", "is", "ti"]
    words = {"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(3000)} | {"relational", "hopping", "falling", "happy", "sky", "agreed", "feed", "cease", "roll", "controlling"}
    for word in words:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (word,))
        assert con.execute("SELECT term FROM v").fetchone()[0] == stem(word)


def test_stemmed_lane(spark):
    own = spark.createDataFrame([(1, "", "", "retrying requests"), (2, "", "", "other words")], "section_id long, heading_title string, heading_path string, content string")
    terms = K.term_table(spark.createDataFrame([(0, "retry request")], "query_id long, query string"), analyze=stemmed)
    assert {r["section_id"] for r in K.bm25(K.Lexicon.of(own, analyze=stemmed), terms).collect()} == {1} and K.bm25(K.Lexicon.of(own), K.term_table(spark.createDataFrame([(0, "retry")], "query_id long, query string"))).count() == 0


def test_case_folding(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁne ﬂow", "ſet", "ẞ", "Éa", "plain"]
    found = [r[0] for r in spark.createDataFrame(list(enumerate(words)), "i int, t string").orderBy("i").select(X.casefolded(F.col("t"))).collect()]
    assert found == [w.casefold() for w in words]


def test_excerpt_vectors():
    from lectern.operators.literal import excerpt

    text = "# T\n\n" + "\n\n".join(f"para{i} word" for i in range(6))
    lines = lambda k: excerpt(text, [f"para{k}"], False, k, "# T")
    assert lines(2) == (4, 13) and lines(0) == (2, 9) and lines(4) == (8, 13)
    assert excerpt(text, ["para2"], False, 2, "# T", stored=["other"]) is None and excerpt(text, ["T"], False, 2, "# T") is None
    assert excerpt("# T\n\na\n\nb\n\nc", ["a"], False, 0, "# T") is None
