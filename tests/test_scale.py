"""Steps whose work must not grow faster than their tables, and results that no cap may shorten."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.markdown.document import passages
from lectern.operators import keyword as K
from lectern.operators import vector as N
from lectern.operators.evaluate import tail_column
from lectern.plans.registry import ORACLE_SQL, QUERIES


def test_alike_queries_and_sections_are_ranked_once(spark, sf, tmp_path, monkeypatch):
    part = spark.read.parquet(f"{sf}/part.parquet")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 10_000)).unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 20_000)).write.parquet(f"{tmp_path}/part.parquet")
    seen, plain = [], K.bm25

    def watched(lexicon, terms, *rest):
        seen.append((lexicon.lengths.count(), terms.select("query_id").distinct().count()))
        return plain(lexicon, terms, *rest)

    monkeypatch.setattr(K, "bm25", watched)
    found = QUERIES["bm25_fields"](spark, str(tmp_path))
    distinct = part.select("p_name", "p_brand", "p_type").distinct().count()
    assert seen and all(sections <= distinct and queries <= distinct for sections, queries in seen)
    three = spark.read.parquet(f"{tmp_path}/part.parquet")
    own = three.select(F.col("p_partkey").alias("section_id"), F.col("p_name").alias("heading_title"), F.col("p_type").alias("heading_path"), F.col("p_brand").alias("content"))
    asked = three.select(F.col("p_partkey").alias("query_id"), F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")).alias("term_id", "term")).withColumn("tokens", X.tokens(F.col("term"))).withColumn("identifier", F.lit(True))
    wanted = K.with_ties(plain(K.Lexicon.of(own), asked), 5).select("query_id", "section_id", "score")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_no_passage_is_dropped():
    assert [p.text for p in passages("\n".join(f"- item {i}" for i in range(200)))] == [f"item {i}" for i in range(200)]


@pytest.fixture(scope="module")
def long_sections(spark, tmp_path_factory):
    """Sections of 150 list items for each nation: beyond the kernel's parts."""
    folder = str(tmp_path_factory.mktemp("long"))
    for name in ("region", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    spark.range(25 * 150).selectExpr("id AS s_suppkey", "format_string('Supplier#%09d', id) AS s_name", "CAST(id % 25 AS INT) AS s_nationkey", "CAST(id AS DOUBLE) / 4 AS s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    return folder


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = QUERIES[name](spark, folder)
    told = con.sql(ORACLE_SQL[name])
    columns = ", ".join(f'"{c}"' for c in found.columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(told.project(columns).fetchall(), key=repr)


def test_long_sections_are_whole(spark, long_sections):
    same_as_sql(spark, long_sections, "markdown_ingest", ("region", "nation", "supplier"))


def test_fingerprints_are_of_whole_sections(spark, long_sections):
    same_as_sql(spark, long_sections, "parse_fingerprint", ("region", "nation", "supplier"))


def test_tails_of_many_outcomes(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (0, 9), (9, 0), (5, 5), (4, 7), (7, 4), (30_000, 30_000), (29_800, 30_150), (30_150, 29_800), (10, 40_000), (40_000, 10)]
    rows = spark.createDataFrame(pairs, "w int, l int")
    for two in (True, False):
        found = rows.select("w", "l", tail_column(F.col("w"), F.col("l"), two).alias("p")).collect()
        for w, losses, p in found:
            assert math.isclose(p, exact_tail(w, losses, two), abs_tol=1e-10), (w, losses, two)


def exact_tail(wins, losses, two):
    n, (lo, hi) = wins + losses, (0, min(wins, losses)) if two else (wins, wins + losses)
    term = math.comb(n, lo)
    total = term
    for k in range(lo, hi):
        term = term * (n - k) // (k + 1)
        total += term
    return 1.0 if n == 0 else min(1.0, (2 if two else 1) * (total * 10**18 // 2**n) / 1e18)


def test_millions_of_outcomes(spark):
    """The old column took steps as the square of the wins : 10^12 of them here."""
    n = 2_000_000
    row = spark.createDataFrame([(n // 2, n // 2)], "w int, l int")
    two, one = row.select(tail_column(F.col("w"), F.col("l"), True), tail_column(F.col("w"), F.col("l"), False)).first()
    assert two == 1.0 and math.isclose(one, 0.5 + 0.5 / math.sqrt(math.pi * n / 2) * (1 - 1 / (4 * n)), abs_tol=1e-10)


def test_nearest_measures_some_queries_at_a_time(spark, sf, monkeypatch):
    own = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("owner_id"), "embedding").filter("owner_id < 60")
    own = own.unionByName(own.withColumn("owner_id", F.col("owner_id") + 1000)).coalesce(1)  # ties everywhere
    asked = own.withColumnRenamed("owner_id", "query_id")
    monkeypatch.setattr(N, "MOST_MEASURED", 500)
    found = N.nearest(own, asked, 3)
    rows = {r["owner_id"]: np.array(r["embedding"], float) for r in own.collect()}
    wanted = set()
    for q, a in rows.items():
        distances = {o: round(1 - float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b)), 6) + 0.0 for o, b in rows.items()}
        worst = sorted(distances.values())[2]
        wanted |= {(q, o) for o, d in distances.items() if d <= worst}
    assert {(r["query_id"], r["owner_id"]) for r in found.collect()} == wanted


@pytest.mark.parametrize("name", ["bm25_topk", "scoped_bm25", "idf_gate"])
def test_keyword_queries_make_no_vectors(spark, sf, name, monkeypatch):
    def none(*_):
        raise AssertionError("vectors are not asked for")

    monkeypatch.setattr(N, "hashed_embeddings", none)
    assert QUERIES[name](spark, f"{sf}/../{sf.rsplit('/', 1)[1]}").columns  # a folder without an index so far


def test_postings_are_not_shuffled(spark):
    rows = spark.createDataFrame([("b", 1, "content", 0), ("a", 2, "content", 0)], "term string, section_id long, field string, position int")
    assert "Exchange" not in K.stored_order(rows)._jdf.queryExecution().executedPlan().toString()


def test_probe_is_the_same_by_few_distances_at_a_time(spark, sf, monkeypatch):
    whole = sorted(map(tuple, QUERIES["self_probe"](spark, sf).collect()))
    monkeypatch.setattr(N, "MOST_MEASURED", 300)
    assert whole and sorted(map(tuple, QUERIES["self_probe"](spark, sf).collect())) == whole


def test_postings_are_sorted_in_as_many_tasks_as_they_fill(spark, sf, monkeypatch):
    from lectern.plans import corpus

    monkeypatch.setattr(corpus, "SORTED", 10_000)
    found = corpus.lexicon(spark, f"{sf}/../../testdata/{sf.rsplit('/', 1)[1]}").postings
    assert len(found.inputFiles()) > found.count() // 20_000
