"""Queries against their SQL, and the pipeline against plain versions of its stages."""

import duckdb
import pytest

import corpus_pipeline
from lectern.llm import queries

from . import brute


def table_views(sf):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    found = queries.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    relation = table_views(sf).sql(queries.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    key = lambda rows: sorted(rows, key=repr)
    clean = lambda rows: key([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows])
    assert clean(map(tuple, found.select(*columns).collect())) == clean(relation.project(", ".join(columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf, name):
    found = queries.QUERIES[name](spark, sf)
    n, docs = found.count(), spark.read.parquet(f"{sf}/documents.parquet").count()
    assert n <= docs if name == "op9_contamination" else n == docs


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 3000}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids & texts.keys() == {d for d, t in texts.items() if brute.repetition(t)[6]}
    near = corpus_pipeline.near_dedup(spark, kept, sf)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert near.columns == columns and sorted(r["doc_id"] for r in near.collect()) == [d for d, _, _, k in brute.near_dedup(rows, 80) if k]
    clean = corpus_pipeline.decontamination(spark, near, sf)
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r["doc_id"]: " ".join(r["text"].split()) for r in clean.collect()}
    assert clean.columns == columns and not [d for d, t in left.items() if any(i in t for i in items)]
    lost = {r["doc_id"]: " ".join(r["text"].split()) for r in near.collect() if r["doc_id"] not in left}
    assert all(any(" ".join(i.split()[1:9]) in t for i in items) for t in lost.values())
    mixed = corpus_pipeline.mixing(spark, clean, sf)
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= left.keys()
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3


def test_pipeline_null_ids(spark, sf):
    """A document without an id is deduplicated and decontaminated like others."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    copy = " ".join(f"w{i}" for i in range(60))
    own = [(None, f"so {item} it is", None, None, 1), (1, copy, None, None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert [r["doc_id"] for r in corpus_pipeline.decontamination(spark, spark.createDataFrame(own, schema), sf).collect()] == [1]
    near = spark.createDataFrame([(None, copy, None, None, 1), (2, copy + " more", None, None, 1), (3, "else", None, None, 1)], schema)
    assert sorted(map(str, (r["doc_id"] for r in corpus_pipeline.near_dedup(spark, near, sf).collect()))) == ["3", "None"]


def test_pipeline_crowded_family(spark, sf):
    """2,000 pairs of similarity 0.806 in one family of pages of 0.70: buckets of more than a million pairs lose none of them."""
    template = " ".join(f"t{i}" for i in range(104))
    own = [(i, " ".join([template, *(f"p{i // 2}x{k}" for k in range(8)), *(f"o{i}x{k}" for k in range(13))])) for i in range(4000)]
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in own], "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert left == set(range(0, 4000, 2)), (len(left), sorted(left ^ set(range(0, 4000, 2)))[:10])


def test_pipeline_near_dedup_shared_ids(spark, sf):
    """What is like different texts of one id goes with it: all are one group, of which the smallest id stays."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abc"}
    own = [(5, text["a"]), (5, text["b"]), (3, text["a"]), (4, text["b"]), (6, text["c"]), (6, None), (7, text["c"] + " x"), (7, "")]
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in own], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [3, 6, 6]


def test_pipeline_runs(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() > 0
