"""Queries on keeping an index true: manifests, purges, provenance, integrity, over documents and a changed copy of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import incremental as I
from lectern.plans.corpus import PASSAGES_SQL, passages, table
from lectern.plans.registering import area

QUERIES, ORACLE_SQL, query = area()

_OLD = "old AS (SELECT lang || '/doc-' || doc_id AS file_path, sha256(text) AS content_hash, 2 AS vector_format, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'r1' END AS weights_revision, doc_id AS mtime_ns, doc_id FROM documents WHERE doc_id % 10 <> 1)"
_NEW = "new AS (SELECT lang || '/doc-' || doc_id AS file_path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS content_hash, 2 AS vector_format, CASE WHEN doc_id % 10 = 3 THEN 'r2' WHEN doc_id % 10 = 4 THEN NULL ELSE 'r1' END AS weights_revision, CASE WHEN doc_id % 10 = 5 THEN doc_id + 1 ELSE doc_id END AS mtime_ns, doc_id FROM documents WHERE doc_id % 10 <> 6)"


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("/doc-"), F.col("doc_id").cast("string")).alias("file_path"), "text")
    rest = F.col("doc_id") % 10
    old = docs.filter(rest != 1).select("file_path", F.sha2("text", 256).alias("content_hash"), F.lit(2).alias("vector_format"), F.when(F.col("doc_id") % 7 != 0, "r1").alias("weights_revision"), F.col("doc_id").alias("mtime_ns"), "doc_id")
    new = docs.filter(rest != 6).select("file_path", F.sha2(F.when(rest == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"), F.lit(2).alias("vector_format"), F.when(rest == 3, "r2").when(rest != 4, "r1").alias("weights_revision"), F.when(rest == 5, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("mtime_ns"), "doc_id")
    return old, new


@query(f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'vanished'
WHEN o.content_hash = n.content_hash AND o.vector_format = n.vector_format AND (n.weights_revision IS NULL OR o.weights_revision IS NOT DISTINCT FROM n.weights_revision) THEN CASE WHEN o.mtime_ns = n.mtime_ns THEN 'unchanged' ELSE 'touched' END ELSE 'changed' END AS state FROM old o FULL JOIN new n ON o.file_path = n.file_path""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.manifest_diff(*manifests(spark, sf_dir))


@query(f"WITH {_OLD}, {_NEW} SELECT file_path FROM old WHERE file_path NOT IN (SELECT file_path FROM new) AND NOT starts_with(file_path, 'de/')")
def purge_vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = manifests(spark, sf_dir)
    return I.purged(old, new, ["de"]).select("file_path")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' (moved)' ELSE c_name END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0")
def upsert_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return I.upserted(own.filter("key % 2 = 0"), own.filter("key % 5 = 0").withColumn("value", F.concat("value", F.lit(" (moved)"))), "key")


@query(f"WITH p AS ({PASSAGES_SQL}), first AS (SELECT content, min(section_id) AS vector_of FROM p WHERE section_id % 2 = 0 GROUP BY content) SELECT p.section_id, p.ordinal, first.vector_of FROM p LEFT JOIN first ON p.content = first.content WHERE p.section_id % 2 = 1")
def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = passages(spark, sf_dir)
    known = own.filter("section_id % 2 = 0").select(F.col("content").alias("text"), F.col("section_id").alias("embedding"), F.col("section_id").alias("source_id"))
    asked = own.filter("section_id % 2 = 1").select("section_id", "ordinal", F.col("content").alias("text"))
    return I.reused(asked, known).select("section_id", "ordinal", F.col("embedding").alias("vector_of"))


@query(f"WITH {_OLD} SELECT doc_id, file_path FROM old WHERE weights_revision IS DISTINCT FROM 'r1' AND doc_id IN (SELECT vec_id FROM embeddings)")
def provenance_certify(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = manifests(spark, sf_dir)
    return I.certifiable(old, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "r1").select("doc_id", "file_path")


@query("""SELECT 'section without document' AS problem, l_orderkey AS id FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'passage without section', doc_id FROM labels WHERE doc_id NOT IN (SELECT DISTINCT l_orderkey FROM lineitem)
UNION ALL SELECT 'section without vector', doc_id FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'vector without passages', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    sections = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("section_id")).distinct()
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("section_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("section_id"), "embedding")
    return I.integrity_problems(documents, sections, own, vectors, 64)


@query(f"""WITH {_OLD}, {_NEW}, s AS (SELECT count(*) AS indexed, (SELECT count(*) FROM labels WHERE quality = 0 AND toxic = 1) AS failed, (SELECT count(*) FROM old o JOIN new n USING (file_path) WHERE o.content_hash <> n.content_hash) AS stale FROM old)
SELECT indexed, failed, stale, CASE WHEN indexed = 0 THEN 'empty' WHEN failed > 0 THEN 'failures' WHEN stale > 0 THEN 'stale' ELSE 'unverified' END AS verdict FROM s""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = manifests(spark, sf_dir)
    stale = old.alias("o").join(new.alias("n"), "file_path").filter("o.content_hash <> n.content_hash").agg(F.count("*").alias("stale"))
    failed = table(spark, sf_dir, "labels").agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("failed"))
    one = old.agg(F.count("*").alias("indexed")).crossJoin(failed).crossJoin(stale)  # single rows
    return one.select("indexed", "failed", "stale", I.verdict(F.col("indexed"), F.col("failed"), F.col("stale"), F.lit(False)).alias("verdict"))


@query("SELECT c_custkey, (1000 + row_number() OVER (ORDER BY c_nationkey, c_custkey))::BIGINT AS section_id FROM customer")
def new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return I.numbered(own, [F.col("c_nationkey"), F.col("c_custkey")], 1000).select("c_custkey", "section_id")


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(o.file_path, n.file_path) AS path, CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'lost' ELSE 'changed' END AS state FROM old o FULL JOIN new n ON o.file_path = n.file_path WHERE o.content_hash IS DISTINCT FROM n.content_hash")
def parser_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = manifests(spark, sf_dir)
    pair = old.select(F.col("file_path").alias("path"), F.col("content_hash").alias("a")).join(new.select(F.col("file_path").alias("path"), F.col("content_hash").alias("b")), "path", "full_outer")
    return pair.filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "lost").otherwise("changed").alias("state"))


@query("""WITH f AS (SELECT DISTINCT lang AS root FROM documents UNION SELECT DISTINCT lang || '/' || source FROM documents UNION SELECT 'e') SELECT a.root, b.root AS other FROM f a JOIN f b ON starts_with(a.root || '/', b.root || '/') OR starts_with(b.root || '/', a.root || '/')""")
def related_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which folders are above, below or the same as others: a folder is joined with those on its own path."""
    docs = table(spark, sf_dir, "documents")
    roots = docs.select(F.col("lang").alias("root")).union(docs.select(F.concat_ws("/", "lang", "source"))).union(spark.sql("SELECT 'e'")).distinct()
    parts = F.split("root", "/")
    above = roots.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("other")).join(roots.withColumnRenamed("root", "other"), "other", "left_semi").select("root", "other")
    both = above.union(above.select(F.col("other"), F.col("root"))).distinct()
    return both.filter(X.is_related(F.col("root"), F.col("other")))


@query("""WITH old AS (SELECT doc_id, lang || '/d' || doc_id AS file_path, 'failed' AS message FROM documents WHERE doc_id % 3 = 0), now AS (SELECT lang || '/d' || doc_id AS file_path, 'failed again' AS message FROM documents WHERE doc_id % 5 = 0)
SELECT file_path, message FROM now UNION ALL SELECT file_path, message FROM old WHERE starts_with(file_path, 'de/') AND file_path NOT IN (SELECT file_path FROM now)""")
def failure_bookkeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures after a run that could not read de/: those it met, and of the others only what it could not reach."""
    path = F.concat(F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string")).alias("file_path")
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 3 = 0").select(path, F.lit("failed").alias("message"))
    return I.restated(old, docs.filter("doc_id % 5 = 0").select(path, F.lit("failed again").alias("message")), ["de"])


@query("""WITH d AS (SELECT doc_id, n_chars AS mtime, lang FROM documents), w AS (SELECT doc_id, n_chars + (doc_id % 7 = 0)::INT AS seen, n_chars + 100 AS mtime FROM documents WHERE doc_id % 2 = 0)
SELECT d.doc_id, CASE WHEN w.seen = d.mtime THEN w.mtime ELSE d.mtime END AS mtime, coalesce(w.seen = d.mtime, false) AS swapped FROM d LEFT JOIN w ON w.doc_id = d.doc_id""")
def compare_and_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that are set only where they are still what the writer saw."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("mtime"))
    changes = docs.filter("doc_id % 2 = 0").select("doc_id", (F.col("mtime") + (F.col("doc_id") % 7 == 0).cast("int")).alias("seen"), (F.col("mtime") + 100).alias("mtime"))
    return I.swapped(docs, changes, "doc_id", "mtime")


@query("""WITH o AS (SELECT doc_id, n_chars AS length, doc_id * 3 AS mtime, text FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN n_chars + 1 ELSE n_chars END AS length, CASE WHEN doc_id % 4 = 0 THEN doc_id * 3 + 1 ELSE doc_id * 3 END AS mtime, CASE WHEN doc_id % 8 = 0 THEN 'new' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'vanished' WHEN o.length = n.length AND o.mtime = n.mtime THEN 'same' WHEN sha256(coalesce(o.text, '')) = sha256(coalesce(n.text, '')) THEN 'touched' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by time and length first; only those that moved are digested."""
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    old = docs.filter("doc_id % 11 <> 0").select("doc_id", F.col("n_chars").alias("length"), (F.col("doc_id") * 3).alias("mtime"), digest.alias("digest"))
    new = docs.filter("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("length"), (F.col("doc_id") * 3 + (F.col("doc_id") % 4 == 0).cast("int")).alias("mtime"), F.when(F.col("doc_id") % 8 == 0, "new").otherwise(F.col("text")).alias("text"))
    return I.freshness(old, new, "doc_id", digest)


@query("""WITH s AS (SELECT doc_id, lang, source FROM documents), v AS (SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND source <> 'src0'), w AS (SELECT lang, count(v.doc_id) AS vectors, count(*) FILTER (WHERE s.doc_id % 10 = 0 AND v.doc_id IS NOT NULL) AS foreign_ones FROM s LEFT JOIN v ON v.doc_id = s.doc_id GROUP BY lang)
SELECT lang, CASE WHEN vectors = 0 THEN 'forgotten' WHEN foreign_ones > 0 THEN 'revoked' ELSE 'certified' END AS weights FROM w""")
def weights_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the vectors of each language may be trusted: all of one model, some of another, or there are none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(F.col("doc_id") % 10 == 0, "old").otherwise("m").alias("weights_revision"))
    vectors = docs.filter("doc_id % 3 > 0 AND source <> 'src0'").select("doc_id")
    return I.weights_state(docs, vectors, "m", "lang")
