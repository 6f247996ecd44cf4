"""Queries for reports: samples, graders, drift, payloads, validation, replays and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import token_estimate
from lectern.operators import evaluate as E
from lectern.operators import usage as U
from lectern.operators.incremental import placed
from lectern.plans.corpus import table
from lectern.plans.registering import area

QUERIES, ORACLE_SQL, query = area()


_SCALE = "['none', 'low', 'fair', 'good']"


@query(f"""WITH g AS (SELECT doc_id, {_SCALE}[quality * 2 + toxic + 1] AS a, {_SCALE}[(doc_id % 4) + 1] AS b, CASE WHEN doc_id % 6 = 0 THEN 'fair' END AS key FROM labels)
SELECT doc_id, CASE WHEN a = b THEN a WHEN key IS NOT NULL THEN key WHEN list_position({_SCALE}, a) <= list_position({_SCALE}, b) THEN a ELSE b END AS grade, a <> b AS disagreed FROM g""")
def merge_graders(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = ["none", "low", "fair", "good"]
    at = lambda n: F.element_at(F.array(*map(F.lit, scale)), n.cast("int"))
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), at(F.col("quality") * 2 + F.col("toxic") + 1).alias("a"), at(F.col("doc_id") % 4 + 1).alias("b"), F.when(F.col("doc_id") % 6 == 0, "fair").alias("key"))
    return E.merged_grades(own, scale).withColumnRenamed("item", "doc_id")


@query("WITH s AS (SELECT c_custkey AS task, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || ':7'), c_custkey) AS position FROM customer) SELECT task, position, CASE WHEN position % 2 = 1 THEN 'with,without' ELSE 'without,with' END AS arms FROM s")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks in a seeded order, with the order of the two arms alternating."""
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(":7"))).alias("digest"))
    shuffled = placed(tasks, [F.col("digest"), F.col("task")], "place").select("task", (F.col("place") + 1).alias("position"))
    return shuffled.withColumn("arms", F.when(F.col("position") % 2 == 1, "with,without").otherwise("without,with"))


@query("""WITH c AS (SELECT user_id AS session, event_type AS kind, event_id AS idx FROM events)
SELECT session, bool_or(kind = 'view') AS searched, coalesce(min(idx) FILTER (WHERE kind = 'view') < coalesce(min(idx) FILTER (WHERE kind = 'purchase'), 9223372036854775807), false) AS before_reading FROM c GROUP BY session""")
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "purchase", "file").otherwise("other")
    return U.adopted(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), kind.alias("kind")))


@query("""WITH p AS (SELECT lang, CASE WHEN n_chars = 0 THEN 0 ELSE greatest(1, ceil(n_chars / 4.0)) END AS payload, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(split_part(text, chr(10), 1)) / 4.0)) END AS answer FROM documents WHERE length(split_part(text, chr(10), 1)) > 0)
SELECT lang, round(median(payload / answer), 6) AS median_ratio, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY payload / answer), 6) AS p95_ratio, sum(payload)::BIGINT AS total FROM p GROUP BY lang""")
def payload_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of a whole document over those of its first line."""
    line = F.split("text", "\n")[0]
    return E.payload_ratios(table(spark, sf_dir, "documents").filter(F.length(line) > 0).select("lang", token_estimate(F.col("text")).alias("payload"), token_estimate(line).alias("answer")), "lang")


@query("SELECT lang || '/' || source AS directory, count(*)::BIGINT AS stale FROM documents WHERE doc_id % 9 = 0 GROUP BY ALL ORDER BY directory LIMIT 3")
def stale_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three directories that hold stale documents."""
    own = table(spark, sf_dir, "documents").filter("doc_id % 9 = 0").groupBy(F.concat_ws("/", "lang", "source").alias("directory")).agg(F.count("*").alias("stale"))
    return own.orderBy("directory").limit(3)


@query("""WITH o AS (SELECT doc_id AS item, quality AS a FROM labels WHERE doc_id % 5 <> 0), n AS (SELECT doc_id AS item, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS b FROM labels WHERE doc_id % 7 <> 0)
SELECT coalesce(o.item, n.item) AS item, CASE WHEN o.item IS NULL THEN 'added' WHEN n.item IS NULL THEN 'missing' ELSE 'changed' END AS drift FROM o FULL JOIN n ON o.item = n.item WHERE a IS DISTINCT FROM b""")
def denominator_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    old = labels.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("item"), F.col("quality").alias("value"))
    return E.drift(old, labels.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("value")))


@query("""WITH r AS (SELECT o_orderkey - (o_orderkey % 50 = 1)::INT AS key, o_custkey % 23 AS rank, o_orderstatus AS state, o_totalprice / 500000 AS ndcg FROM orders), e AS (SELECT key, unnest([CASE WHEN rank NOT BETWEEN 1 AND 20 THEN 'rank out of 1..20' END, CASE WHEN ndcg > 1 OR ndcg < 0 THEN 'ndcg out of 0..1' END, CASE WHEN state NOT IN ('O', 'F') THEN 'unknown state' END]) AS error FROM r), n AS (SELECT state, count(*) AS n FROM r GROUP BY state)
SELECT key, error FROM e WHERE error IS NOT NULL UNION ALL SELECT key, 'key used twice' FROM r GROUP BY key HAVING count(*) > 1
UNION ALL SELECT NULL, 'stratum ' || coalesce(n.state, w.state) || ' has ' || coalesce(n, 0) || ' of ' || coalesce(wanted, 0) FROM n FULL JOIN (VALUES ('O', 5), ('X', 1)) w(state, wanted) ON n.state = w.state WHERE n IS DISTINCT FROM wanted""")
def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that break a constraint, use a key twice, or whose strata are of other sizes than they must be."""
    own = table(spark, sf_dir, "orders").select((F.col("o_orderkey") - (F.col("o_orderkey") % 50 == 1).cast("int")).alias("key"), (F.col("o_custkey") % 23).alias("rank"), F.col("o_orderstatus").alias("state"), (F.col("o_totalprice") / 500000).alias("ndcg"))
    rules = {"rank out of 1..20": F.col("rank").between(1, 20), "ndcg out of 0..1": F.col("ndcg").between(0, 1), "unknown state": F.col("state").isin("O", "F")}
    return E.record_errors(own, rules, "state", {"O": 5, "X": 1})


@query("SELECT p_brand AS query, '{\"hits\":[' || string_agg(p_partkey::VARCHAR, ',' ORDER BY p_retailprice DESC, p_partkey) || '],\"query\":\"' || p_brand || '\"}' AS line FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS i FROM part) WHERE i <= 5 GROUP BY p_brand")
def ranking_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking as one line of JSON with sorted names."""
    order = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    own = table(spark, sf_dir, "part").withColumn("i", F.row_number().over(order)).filter("i <= 5")
    hits = F.transform(F.sort_array(F.collect_list(F.struct("i", "p_partkey"))), lambda s: s["p_partkey"])
    return own.groupBy("p_brand").agg(hits.alias("hits")).select(F.col("p_brand").alias("query"), F.to_json(F.struct("hits", F.col("p_brand").alias("query"))).alias("line"))


@query("""WITH c AS (SELECT user_id, event_id, event_type, 'doc' || event_id % 7 || '.md' AS f, value > 90 AS failed FROM events),
k AS (SELECT *, CASE event_type WHEN 'view' THEN 'index' WHEN 'click' THEN 'file' WHEN 'purchase' THEN 'edit' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'shell' ELSE 'none' END ELSE 'none' END AS access FROM c),
l AS (SELECT * FROM k WHERE access <> 'file' OR NOT EXISTS (SELECT 1 FROM k e WHERE e.access = 'edit' AND e.user_id = k.user_id AND e.f = k.f))
SELECT access, count(*)::BIGINT AS n, (count(*) FILTER (WHERE failed))::BIGINT AS failed, round(count(*) / (SELECT count(*) FROM l), 6) AS share FROM l GROUP BY access""")
def access_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How documentation was reached, by tools and their arguments; files that a session edits are not read by it."""
    file = F.concat(F.lit("doc"), (F.col("event_id") % 7).cast("string"), F.lit(".md"))
    tool = F.when(F.col("event_type") == "view", "mcp__docs__search").when(F.col("event_type") == "click", "Read").when(F.col("event_type") == "purchase", "Edit").when(F.col("event_type") == "error", "Bash").otherwise("Task")
    argument = F.when(tool == "Bash", F.concat(F.when(F.col("event_id") % 2 == 0, "cd x && grep -n y ").otherwise("rm "), file)).otherwise(file)
    return U.access_report(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), tool.alias("tool"), argument.alias("argument"), (F.col("value") > 90).alias("failed")))


@query("WITH q AS (SELECT DISTINCT event_type AS text FROM events), s AS (SELECT p_type AS text, count(*)::BIGINT AS stored FROM part GROUP BY ALL UNION ALL SELECT 'view', 0) SELECT q.text, s.stored, s.text IS NULL AS missing FROM q LEFT JOIN s ON q.text = s.text")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers of the same text, and which texts have none."""
    stored = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("text")).agg(F.count("*").alias("stored")).unionByName(spark.sql("SELECT 'view' AS text, 0L AS stored"))
    return E.replayed(table(spark, sf_dir, "events").select(F.col("event_type").alias("text")), stored)


@query("WITH a AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 25 = 0), d AS (SELECT a.vec_id, e.vec_id AS other, round(list_cosine_distance(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, a) SELECT vec_id, arg_min(other, (distance, other)) AS nearest, min(distance) AS distance, min(distance) <= 0.001 AS ok FROM d GROUP BY vec_id")
def self_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of stored vectors to a sample of them: each must find itself."""
    from lectern.operators.vector import nearest

    own = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "owner_id")
    asked = own.filter("owner_id % 25 = 0").withColumnRenamed("owner_id", "query_id")
    best = nearest(own, asked, 1).groupBy("query_id").agg(F.min(F.struct("distance", "owner_id")).alias("best"))
    return best.select(F.col("query_id").alias("vec_id"), F.col("best.owner_id").alias("nearest"), F.col("best.distance").alias("distance"), (F.col("best.distance") <= 0.001).alias("ok"))


@query("WITH j AS (SELECT doc_id % 40 AS question, quality = 1 AS kept, 100 + doc_id % 60 AS cost, 150 AS whole FROM labels) SELECT question, count(*)::BIGINT AS n, round(avg(kept::INT), 6) AS retention, round(sum(cost + CASE WHEN kept THEN 0 ELSE whole END) / sum(whole), 6) AS cost_ratio FROM j GROUP BY question")
def excerpt_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("question"), (F.col("quality") == 1).alias("kept"), (100 + F.col("doc_id") % 60).alias("cost"), F.lit(150).alias("whole"))
    return E.retention(own, "question")


@query("SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name, coalesce(TRY_CAST(regexp_extract(url, '/(\\d+)', 1) AS BIGINT), -1) AS number, strpos(url, 'example') AS at, length(url) - length(replace(url, '/', '')) AS slashes FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on paths: removing, extracting, casting, finding, counting."""
    url = F.col("url")
    number = F.coalesce(F.regexp_extract(url, r"/(\d+)", 1).try_cast("bigint"), F.lit(-1))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(url, "^[a-z]+://[^/]*", "").alias("path"), F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1).alias("name"), number.cast("long").alias("number"), F.locate("example", url).cast("long").alias("at"), F.regexp_count(url, F.lit("/")).cast("long").alias("slashes"))
