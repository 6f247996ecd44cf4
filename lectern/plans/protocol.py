"""Queries on protocols of evaluation: intervals, verdicts, judges, adoption, baselines and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import evaluate as E
from lectern.operators import usage as U
from lectern.plans.corpus import SECTIONS_SQL, sections, table
from lectern.plans.evaluation import _QRELS, _RESULTS, results
from lectern.plans.registering import area

QUERIES, ORACLE_SQL, query = area()

_DRAW = "('0x' || substr(md5('1|' || r.r || '|' || t.t), 1, 8))::BIGINT % (SELECT count(*) FROM c)"
_CLUSTERS = "c AS (SELECT row_number() OVER (ORDER BY c_nationkey) - 1 AS place, sum(c_acctbal) AS top, count(*) AS bottom FROM customer GROUP BY c_nationkey)"
_RATIOS = f"d AS (SELECT r.r AS round, {_DRAW} AS place FROM range({{0}}) r(r), range((SELECT count(*) FROM c)) t(t)), ratios AS (SELECT d.round, sum(top) / sum(bottom) AS ratio FROM d JOIN c USING (place) GROUP BY d.round)"


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("top"), F.count("*").alias("bottom"))
    # Nations, of which there are 25, are numbered by what comes before them.
    keys = by.agg(F.sort_array(F.collect_list("c_nationkey")).alias("keys"))
    return by.crossJoin(F.broadcast(keys)).select((F.array_position("keys", F.col("c_nationkey")) - 1).alias("place"), "top", "bottom")


@query(f"WITH {_CLUSTERS}, {_RATIOS.format(200)} SELECT round, round(ratio, 3) AS ratio FROM ratios")
def bootstrap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap_ratio(_clusters(spark, sf_dir), 200).select("round", F.round("ratio", 3).alias("ratio"))


@query(f"WITH {_CLUSTERS}, {_RATIOS.format(2000)} SELECT count(*)::BIGINT AS rounds, round((list_sort(list(ratio)))[floor(count(*) * 0.95)::INT], 3) AS bound FROM ratios")
def bootstrap_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.upper_bound(E.bootstrap_ratio(_clusters(spark, sf_dir), 2000)).select("rounds", F.round("bound", 3).alias("bound"))


@query(f"WITH {_RESULTS}, {_QRELS}, hit AS (SELECT DISTINCT q.query_id FROM results r JOIN qrels q ON q.query_id = r.query_id AND q.label = r.label WHERE r.rank <= 5 AND q.grade >= 2) SELECT DISTINCT query_id, query_id IN (SELECT query_id FROM hit) AS recalled FROM qrels")
def recall5(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = table(spark, sf_dir, "part").filter("p_partkey % 11 > 7").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("label"), (F.col("p_partkey") % 11 - 7).cast("int").alias("grade"))
    return E.recalled(results(spark, sf_dir), qrels)


@query("""WITH c AS (SELECT c_nationkey AS place, sum((c_custkey % 5 > 0)::INT - (c_custkey % 7 > 0)::INT) AS top, count(*) AS bottom FROM customer GROUP BY ALL), n AS (SELECT row_number() OVER (ORDER BY place) - 1 AS place, top, bottom FROM c),
d AS (SELECT r.r AS round, ('0x' || substr(md5('1|' || r.r || '|' || t.t), 1, 8))::BIGINT % (SELECT count(*) FROM n) AS place FROM range(2000) r(r), range((SELECT count(*) FROM n)) t(t)),
x AS (SELECT list_sort(list(ratio)) AS v FROM (SELECT sum(top)::DOUBLE / sum(bottom) AS ratio FROM d JOIN n USING (place) GROUP BY round)), y AS (SELECT v[ceil(len(v) * 0.025)::INT] AS low, v[ceil(len(v) * 0.975)::INT] AS high FROM x)
SELECT round(low, 6) AS low, round(high, 6) AS high, CASE WHEN low > -0.05 THEN 0 WHEN high < -0.05 THEN 1 ELSE 2 END AS exit FROM y""")
def paired_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired difference of two systems over resampled clusters, and what it decides."""
    by = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum((F.col("c_custkey") % 5 > 0).cast("int") - (F.col("c_custkey") % 7 > 0).cast("int")).alias("top"), F.count("*").alias("bottom"))
    keys = by.agg(F.sort_array(F.collect_list("c_nationkey")).alias("keys"))
    own = by.crossJoin(F.broadcast(keys)).select((F.array_position("keys", F.col("c_nationkey")) - 1).alias("place"), "top", "bottom")
    return E.paired_interval(own, 2000, 0.05).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "exit")


@query("""WITH p AS (SELECT quality * 2 + toxic AS a, doc_id % 4 AS b FROM labels), n AS (SELECT count(*) AS n, sum(abs(a - b)) AS seen FROM p), l AS (SELECT a, count(*) AS k FROM p GROUP BY a), r AS (SELECT b, count(*) AS k FROM p GROUP BY b)
SELECT n.n::BIGINT AS items, round(1 - seen * n.n::DOUBLE / (SELECT sum(l.k * r.k * abs(a - b)) FROM l, r), 6) AS kappa FROM n""")
def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.weighted_kappa(table(spark, sf_dir, "labels").select((F.col("quality") * 2 + F.col("toxic")).alias("a"), (F.col("doc_id") % 4).alias("b")), 3).select("items", F.round("kappa", 6).alias("kappa"))


@query(f"""WITH s AS ({SECTIONS_SQL}), l AS (SELECT DISTINCT CASE section_id % 3 WHEN 0 THEN heading_path WHEN 1 THEN 'doc-' || section_id || '.md::' || heading_path ELSE 'doc-' || (section_id + 1000000000) || '.md::' || heading_path END AS label FROM s),
m AS (SELECT label, count(section_id)::BIGINT AS matches, min(file_path) AS f, min(heading_path) AS h FROM l LEFT JOIN s ON label = heading_path OR label = string_split(file_path, '/')[-1] || '::' || heading_path GROUP BY label)
SELECT label, matches, CASE WHEN matches = 1 THEN f END AS file_path, CASE WHEN matches = 1 THEN h END AS heading_path FROM m""")
def label_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by heading alone, by file and heading, and of files that there are not."""
    own = sections(spark, sf_dir)
    name = lambda n: F.concat(F.lit("doc-"), n.cast("string"), F.lit(".md::"), F.col("heading_path"))
    labels = own.select(F.when(F.col("section_id") % 3 == 0, F.col("heading_path")).when(F.col("section_id") % 3 == 1, name(F.col("section_id"))).otherwise(name(F.col("section_id") + 1000000000)).alias("label"))
    return E.resolved_labels(labels, own.select("file_path", "heading_path"))


@query("SELECT event_type AS split, user_id % 3 AS shape, count(*)::BIGINT AS n, round(avg((event_id % 4 = 0)::INT), 6) AS abstained, round(avg((event_id % 6 = 0)::INT), 6) AS no_match, round(median(value), 6) AS payload FROM events GROUP BY ALL")
def no_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.no_answer(table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), (F.col("user_id") % 3).alias("shape"), (F.col("event_id") % 4).alias("hits"), (F.col("event_id") % 6 == 0).alias("no_match"), F.col("value").alias("payload")), "split", "shape")


def _tree_sql(by: str, order: str, value: str, source: str) -> str:
    """The SQL of ``fingerprints``."""
    steps = [f"l0 AS (SELECT {by}, {order}::BIGINT AS n, sha256(coalesce({value}::VARCHAR, '')) AS digest FROM {source})"]
    steps += [f"l{i} AS (SELECT {by}, n // 1000 AS n, sha256(string_agg(m || ':' || digest, chr(10) ORDER BY m, digest)) AS digest FROM (SELECT *, n AS m FROM l{i - 1}) GROUP BY {by}, n // 1000)" for i in range(1, 5)]
    return f"WITH {', '.join(steps)} SELECT {by}, sha256(string_agg(digest, chr(10) ORDER BY n)) AS digest FROM l4 GROUP BY {by}"


@query(_tree_sql("lang", "doc_id", "text", "documents"))
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each language's documents that depends on their order."""
    return E.fingerprints(table(spark, sf_dir, "documents"), ["lang"], "doc_id", "text")


@query("WITH " + _tree_sql("split", "item_id", "text", "(SELECT item_id % 3 AS split, item_id, text FROM benchmark)").removeprefix("WITH "))
def case_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fingerprints(table(spark, sf_dir, "benchmark").withColumn("split", F.col("item_id") % 3), ["split"], "item_id", "text")


_SCORED = "SELECT n_name AS name, avg((c_acctbal > {0})::INT) AS top1, avg((c_acctbal > {0} - 1000)::INT) AS top5, {1} AS cases FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey"


def _scored(spark: SparkSession, sf_dir: str, least: int, cases: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy(F.col("n_name").alias("name"), "n_regionkey").agg(F.avg((F.col("c_acctbal") > least).cast("int")).alias("top1"), F.avg((F.col("c_acctbal") > least - 1000).cast("int")).alias("top5")).withColumn("cases", F.expr(cases)).drop("n_regionkey")


@query(f"""WITH s AS ({_SCORED.format(5000, "'c' || n_regionkey")}), b AS (SELECT * FROM ({_SCORED.format(5200, "CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN 'old' ELSE 'c' || n_regionkey END")}) WHERE name NOT LIKE 'I%'),
j AS (SELECT s.name, CASE WHEN b.name IS NULL THEN 'no baseline' WHEN b.cases IS NULL THEN 'baseline of unknown cases' WHEN b.cases <> s.cases THEN 'baseline of other cases' END AS note, s.top1 - b.top1 AS d1, s.top5 - b.top5 AS d5 FROM s LEFT JOIN b ON s.name = b.name)
SELECT name, f AS field, round(CASE WHEN note IS NULL THEN (CASE f WHEN 'top1' THEN d1 ELSE d5 END) * 100 END, 6) AS delta, note FROM j, (VALUES ('top1'), ('top5')) v(f)""")
def baseline_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _scored(spark, sf_dir, 5200, "CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN 'old' ELSE 'c' || n_regionkey END").filter("name NOT LIKE 'I%'")
    return E.deltas(_scored(spark, sf_dir, 5000, "'c' || n_regionkey"), base, ["top1", "top5"])


@query(f"WITH s AS ({_SCORED.format(5000, 'NULL')}), e AS (SELECT name, 'top1' AS field, top1 AS value, 0.45 AS least FROM s UNION ALL SELECT name, 'top5', top5, 0.5 FROM s) SELECT name, field, round(value, 6) AS value FROM e WHERE value < least")
def below_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.below_floors(_scored(spark, sf_dir, 5000, "NULL"), {"top1": 0.45, "top5": 0.5}).select("name", "field", F.round("value", 6).alias("value"))


@query("""WITH x AS (SELECT event_type, median(value) FILTER (WHERE event_id % 2 = 0) / median(value) FILTER (WHERE event_id % 2 = 1) AS m, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) FILTER (WHERE event_id % 2 = 0) / percentile_disc(0.95) WITHIN GROUP (ORDER BY value) FILTER (WHERE event_id % 2 = 1) AS p FROM events GROUP BY event_type)
SELECT event_type, round(m, 6) AS median, round(p, 6) AS p95, m <= 1.1 AND p <= 1.25 AS held FROM x""")
def latency_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latency_verdict(table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 2 == 0).alias("on"), F.col("value").alias("ms")), "event_type")


_GRADES = "SELECT doc_id % 3 AS agent, doc_id AS task, toxic = 0 AS answerable, CASE WHEN quality = 1 THEN 'correct' WHEN doc_id % 2 = 0 THEN 'abstained' ELSE 'wrong' END AS a, CASE WHEN doc_id % 5 > 1 THEN 'correct' WHEN doc_id % 5 = 0 THEN 'abstained' ELSE 'partial' END AS b FROM labels"


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("quality") == 1, "correct").when(F.col("doc_id") % 2 == 0, "abstained").otherwise("wrong")
    b = F.when(F.col("doc_id") % 5 > 1, "correct").when(F.col("doc_id") % 5 == 0, "abstained").otherwise("partial")
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).alias("agent"), F.col("doc_id").alias("task"), (F.col("toxic") == 0).alias("answerable"), a.alias("a"), b.alias("b"))


_HARMS = f"""g AS ({_GRADES}), x AS (SELECT agent, count(*) FILTER (WHERE answerable AND a = 'correct') - count(*) FILTER (WHERE answerable AND b = 'correct') AS lost, count(*) FILTER (WHERE answerable) AS asked, count(*) FILTER (WHERE NOT answerable AND a = 'abstained') - count(*) FILTER (WHERE NOT answerable AND b = 'abstained') AS fewer FROM g GROUP BY agent),
h AS (SELECT agent, round(CASE WHEN asked > 0 THEN lost / asked ELSE 0 END, 6) AS drop, fewer, asked > 0 AND lost * 100 >= asked * 15 OR fewer >= 2 AS harm FROM x)"""


@query(f"WITH {_HARMS} SELECT agent, drop, fewer, harm FROM h")
def harms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.harms(_grades(spark, sf_dir))


@query(f"WITH {_HARMS}, e AS (SELECT agent, count(*) FILTER (WHERE b = 'correct' AND a <> 'correct') > count(*) FILTER (WHERE a = 'correct' AND b <> 'correct') AS effect FROM g GROUP BY agent) SELECT bool_or(effect) AND NOT bool_or(harm) AS ship FROM e FULL JOIN h ON e.agent = h.agent")
def ship_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _grades(spark, sf_dir)
    effects = own.groupBy("agent").agg((F.count_if((F.col("b") == "correct") & (F.col("a") != "correct")) > F.count_if((F.col("a") == "correct") & (F.col("b") != "correct"))).alias("effect"))
    return E.ships(effects, E.harms(own))


@query("""WITH p AS (SELECT lang AS repo, quality = 1 AS a, l.doc_id % 3 > 0 AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id), x AS (SELECT repo, count(*)::BIGINT AS pairs, (count(*) FILTER (WHERE a))::BIGINT AS a, (count(*) FILTER (WHERE b))::BIGINT AS b, (count(*) FILTER (WHERE b AND NOT a) - count(*) FILTER (WHERE a AND NOT b))::BIGINT AS difference FROM p GROUP BY repo), y AS (SELECT *, b / pairs AS s, pairs::DOUBLE AS n FROM x)
SELECT repo, pairs, a, b, difference, round((s + 3.8416 / (2 * n) - 1.96 * sqrt((s * (1 - s) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS low, round((s + 3.8416 / (2 * n) + 1.96 * sqrt((s * (1 - s) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS high FROM y""")
def adoption_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return E.adoption_by(own.select(F.col("lang").alias("repo"), (F.col("quality") == 1).alias("a"), (F.col("doc_id") % 3 > 0).alias("b")), "repo")


@query("""WITH a AS (SELECT o_custkey AS task, CASE o_orderstatus WHEN 'F' THEN 'A' ELSE 'B' END AS arm, o_orderkey AS attempt, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS value FROM orders), l AS (SELECT task, arm, arg_max({'v': value}, attempt) AS s FROM a GROUP BY ALL),
p AS (SELECT task, max(s) FILTER (WHERE arm = 'A') AS a, max(s) FILTER (WHERE arm = 'B') AS b FROM l GROUP BY task)
SELECT c_custkey AS task, a.v AS a, b.v AS b, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a.v IS NULL OR b.v IS NULL THEN 'dropped' ELSE 'kept' END AS state FROM customer LEFT JOIN p ON task = c_custkey""")
def kept_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last attempt of each arm at every customer's task; which pairs are kept, dropped, or never ran."""
    attempts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("B").alias("arm"), F.col("o_orderkey").alias("attempt"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("value"))
    return E.kept_attempts(attempts, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task")))


_HITS = "SELECT doc_id AS item, lang AS query, 'd' || doc_id AS file_path, source AS heading_path, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') ELSE split_part(coalesce(text, ''), chr(10), 1) END AS content, coalesce(text, '') AS section FROM documents"


@query(f"""WITH h AS ({_HITS}), x AS (SELECT *, content <> section AS cut, substr(md5('judges|' || item), 1, 1) < '8' AS first FROM h)
SELECT item, query, file_path || ' :: ' || heading_path AS cluster, sha256(CASE WHEN cut AND NOT first THEN section ELSE content END) AS a, CASE WHEN cut THEN sha256(CASE WHEN first THEN section ELSE content END) END AS b, CASE WHEN cut THEN CASE WHEN first THEN 'A' ELSE 'B' END END AS excerpt, CASE WHEN cut AND first THEN 'B' ELSE 'A' END AS whole_as,
  ceil(length(content) / 4.0)::BIGINT AS payload_tokens, ceil(length(section) / 4.0)::BIGINT AS whole_tokens, ceil(length(section) / 4.0)::BIGINT AS read_tokens, sha256(query) AS query_sha256, sha256(section) AS section_sha256 FROM x""")
def judge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts (first lines) and whole texts for judges; the texts as digests."""
    text = F.coalesce("text", F.lit(""))
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("query"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.col("source").alias("heading_path"), F.when(F.col("doc_id") % 4 == 0, text).otherwise(F.split(text, "\n")[0]).alias("content"), text.alias("section"))
    made = E.judge_items(hits.withColumn("payload", F.col("content")).withColumn("whole", F.col("section")), "judges")
    return made.withColumn("a", F.sha2("a", 256)).withColumn("b", F.sha2("b", 256))


@query("""WITH i AS (SELECT item_id AS item FROM benchmark), v AS (SELECT item_id + 1 AS item, CASE item_id % 4 WHEN 0 THEN 'maybe' ELSE 'yes' END AS verdict FROM benchmark WHERE item_id % 5 > 0 UNION ALL SELECT item_id, 'no' FROM benchmark WHERE item_id % 7 = 0), c AS (SELECT item, count(*) AS n, min((verdict IN ('yes', 'no'))::INT) AS known FROM v GROUP BY item),
b AS (SELECT coalesce(i.item, c.item) AS item, CASE WHEN i.item IS NULL THEN 'not given' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'twice' WHEN known = 0 THEN 'malformed' END AS error FROM i FULL JOIN c ON i.item = c.item) SELECT item, error FROM b WHERE error IS NOT NULL""")
def verdict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "benchmark")
    verdicts = own.filter("item_id % 5 > 0").select((F.col("item_id") + 1).alias("item"), F.when(F.col("item_id") % 4 == 0, "maybe").otherwise("yes").alias("verdict")).unionByName(own.filter("item_id % 7 = 0").select(F.col("item_id").alias("item"), F.lit("no").alias("verdict")))
    return E.verdict_errors(own.select(F.col("item_id").alias("item")), verdicts, ["yes", "no"])


@query("SELECT p_brand AS cache, p_partkey AS key FROM (SELECT p_brand, p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS total FROM part) WHERE total > 500")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evicted(table(spark, sf_dir, "part").select(F.col("p_brand").alias("cache"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("used")), 500, "cache")


@query("""WITH o AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 9 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE source END AS source FROM documents WHERE doc_id % 8 <> 0),
j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN ['missing'] WHEN o.doc_id IS NULL THEN ['added'] ELSE [CASE WHEN o.lang IS DISTINCT FROM n.lang THEN 'lang' END, CASE WHEN o.source IS DISTINCT FROM n.source THEN 'source' END] END AS f FROM o FULL JOIN n ON o.doc_id = n.doc_id)
SELECT doc_id, field FROM (SELECT doc_id, unnest(f) AS field FROM j) WHERE field IS NOT NULL""")
def cache_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    made = own.filter("doc_id % 8 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 6 != 0, F.col("source")).alias("source"))
    return E.field_differences(own.filter("doc_id % 9 <> 0"), made, "doc_id", ["lang", "source"])


@query("SELECT event_id, value AS ms FROM events WHERE value > 50 ORDER BY value DESC, event_id LIMIT 10")
def slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.slowest(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("ms")), 50)


@query("SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE i % greatest(1, n // 10) = 0 AND i // greatest(1, n // 10) < 10")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each language at an even stride."""
    return E.even_spread(table(spark, sf_dir, "documents").select("doc_id", "lang"), 10, "lang", "doc_id").select("doc_id")


@query("""SELECT user_id::VARCHAR AS file, event_id * 2 AS seq, 'c' || event_id AS id, 'mcp__docs__' || event_type AS name, event_id % 10 = 0 AS failed FROM events WHERE event_id % 2 = 0
UNION ALL SELECT user_id::VARCHAR, event_id * 2, 'c' || event_id, CASE event_id % 4 WHEN 1 THEN 'Bash' ELSE 'mcp__docs__' || event_type END, event_id % 3 = 0 FROM events WHERE event_id % 2 = 1""")
def normalised_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines of two agents' logs, with broken lines among them, and read back as calls of one shape."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), (F.col("event_id") * 2).alias("seq"), F.col("event_id").alias("n"), "event_type")
    said = lambda form, *args: F.format_string(form, F.col("n"), *args)
    tool = F.col("event_type")
    use = said('{"type":"assistant","message":{"content":[{"type":"text"},{"type":"tool_use","id":"c%d","name":"mcp__docs__%s"}]}}', tool)
    result = said('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"c%d","is_error":%s}]}}', (F.col("n") % 10 == 0).cast("string"))
    command = said('{"type":"item.completed","item":{"id":"c%d","type":"command_execution","exit_code":%d}}', F.when(F.col("n") % 3 == 0, 2).otherwise(0))
    call = said('{"type":"item.completed","item":{"id":"c%d","type":"mcp_tool_call","server":"docs","tool":"%s","status":"%s"}}', tool, F.when(F.col("n") % 3 == 0, "failed").otherwise("completed"))
    even, odd = own.filter("n % 2 = 0"), own.filter("n % 2 = 1")
    lines = even.select("file", "seq", use.alias("line")).unionByName(even.select("file", (F.col("seq") + 1).alias("seq"), result.alias("line"))).unionByName(odd.select("file", "seq", F.when(F.col("n") % 4 == 1, command).otherwise(call).alias("line"))).unionByName(odd.select("file", (F.col("seq") + 1).alias("seq"), F.lit('{"broken').alias("line")))
    return U.normalised_calls(lines)
