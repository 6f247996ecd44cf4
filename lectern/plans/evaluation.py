"""Queries on evaluation: grades, rates, paired rules, exact tests, intervals, bootstrap and churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import evaluate as E
from lectern.plans.corpus import table
from lectern.plans.registering import area

QUERIES, ORACLE_SQL, query = area()

# Parts of a size as the results of a query, ranked by price; a part's container of price digits as its grade.
_RESULTS = "results AS (SELECT p_size AS query_id, p_partkey AS label, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank FROM part)"
_QRELS = "qrels AS (SELECT p_size AS query_id, p_partkey AS label, CAST(p_partkey % 11 AS INT) - 7 AS grade FROM part WHERE p_partkey % 11 > 7)"
_GRADED = f"""{_RESULTS}, {_QRELS},
credit AS (SELECT q.query_id, q.grade, r.rank FROM (SELECT query_id, label, min(rank) AS rank FROM results WHERE rank <= 50 GROUP BY ALL) r JOIN qrels q ON q.query_id = r.query_id AND q.label = r.label),
got AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN (pow(2.0, grade) - 1) / log2(rank + 1.0) ELSE 0 END) AS dcg, min(CASE WHEN grade >= 3 AND rank <= 20 THEN rank END) AS rank, max((rank = 1)::INT) AS valid FROM credit GROUP BY query_id),
ideal AS (SELECT query_id, sum((pow(2.0, grade) - 1) / log2(place + 1.0)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, label) AS place FROM qrels QUALIFY place <= 5) GROUP BY query_id),
graded AS (SELECT i.query_id, g.rank, coalesce(valid, 0) = 1 AS any_valid, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg FROM ideal i LEFT JOIN got g ON i.query_id = g.query_id)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    order = Window.partitionBy("p_size").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return part.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("label"), F.row_number().over(order).alias("rank")).filter("rank <= 50")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = table(spark, sf_dir, "part").filter("p_partkey % 11 > 7").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("label"), (F.col("p_partkey") % 11 - 7).cast("int").alias("grade"))
    return E.graded(results(spark, sf_dir), qrels)


@query(f"WITH {_GRADED} SELECT query_id, rank, any_valid, ndcg FROM graded")
def ndcg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades(spark, sf_dir)


@query(f"WITH {_GRADED} SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split, count(*)::BIGINT AS n, round(avg(coalesce(rank <= 1, false)::INT), 6) AS top1, round(avg(coalesce(rank <= 3, false)::INT), 6) AS top3, round(avg(coalesce(rank <= 5, false)::INT), 6) AS top5, round(avg(any_valid::INT), 6) AS any_valid, round(avg(ndcg), 6) AS ndcg, round(median(query_id * 1.5::DOUBLE), 6) AS median_ms, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY query_id * 1.5::DOUBLE), 6) AS p95_ms FROM graded GROUP BY ALL")
def topk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rates(grades(spark, sf_dir).withColumn("ms", F.col("query_id") * F.lit(1.5)).withColumn("split", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")), "split")


@query("SELECT event_type, count(*)::BIGINT AS n, round(median(value), 6) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS p90, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS most, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"), E.nearest_rank("value", 0.9).alias("p90"), E.nearest_rank("value", 0.95).alias("p95"), F.max("value").alias("most"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS i FROM events) WHERE i = 11")
def nth_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.nth(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), 10, "value", "event_type")


_RECORDS = "SELECT c_custkey AS key, CASE WHEN {0} % 5 = 0 THEN NULL ELSE {0} % 5 END AS rank, {0} % 3 = 0 AS any_valid, ({0} % 7) / 7.0::DOUBLE AS ndcg, {0} % 4 AS hits FROM customer"


def _records(spark: SparkSession, sf_dir: str, x: str) -> DataFrame:
    n = F.expr(x)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(n % 5 != 0, n % 5).alias("rank"), (n % 3 == 0).alias("any_valid"), (n % 7 / F.lit(7.0)).alias("ndcg"), (n % 4).alias("hits"))


@query(f"""WITH b AS ({_RECORDS.format("c_custkey")}), c AS ({_RECORDS.format("(c_custkey * 13 + c_nationkey)")}), p AS (SELECT b.key, [CASE WHEN b.rank IS NOT NULL AND (c.rank IS NULL OR c.rank > b.rank) THEN 'rank' END, CASE WHEN b.any_valid AND NOT c.any_valid THEN 'any_valid' END, CASE WHEN c.ndcg < b.ndcg - 1e-9 THEN 'ndcg' END, CASE WHEN b.hits > 0 AND c.hits = 0 THEN 'empty' END] AS r FROM b JOIN c ON b.key = c.key)
SELECT key, rule FROM (SELECT key, unnest(r) AS rule FROM p) WHERE rule IS NOT NULL""")
def paired_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.paired_violations(_records(spark, sf_dir, "c_custkey"), _records(spark, sf_dir, "c_custkey * 13 + c_nationkey"))


_WINS = "wins AS (SELECT n_regionkey AS stratum, count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_acctbal > 5000) AS wins, count(*) FILTER (WHERE c_custkey % 3 = 1 AND c_acctbal > 5500) AS losses FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    own = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy(F.col("n_regionkey").alias("stratum")).agg(F.count_if((F.col("c_custkey") % 3 == 0) & (F.col("c_acctbal") > 5000)).alias("wins"), F.count_if((F.col("c_custkey") % 3 == 1) & (F.col("c_acctbal") > 5500)).alias("losses"))


_COMB = "list_sum(list_transform(range({lo}, {hi} + 1), lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2.0))))"


@query(f"WITH {_WINS}, x AS (SELECT *, wins + losses AS n FROM wins) SELECT stratum, wins, losses, round(CASE WHEN n = 0 THEN 1 ELSE least(1.0, 2 * {_COMB.format(lo='0', hi='least(wins, losses)')}) END + 1e-10, 6) AS p FROM x")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wins(spark, sf_dir).select("stratum", "wins", "losses", F.round(E.tail_column(F.col("wins").cast("int"), F.col("losses").cast("int"), True) + 1e-10, 6).alias("p"))


@query(f"WITH {_WINS}, x AS (SELECT *, wins + losses AS n FROM wins) SELECT stratum, round(CASE WHEN n = 0 THEN 1 ELSE least(1.0, {_COMB.format(lo='wins', hi='n')}) END + 1e-10, 6) AS p FROM x")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wins(spark, sf_dir).select("stratum", F.round(E.tail_column(F.col("wins").cast("int"), F.col("losses").cast("int"), False) + 1e-10, 6).alias("p"))


@query("""WITH x AS (SELECT n_name, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE c_acctbal > 0))::DOUBLE AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), y AS (SELECT *, k / n AS p FROM x)
SELECT n_name, round((p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS high FROM y""")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    low, high = E.wilson_bounds(F.col("k"), F.col("n"))
    return own.select("n_name", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {_RESULTS}, a AS (SELECT query_id, list(label ORDER BY rank) AS v FROM results WHERE rank <= 10 GROUP BY ALL), n AS (SELECT p_size AS query_id, p_partkey AS label, row_number() OVER (PARTITION BY p_size ORDER BY round(p_retailprice / 10, 0) DESC, p_partkey) AS rank FROM part), b AS (SELECT query_id, list(label ORDER BY rank) AS v FROM n WHERE rank <= 10 GROUP BY ALL)
SELECT a.query_id, a.v[1] IS DISTINCT FROM b.v[1] AS top1, list_sort(a.v) <> list_sort(b.v) AS members, a.v <> b.v AS reordered FROM a JOIN b ON a.query_id = b.query_id""")
def rank_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    order = Window.partitionBy("p_size").orderBy(F.round(F.col("p_retailprice") / 10, 0).desc(), "p_partkey")
    new = part.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("item"), F.row_number().over(order).alias("rank")).filter("rank <= 10")
    return E.churn(results(spark, sf_dir).filter("rank <= 10").withColumnRenamed("label", "item"), new)


_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


@query(f"WITH b AS (SELECT item_id, ' ' || array_to_string({_TOKENS.format('text')}, ' ') || ' ' AS run FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string({_TOKENS.format('text')}, ' ') || ' ' AS t FROM documents) SELECT item_id, doc_id FROM b JOIN d ON contains(t, run) WHERE length(run) > 2")
def phrase_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a benchmark item whole, as a run of tokens."""
    return E.contained_phrases(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("WITH v AS (SELECT doc_id AS item, [quality, toxic, (doc_id % 3 = 0)::INT] AS votes FROM labels) SELECT item, list_sum(votes)::BIGINT AS yes, 2 * list_sum(votes) > 3 AS majority FROM v")
def judge_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.explode(F.array("quality", "toxic", (F.col("doc_id") % 3 == 0).cast("int"))).alias("vote"))
    return E.majority(votes)


@query("WITH a AS (SELECT o_custkey AS task, o_orderstatus AS arm, o_orderkey AS attempt, o_totalprice FROM orders) SELECT task, arm, max(attempt) AS attempt, arg_max(o_totalprice, attempt) AS o_totalprice FROM a GROUP BY ALL")
def last_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("arm")).agg(F.max("o_orderkey").alias("attempt"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))


@query("WITH x AS (SELECT a.vec_id, round(max(abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)), 6) AS most FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(1, 65) r(i) GROUP BY a.vec_id) SELECT vec_id, most FROM x")
def vector_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.vectors import max_difference

    own = table(spark, sf_dir, "embeddings")
    after = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return own.join(after, "vec_id").select("vec_id", F.round(max_difference(F.col("embedding"), F.col("other")), 6).alias("most"))
