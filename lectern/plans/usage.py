"""Queries on call logs, over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import usage as U
from lectern.plans.corpus import table
from lectern.plans.registering import area
from lectern.sources import logs

QUERIES, ORACLE_SQL, query = area()

_CALLS = "calls AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'file' ELSE 'other' END AS kind, event_type = 'error' AS failed, event_id FROM events)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: a user's are a session."""
    from pyspark.sql.window import Window

    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "read").when(F.col("event_type") == "purchase", "file").otherwise("other")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx"), kind.alias("kind"), (F.col("event_type") == "error").alias("failed"), "event_id")


@query(f"""WITH {_CALLS}, n AS (SELECT *, list(kind) OVER (PARTITION BY session ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS next FROM calls)
SELECT session, idx::INT AS idx, coalesce(list_contains(next, 'read'), false) AS then_read, coalesce(list_contains(next, 'search'), false) AS then_search, coalesce(list_contains(next, 'file'), false) AS then_file, coalesce(list_contains(next, 'other'), false) AS then_other FROM n WHERE kind = 'search'""")
def fallback_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.follow_ups(calls(spark, sf_dir))


@query(f"""WITH {_CALLS}, s AS (SELECT session, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY session ORDER BY idx) <= 4 THEN 0 ELSE 1 END AS new FROM calls WHERE kind = 'search'), c AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY idx) AS chain FROM s)
SELECT session, min(idx)::INT AS first_idx, count(*)::BIGINT AS searches FROM c GROUP BY session, chain HAVING count(*) > 1""")
def reformulation_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.chains(calls(spark, sf_dir))


@query(f"WITH {_CALLS} SELECT session, count(*)::BIGINT AS calls, (count(*) FILTER (WHERE kind = 'search'))::BIGINT AS searches, (count(*) FILTER (WHERE kind = 'read'))::BIGINT AS reads, (count(*) FILTER (WHERE failed))::BIGINT AS failures, bool_or(kind IN ('search', 'read')) AS documented FROM calls GROUP BY session")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.sessions(calls(spark, sf_dir))


# Views wait for clicks of the same user and hundred: the n-th click that comes while a view waits answers the n-th view.
_LOG = "log AS (SELECT user_id % 10 AS file, user_id % 100 AS id, event_id AS seq, CASE event_type WHEN 'view' THEN 1 ELSE -1 END AS step FROM events WHERE event_type IN ('view', 'click'))"


@query(f"""WITH {_LOG}, b AS (SELECT *, sum(step) OVER (PARTITION BY file, id ORDER BY seq) AS balance FROM log),
l AS (SELECT *, least(0, coalesce(min(balance) OVER (PARTITION BY file, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY file, id, step ORDER BY seq) AS turn FROM l WHERE step = 1 OR balance >= low)
SELECT u.file, u.id, u.seq AS use_seq, r.seq AS result_seq FROM t u LEFT JOIN t r ON r.step = -1 AND u.file = r.file AND u.id = r.id AND u.turn = r.turn WHERE u.step = 1""")
def call_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("file"), (F.col("user_id") % 100).alias("id"), F.col("event_id").alias("seq"), "event_type")
    return U.paired_calls(own.filter("event_type = 'view'"), own.filter("event_type = 'click'"))


@query("SELECT conv_id, turn, substr(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1, 400) AS request FROM conversations")
def task_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.task_context(table(spark, sf_dir, "conversations"))


@query("SELECT text AS query, count(*)::BIGINT AS n, array_to_string(list(conv_id * 1000 + turn ORDER BY conv_id * 1000 + turn), ',') AS places FROM conversations WHERE role = 'user' GROUP BY text")
def query_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users asked, in whole, with how often and where."""
    own = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("text").alias("query"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"))
    return U.distinct_queries(own).select("query", "n", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


@query("SELECT event_id, event_id % 3 <> 0 AS refused FROM events")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, some broken and some with a field twice: both are refused."""
    line = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit('{"k": 1, "k": 2}')).otherwise(F.concat(F.lit("{"), "props"))
    return logs.strict_json(table(spark, sf_dir, "events").select("event_id", line.alias("line"))).select("event_id", "refused")


@query("SELECT event_type, (count(*) FILTER (WHERE k IS NULL))::BIGINT AS broken, sum(k)::BIGINT AS total FROM (SELECT event_type, TRY_CAST(json_extract(CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, some of them broken: those are counted and left out."""
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    own = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(F.try_parse_json(text), "$.k", "bigint").alias("k"))
    return own.groupBy("event_type").agg(F.count_if(F.col("k").isNull()).alias("broken"), F.sum("k").alias("total"))
