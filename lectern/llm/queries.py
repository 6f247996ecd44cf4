"""Queries of the text operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.decontaminate import contaminated_documents
from lectern.llm.line_dedup import drop_repeated_lines
from lectern.llm.mixing import mix_sources
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.pii import replace_pii
from lectern.llm.quality import quality_scores
from lectern.llm.repetition import repetition_rules
from lectern.llm.substring_dedup import drop_repeated_substrings
from lectern.llm.token_store import read_digests, token_table, write_tokens
from lectern.llm.url_filter import judge_urls

#: Rules that the URL query applies.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
PII_KEY = "lectern"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The byte-level BPE file, as an executor finds it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_table(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file)
    return read_digests(spark, path)


def op5_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents")).drop("repeats")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS t(host, path, verdict)"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_pii_surrogates, op3_source_mix, op4_token_store, op5_repetition_rules, op6_url_filter, op7_near_dedup, op8_substring_dedup, op9_contamination, op10_quality_scores)
}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM split),
keyed AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op3_source_mix": rf"""
WITH sized AS (SELECT doc_id, source, coalesce('=' || source, '') AS src, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
                      md5('mix' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS digest FROM documents),
totals AS (SELECT src, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals),
weighted AS (SELECT *, (ARRAY[5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(place - 1) % 3 + 1] AS weight, (source_size * 3)::DOUBLE AS most FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
targets AS (SELECT src, place, source_size, least(most, weight * max(level) OVER ()) AS target FROM levels),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN target / 64 ELSE 0 END AS share FROM targets),
seats AS (SELECT src, share, place, unnest(range(1, (source_size * 3) // 64 + 1)) AS seat FROM shares WHERE source_size * 3 >= 64),
best AS (SELECT *, row_number() OVER (ORDER BY share / (seat * 2 - 1) DESC, place, seat) AS turn FROM seats),
won AS (SELECT src, count(*) * 64 AS quota FROM best WHERE turn <= (SELECT round(sum(share)) FROM shares) GROUP BY src),
quotas AS (SELECT s.src, s.source_size, s.target, (CASE WHEN target >= source_size * 3 THEN source_size * 3 ELSE coalesce(w.quota, 0) END)::BIGINT AS quota,
                  ('0x' || substr(md5('mix|' || s.src), 1, 8))::BIGINT % greatest(1, ceil(s.source_size / 64.0)::BIGINT) * 64 AS first FROM shares s LEFT JOIN won w USING (src)),
shards AS (SELECT greatest(1, ceil(sum(source_size) / 524288.0))::BIGINT AS n FROM totals),
placed AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.quota // greatest(q.source_size, 1) AS whole, q.first, q.first + q.quota - q.quota // greatest(q.source_size, 1) * q.source_size AS until,
                  sum(d.size) OVER (PARTITION BY d.src ORDER BY ('0x' || substr(digest, 1, 8))::BIGINT % shards.n, d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
           FROM sized d JOIN quotas q USING (src), shards)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE whole * size + greatest(0, least(stop, until) - greatest(stop - size, first)) + greatest(0, least(stop, until - source_size) - (stop - size)) END)::BIGINT AS taken
FROM placed""",
    "op6_url_filter": r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
names AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path,
       (SELECT rule_host || rule_path FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) ORDER BY length(rule_host || rule_path) DESC LIMIT 1), 'allow') AS verdict
FROM names""",
    "op7_near_dedup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
spread AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
           FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)),
shingles AS (SELECT DISTINCT doc_id, md5(s) AS s FROM spread),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
links AS (SELECT a AS u, b AS v FROM near UNION ALL SELECT b, a FROM near),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.other = l.u)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op8_substring_dedup": rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
first AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (h) WHERE d < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
left_over AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS kept FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN left_over USING (doc_id)""",
}
