"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

All is DataFrame work. Each distinct URL is expanded into the expressions that a rule could be written as: suffixes
of its host, and with those that rules have, prefixes of its path in the lengths of those rules. Equi-joins on 32 bits
of the digest find few candidates, and the full digest confirms them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """The verdict of the longest rule that fits each URL.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the URL's path starts
    with the rule's. The longest host + path wins; of equal ones, a block before an allow, then the least text.
    Rows with a null host count as an empty host, a null path as an empty one.

    Returns a row for each input row: the id, host, path, rule (host + path, or null), verdict (the rule's, else
    ``default``). A null URL, or one without ://, has an empty host and path and fits no rule but one of an empty
    host. Rows that share an id are judged each on its own. Ports and user names belong to the host, as written.

    Distinct URLs are judged once, so a page that a third of all rows repeat costs one expansion. A host is split into
    no more labels than the longest rule's has, and a path into prefixes of the lengths that rules of its own host
    have, so that URLs of any length and rules of any number of lengths are judged.
    """
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    labels = rules.agg(F.coalesce(F.max(F.length("rule_host") - F.length(F.replace("rule_host", F.lit("."), F.lit(""))) + 1), F.lit(1)).alias("n")).first()["n"]
    hosts = rules.groupBy("rule_host").agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"))
    hosts = hosts.withColumn("digest", F.sha2("rule_host", 256)).select(_short(F.col("digest")).alias("short"), "digest", "lengths")
    keyed = rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", _short(F.col("digest")))
    rows = pages.select(F.col(id_column), F.col(url_column).cast("string").alias("url")).select(id_column, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    names = rows.select("host", "path").distinct()
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i)))
    tried = names.select("host", "path", F.explode(suffixes).alias("suffix")).withColumn("own", F.sha2("suffix", 256))
    known = tried.withColumn("short", _short(F.col("own"))).join(hosts, "short").filter(F.col("own") == F.col("digest")).select("host", "path", "suffix", "lengths")
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    spread = known.select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
    spread = spread.withColumn("own", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", _short(F.col("own"))).select("host", "path", "own", "short")
    fits = spread.join(keyed, "short").filter(F.col("own") == F.col("digest"))
    text = F.concat("rule_host", "rule_path")
    best = F.min(F.struct((-F.length(text)).alias("length"), F.when(F.col("rule_verdict") == "block", 0).otherwise(1).alias("rank"), text.alias("rule"), F.col("rule_verdict").alias("verdict")))
    # Cut off, so that the join is one of two plain shuffles, and a URL that is everywhere, or none, is split.
    judged = cut(fits.groupBy("host", "path").agg(best.alias("best")))
    return rows.join(judged, ["host", "path"], "left").select(id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
