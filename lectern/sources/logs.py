"""Call logs in lines of JSON, and labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Fields (name to a path and type, as ``$.a.b type``) of each line that is JSON; other lines are left out."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    return lines.select(*[F.try_variant_get("v", *spec.rsplit(" ", 1)).alias(name) for name, spec in fields.items()])


def strict_json(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds ``value`` and ``refused`` to lines: those that are no JSON, or name a field twice, have no value and are refused."""
    value = F.try_parse_json(column)
    return lines.withColumn("value", value).withColumn("refused", F.col(column).isNull() | F.col("value").isNull())


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """(split, kind, query, expected, also_valid) of a JSON file of splits, each with kinds of queries."""
    entry = "array<struct<query:string,expected:string,also_valid:map<string,int>>>"
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"map<string,map<string,{entry}>>").alias("m"))
    kinds = whole.select(F.explode("m").alias("split", "kinds")).select("split", F.explode("kinds").alias("kind", "queries"))
    return kinds.select("split", "kind", F.inline("queries"))


def qrels(queries: DataFrame) -> DataFrame:
    """(query, label, grade): the expected label has grade 3, other valid ones their own."""
    pairs = F.map_concat(F.coalesce("also_valid", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))), F.map_from_arrays(F.array("expected"), F.array(F.lit(3))))
    return queries.select("query", F.explode(pairs).alias("label", "grade"))


def label_spellings(file_path, heading_path):
    """All ways to name a section: its path, file name and path, whole file path and path; part numbers do not count."""
    bare = F.regexp_replace(heading_path, r" \(Part \d+\)$", "")
    return F.array(bare, F.concat_ws("::", F.substring_index(file_path, "/", -1), bare), F.concat_ws("::", file_path, bare))
