"""How the tables of a folder stand for the tables of a documentation index."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import keyword, vector
from lectern.session import shared_folder

#: About so many postings a task sorts as they are written: some 150 MB of rows.
SORTED = 2_000_000
_INDEXES: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a section: its file below language and source, its source as the heading."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("section_id"),
        F.concat_ws("/", "lang", "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("file_path"),
        F.col("source").alias("heading_title"),
        F.concat_ws(" > ", "lang", "source").alias("heading_path"),
        F.col("text").alias("content"),
        F.lit(1).alias("start_line"),
        F.lit(0).alias("part_index"),
    )


def _indexed(spark: SparkSession, sf_dir: str, part: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A part of the index of a folder's sections: written when it is first read, once for each application, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, part)
    if key not in _INDEXES:
        place = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}/{part}"
        made(sections(spark, sf_dir)).write.parquet(place)
        _INDEXES[key] = place
    return spark.read.parquet(_INDEXES[key])


def lexicon(spark: SparkSession, sf_dir: str) -> keyword.Lexicon:
    """The inverted index of a folder's sections. Texts are dealt to as many tasks as keep what each sorts in memory."""
    lengths = _indexed(spark, sf_dir, "lengths", keyword.lengths)

    def made(own: DataFrame) -> DataFrame:
        tasks = (lengths.agg(F.sum("length")).first()[0] or 0) // SORTED + 1
        return keyword.stored_order(keyword.postings(own.repartition(tasks, "section_id")))

    return keyword.Lexicon(_indexed(spark, sf_dir, "postings", made), lengths)


def section_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner_id, embedding) of a folder's sections, from its index."""
    return _indexed(spark, sf_dir, "vectors", lambda own: vector.hashed_embeddings(own.select(F.col("section_id").alias("owner_id"), F.col("content").alias("text"))))


#: The same in DuckDB.
SECTIONS_SQL = "SELECT doc_id AS section_id, lang || '/' || source || '/doc-' || doc_id || '.md' AS file_path, source AS heading_title, lang || ' > ' || source AS heading_path, text AS content, 1 AS start_line, 0 AS part_index FROM documents"


def questions(spark: SparkSession, sf_dir: str, words: int = 6) -> DataFrame:
    """The first words of each benchmark item as a query: as short as what people type. That is what a query is here, not a sample of items or of sections."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, words), " ").alias("query"))


QUESTIONS_SQL = "SELECT item_id AS query_id, array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:6], ' ') AS query FROM benchmark"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with text of a document: (section_id, ordinal, content)."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("ordinal", "content"))
    return lines


PASSAGES_SQL = "SELECT doc_id AS section_id, (unnest(range(len(l))))::INT AS ordinal, unnest(l) AS content FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)"
