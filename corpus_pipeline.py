"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing and token ids, one after the other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.base import shared_dir
from lectern.llm.decontaminate import contaminated_documents
from lectern.llm.mixing import mix_sources
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.queries import table, tokenizer_file
from lectern.llm.repetition import repetition_rules
from lectern.llm.token_store import read_digests, token_table, write_tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts, and those of fewer than 50 words, go. Rows that share an id, or are equal, are judged each on
    its own; a null id or other column stays null. Texts of any length are judged whole; columns but those of documents
    are left out. An empty table stays empty.
    """
    return repetition_rules(docs, carry=COLUMNS).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates (five words, similarity 0.8).

    Texts without words are in no group and stay. A null id counts as the smallest. Rows that share an id, and so
    equal rows, are one document and stay or go together. Columns but those of documents are left out. An empty table
    stays empty.
    """
    others = near_duplicates(docs, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.select(*COLUMNS).join(others, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``, word for word or with other numbers, names and units.

    Null and empty texts hold none and stay. Rows that share an id, also a null one, go together if one of them holds
    an item. Columns but those of documents are left out. Without documents the result is empty, without items all stay.
    """
    leaks = contaminated_documents(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.select(*COLUMNS).join(leaks, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the words taken over the document's, rounded.

    Texts without words are taken 0 times and go. Rows that share an id, also a null one, share the largest count, so
    equal rows are taken alike. Null is a source of its own. Columns but those of documents are left out. An empty
    table stays empty.
    """
    copies = mix_sources(docs).select(F.col("doc_id").alias("mixed"), F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int").alias("copies"))
    copies = copies.groupBy("mixed").agg(F.max("copies").alias("copies")).filter("copies > 0")
    joined = docs.select(*COLUMNS).join(copies, F.col("doc_id").eqNullSafe(F.col("mixed")))
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the compressed file format, and each document as read back from there: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are their end id alone. Null ids come first; rows that share an id, and equal rows, are
    documents of their own, next to each other. Only doc_id and text are read. An empty table gives no rows.
    """
    path = token_table(spark)
    write_tokens(docs, path, tokenizer_file)
    return read_digests(spark, path)


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing), ("token-ID / binary output", token_ids)]
#: SQL cannot express the quality verdict, template matches and tokenization; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each one's rows written to the shared folder and read again.

    What a stage wrote goes when the next one has written; the token table and the last stage's rows stay.
    """
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
        if i:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{i - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
