"""Ingestion of new Markdown files as they come, and calls by windows of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.sources.markdown import is_markdown, parsed, sections
from lectern.schema import MAX_FILE_BYTES

FILE = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, most_files: int = 1000) -> DataFrame:
    """A stream of the Markdown files below ``root``. The file source meets additions only; edits and deletions are
    found by ``manifest_diff``."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files).load(root)
    return stream.filter((F.col("length") <= MAX_FILE_BYTES) & is_markdown(F.col("path"))).select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("text"))


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Parse what is new below ``root`` into sections at ``out`` and stop. A batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        sections(parsed(batch)).drop("passages").write.mode("overwrite").parquet(f"{out}/batch={number}")
        if each:
            each(batch, number)

    return new_files(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def calls_by_window(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of a stream of (ts, event_type, value) by windows; what comes later than ``late`` is not counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
