"""Keeping an index true to its files: manifest diffs, purges, upserts, reuse, provenance and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import kept


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, state) of two manifests with file_path, content_hash, vector_format, weights_revision, mtime_ns.

    A file is unchanged if hash and format agree and its weights are unknown or the same; touched if only its time
    moved; else new, changed or vanished.
    """
    a = old.select("file_path", *[F.col(c).alias(f"old_{c}") for c in ("content_hash", "vector_format", "weights_revision", "mtime_ns")], F.lit(True).alias("was"))
    b = new.select("file_path", "content_hash", "vector_format", "weights_revision", "mtime_ns", F.lit(True).alias("is"))
    joined = a.join(b, "file_path", "full_outer")
    same = (F.col("old_content_hash") == F.col("content_hash")) & (F.col("old_vector_format") == F.col("vector_format")) & (F.col("weights_revision").isNull() | F.col("old_weights_revision").eqNullSafe(F.col("weights_revision")))
    still = F.when(F.col("old_mtime_ns").eqNullSafe(F.col("mtime_ns")), "unchanged").otherwise("touched")
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "vanished").when(same, still).otherwise("changed")
    return joined.select("file_path", state.alias("state"))


def purged(old: DataFrame, seen: DataFrame, unreachable: list[str]) -> DataFrame:
    """Files of ``old`` to drop: not seen, and not below a directory that could not be read, where absence proves nothing."""
    below = F.lit(False)
    for prefix in unreachable:
        below |= F.col("file_path").startswith(prefix.rstrip("/") + "/")
    return old.filter(~below).join(seen.select("file_path").distinct(), "file_path", "left_anti")


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with rows of ``changes`` in place of those of the same key, and added where there were none."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(*table.columns))


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def reused(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Vectors for (owner_id, text) from those stored for the very same text in (text, embedding, source_id); the least source wins."""
    first = known.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min_by("embedding", "source_id").alias("embedding"))
    return texts.withColumn("digest", F.sha2("text", 256)).join(first, "digest", "left").drop("digest")


def certifiable(documents: DataFrame, vectors: DataFrame, revision: str) -> DataFrame:
    """Documents with vectors that other weights made; the index may be certified for ``revision`` if there are none."""
    stale = documents.filter(~F.col("weights_revision").eqNullSafe(F.lit(revision)))
    return stale.join(vectors.select("doc_id").distinct(), "doc_id", "left_semi")


def integrity_problems(documents: DataFrame, sections: DataFrame, passages: DataFrame, section_vectors: DataFrame, dim: int) -> DataFrame:
    """(problem, id): children without parents, passages without a section vector and the reverse, vectors of another width."""
    parts = [
        sections.join(documents, "doc_id", "left_anti").select(F.lit("section without document").alias("problem"), F.col("section_id").alias("id")),
        passages.join(sections, "section_id", "left_anti").select(F.lit("passage without section").alias("problem"), F.col("section_id").alias("id")),
        passages.select("section_id").distinct().join(section_vectors, "section_id", "left_anti").select(F.lit("section without vector").alias("problem"), F.col("section_id").alias("id")),
        section_vectors.join(passages, "section_id", "left_anti").select(F.lit("vector without passages").alias("problem"), F.col("section_id").alias("id")),
        section_vectors.filter(F.size("embedding") != dim).select(F.lit("vector of another width").alias("problem"), F.col("section_id").alias("id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verdict(indexed: Column, failed: Column, stale: Column, verified: Column) -> Column:
    """What a status says first: nothing is indexed, files failed, files are stale, coverage was never verified, or all is well."""
    return F.when(indexed == 0, "empty").when(failed > 0, "failures").when(stale > 0, "stale").when(~F.coalesce(verified, F.lit(False)), "unverified").otherwise("complete")


def restated(old: DataFrame, now: DataFrame, unreachable: list[str]) -> DataFrame:
    """Failures (file_path, message) after a run: what it met ``now``, and of the ``old`` ones those below folders that it could not reach."""
    below = F.lit(False)
    for prefix in unreachable:
        below |= F.col("file_path").startswith(prefix.rstrip("/") + "/")
    return now.unionByName(old.filter(below).join(now.select("file_path"), "file_path", "left_anti").select(*now.columns))


def swapped(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``table`` with ``column`` of ``changes`` (key, seen, column) where it is still what was seen, nulls included; and whether it was."""
    new = changes.select(key, F.col("seen"), F.col(column).alias("_new"), F.lit(True).alias("_asked"))
    fits = F.coalesce(F.col("_asked") & F.col("seen").eqNullSafe(F.col(column)), F.lit(False))
    both = table.join(new, key, "left").withColumn("swapped", fits)
    return both.select(*[F.when(F.col("swapped"), F.col("_new")).otherwise(F.col(column)).alias(column) if c == column else F.col(c) for c in table.columns], "swapped")


def freshness(old: DataFrame, new: DataFrame, key: str, digest: Column) -> DataFrame:
    """(key, state) of files as they are against as they were (key, length, mtime, digest): new, vanished, same, touched or changed.

    ``digest`` reads a file of ``new``; it stands behind the comparison of times and lengths and is evaluated for files
    that moved only.
    """
    joined = old.select(key, F.col("length").alias("_length"), F.col("mtime").alias("_mtime"), F.col("digest").alias("_digest"), F.lit(True).alias("_was")).join(new.withColumn("_is", F.lit(True)), key, "full_outer")
    still = (F.col("_length") == F.col("length")) & (F.col("_mtime") == F.col("mtime"))
    state = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "vanished").when(still, "same").when(F.col("_digest") == digest, "touched").otherwise("changed")
    return joined.select(key, state.alias("state"))


def weights_state(documents: DataFrame, vectors: DataFrame, revision: str, *by: str) -> DataFrame:
    """Whether the vectors of each group of documents (doc_id, weights_revision) are certified for ``revision``, revoked as others made some, or forgotten as there are none."""
    held = documents.join(vectors.select("doc_id").distinct().withColumn("_held", F.lit(True)), "doc_id", "left")
    counts = held.groupBy(*by).agg(F.count("_held").alias("vectors"), F.count_if(F.col("_held") & ~F.col("weights_revision").eqNullSafe(F.lit(revision))).alias("others"))
    return counts.select(*by, F.when(F.col("vectors") == 0, "forgotten").when(F.col("others") > 0, "revoked").otherwise("certified").alias("weights"))


def placed(rows: DataFrame, order: list[Column], column: str) -> DataFrame:
    """Places from 0 in a global order: rows are dealt by ranges and counted there, and only the counts meet in one place."""
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    parted = kept(parted)  # both uses below must see the same partitions
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return parted.join(starts, "_part").withColumn(column, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def numbered(rows: DataFrame, order: list[Column], high_water: int, column: str = "section_id") -> DataFrame:
    """Ids above ``high_water`` in the given order, so that no id is ever used twice."""
    return placed(rows, order, "_place").withColumn(column, F.lit(high_water + 1) + F.col("_place")).drop("_place")
