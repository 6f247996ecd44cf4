"""The vector lane: exact nearest neighbours, passages to sections, fusion, pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.vectors import bucket, cosine_distance, degenerate, norm, usable
from lectern.schema import LIMIT_MOST, RRF_K


def hashed_embeddings(texts: DataFrame, dim: int = 64) -> DataFrame:
    """(owner_id, embedding) of (owner_id, text), a deterministic embedding: each word adds 1 at its bucket, scaled to 1.

    A text without words is the first axis. Words are counted before they are shuffled, so a text sends on ``dim``
    rows at most.
    """
    words = texts.select("owner_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    counts = words.groupBy("owner_id", bucket(F.col("word"), dim).cast("int").alias("at")).agg(F.count("*").cast("double").alias("n"))
    held = counts.groupBy("owner_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("counts"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    axes = F.sequence(F.lit(0), F.lit(dim - 1))
    vector = F.transform(axes, lambda i: F.coalesce(F.element_at("counts", i), F.lit(0.0)) / F.col("norm"))
    first = F.transform(axes, lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    return texts.select("owner_id").join(held, "owner_id", "left").select("owner_id", F.when(F.col("counts").isNull(), first).otherwise(vector).alias("embedding"))


#: Query vectors go to all tasks as one matrix of so many bytes at most; a larger batch is joined instead.
MOST_SENT = 32 << 20
#: Distances that a task holds at once, whatever the number of queries: 8 MB of them.
MOST_MEASURED = 1 << 20


def nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, owner_id, distance, rank) of the ``k`` nearest (owner_id, embedding) of each (query_id, embedding), ties whole.

    An exact scan: a task measures a batch of vectors against all queries by products of matrices, some queries at a
    time, and keeps each query's ``k`` best of the batch, with ties, before anything is shuffled. Vectors that are not usable, or not of the
    queries' width, are left out. A filter of the scope belongs on ``vectors``, before ranks are taken.
    """
    asked = queries.select("query_id", "embedding")
    sent = asked.limit(MOST_SENT // 512 + 1).toArrow()
    width = len(sent["embedding"][0]) if sent.num_rows else 0
    owned = vectors.filter(usable(F.col("embedding")) & (F.size("embedding") == width)).select("owner_id", "embedding")
    if sent.num_rows * max(width, 64) * 8 <= MOST_SENT and all(len(x) == width for x in sent["embedding"]):
        measured = _measured(owned, sent, k, digits)
    else:
        pairs = owned.crossJoin(asked.withColumnRenamed("embedding", "asked"))
        measured = pairs.select("query_id", "owner_id", F.round(cosine_distance(F.col("embedding"), F.col("asked")), digits).alias("distance"))
    return measured.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy("distance"))).filter(F.col("rank") <= k)


def _measured(vectors: DataFrame, sent: pa.Table, k: int, digits: int) -> DataFrame:
    """Distances of each batch's best vectors to the queries that were ``sent``."""
    ids = sent["query_id"].combine_chunks()
    most = MOST_MEASURED
    wanted = np.asarray(sent["embedding"].combine_chunks().flatten(), np.float64).reshape(len(ids), -1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.linalg.norm(wanted, axis=1)
        bounds = np.full((len(wanted), 1), np.inf)  # k vectors of this task are no farther than that from each query
        for batch in batches:
            for part in (batch.slice(i, 16384) for i in range(0, batch.num_rows, 16384)):
                own = np.asarray(part.column("embedding").flatten(), np.float64).reshape(part.num_rows, -1)
                lengths = np.linalg.norm(own, axis=1)
                step = max(1, most // part.num_rows)
                for lo in range(0, len(wanted), step):
                    with np.errstate(invalid="ignore", divide="ignore"):
                        distance = np.round(1 - wanted[lo : lo + step] @ own.T / np.outer(sizes[lo : lo + step], lengths), digits) + 0.0
                    if part.num_rows > k:
                        worst = np.minimum(np.partition(distance, k - 1, axis=1)[:, k - 1 : k], bounds[lo : lo + step])
                        bounds[lo : lo + step] = worst
                        query, at = np.nonzero(distance <= worst)
                    else:
                        query, at = np.nonzero(np.isfinite(distance))
                    yield pa.record_batch([ids.take(pa.array(query + lo)), part.column("owner_id").take(pa.array(at)), pa.array(distance[query, at])], names=["query_id", "owner_id", "distance"])

    owner = vectors.schema["owner_id"].dataType.simpleString()
    kind = "string" if pa.types.is_string(ids.type) else "int" if ids.type == pa.int32() else "bigint"
    return vectors.mapInArrow(measure, f"query_id {kind}, owner_id {owner}, distance double")


def max_similarity(section_hits: DataFrame, passage_hits: DataFrame) -> DataFrame:
    """(query_id, section_id, distance, ordinal): the least distance of a section or of any passage found in it, and the passage.

    ``section_hits`` has (query_id, section_id, distance), ``passage_hits`` (query_id, section_id, ordinal, distance).
    """
    best = passage_hits.groupBy("query_id", "section_id").agg(F.min(F.struct("distance", "ordinal")).alias("best"))
    joined = section_hits.select("query_id", "section_id", "distance").join(best, ["query_id", "section_id"], "full_outer")
    return joined.select("query_id", "section_id", F.least("distance", "best.distance").alias("distance"), F.col("best.ordinal").alias("ordinal"))


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, item, position): (query_id, item, score), rounded to 9 digits."""
    return rankings.groupBy("query_id", "item").agg(F.round(F.sum(1.0 / (k + F.col("position"))), 9).alias("score"))


def page(fused: DataFrame, sections: DataFrame, limit: int) -> DataFrame:
    """The first rows of each query with their texts, joined last so that ranking never reads them."""
    limit = max(1, min(limit, LIMIT_MOST))
    ranked = fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item"))).filter(F.col("position") <= limit)
    return ranked.join(sections.withColumnRenamed("section_id", "item"), "item")


def pooled(passages: DataFrame) -> DataFrame:
    """(owner_id, embedding): the mean of each owner's vectors, scaled to 1; the first vector where they cancel out.

    ``passages`` has (owner_id, ordinal, embedding). Sums are exact, in decimals, so that they do not depend on the order in
    which parts meet, and taken place by place, so partial sums are as many
    as owners and dimensions, however many vectors one owner has.
    """
    spread = passages.select("owner_id", F.posexplode("embedding").alias("at", "x"))
    means = spread.groupBy("owner_id", "at").agg((F.sum(F.col("x").cast("double").cast("decimal(38,18)")).cast("double") / F.count("*")).alias("mean"))
    vectors = means.groupBy("owner_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "mean"))), lambda s: s["mean"]).alias("mean"))
    first = passages.groupBy("owner_id").agg(F.min_by("embedding", "ordinal").alias("first"))
    joined = vectors.join(first, "owner_id")
    chosen = F.when(degenerate(F.col("mean")), F.transform("first", lambda x: x.cast("double"))).otherwise(F.transform("mean", lambda x: x / norm(F.col("mean"))))
    return joined.select("owner_id", chosen.alias("embedding"))
