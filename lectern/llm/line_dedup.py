"""Line dedup: lines that recur in several documents go, except in one of them.

Two Bloom filters of fixed size hold the hashes seen once and seen twice; they are built in parts, from what each
task sends on of its own: the places that its distinct lines touch, about 2 bytes each. Lines themselves, as digests,
are shuffled only where the second filter suspects them, for exact counts and the choice of the document that keeps
the line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import PARTIAL, OnceTwice, cut, id_key, merged_filter, partial_sketch, raw, slices

SPACE = b" \t\n\x0b\x0c\r"
#: A task sends on its part of the sketch after so many hashes at the latest.
FLUSH = 4_000_000
RESULT = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """The line without white space at its ends and with A-Z in lower case; None if that is too short."""
    key = line.strip(SPACE).lower()
    if len(key) < least_chars or not key.isascii() and sum(b & 0xC0 != 0x80 for b in key) < least_chars:
        return None
    return key


def keys_of(text: bytes | None, least_chars: int) -> dict[bytes, bytes]:
    """Digest by distinct key of a text's lines."""
    return {key: xxhash.xxh3_128_digest(key) for line in (text or b"").split(b"\n") if (key := line_key(line, least_chars)) is not None}


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """Drop lines found in ``least_docs`` documents or more, except in the largest doc_id that holds them.

    ``docs`` has doc_id and text; other columns are not read, whatever their names. Returns one row for each
    input row: doc_id, text (the lines kept), n_lines, n_dropped, kept_sha256.

    A null or empty text is one empty line. A row is a document; rows that share an id keep or lose a line
    together, and a null id counts as the smallest. Lines count once in a document and all their places in it
    stay or go. An empty table gives an empty result.
    """
    if least_docs < 2:
        raise ValueError("a repeated line is in 2 documents at least")
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(id_key().alias("key"), F.xxhash64(text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in slices(batches):
            digests = [d for t in raw(part.column("text")) for d in keys_of(t, least_chars).values()]
            if digests:
                held.append(_halves(digests)[0])
            if sum(map(len, held)) >= FLUSH:
                yield partial_sketch(np.concatenate(held))
                held = []
        if held:
            yield partial_sketch(np.concatenate(held))

    suspected = spark.sparkContext.broadcast(merged_filter(rows.select("text").mapInArrow(count, PARTIAL), OnceTwice))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, digests = [], []
            for text in raw(part.column("text")):
                own = list(keys_of(text, least_chars).values())
                digests += own
                counts.append(len(own))
            if digests:
                high, low = _halves(digests)
                maybe = suspected.value.has(high)
                owner = np.repeat(np.arange(part.num_rows), counts)[maybe]
                yield pa.record_batch([pa.array(high[maybe].view(np.int64)), pa.array(low[maybe].view(np.int64)), *(pa.array(np.asarray(part.column(c)).astype(np.int64)[owner]) for c in ("key", "row"))], names=["high", "low", "key", "row"])

    # Cut off: suspected lines are few, and are read twice. The join below is then one of two plain shuffles, and a line
    # that is everywhere is split by adaptive execution.
    found = cut(rows.select("key", "row", "text").mapInArrow(places, "high long, low long, key long, row long"))
    confirmed = cut(found.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("key").alias("keeper")).filter(F.col("n") >= least_docs))
    lost = found.join(confirmed, ["high", "low"]).filter(F.col("key") < F.col("keeper")).select("key", "row", "high", "low")
    # By id and text, so that what is collected is never more than one text's lines; cut off, so that a text that is
    # everywhere is split, too.
    lost = cut(lost.groupBy("key", "row").agg(F.collect_set(F.struct("high", "low")).alias("lost")))
    joined = rows.join(lost, ["key", "row"], "left").select("doc_id", "text", "lost")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text, gone in zip(part.column("doc_id").to_pylist(), raw(part.column("text")), part.column("lost").to_pylist(), strict=True):
                lines = kept = (text or b"").split(b"\n")
                if gone:
                    digests = {x["high"].to_bytes(8, "big", signed=True) + x["low"].to_bytes(8, "big", signed=True) for x in gone}
                    kept = [x for x in lines if (key := line_key(x, least_chars)) is None or xxhash.xxh3_128_digest(key) not in digests]
                whole = b"\n".join(kept)
                for column, value in zip(out, (doc, whole.decode("utf-8", "replace"), len(lines), len(lines) - len(kept), hashlib.sha256(whole).hexdigest()), strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())], names=["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(rewrite, RESULT)
