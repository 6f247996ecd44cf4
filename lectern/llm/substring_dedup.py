"""Substring dedup: words in windows that an earlier document holds, too, are removed.

Count-min prefilter: each task sketches its windows, the merged sketch overestimates their counts, and a second
pass groups exactly those windows that it holds for repeated, by 128 bits. A task settles repeats between its own
documents itself, so that of a passage that is everywhere each task sends on one copy.

The sketch is one row of 2 ** 36 counters in parts of fixed width, each added up by itself. A task sends on the
counters that it touched, about a byte each, so the sketch that is shuffled follows the input, while what a merging
task holds and the filter that comes of it do not. Its error, the chance that another window shares a counter, is the
number of windows over the number of counters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import PARTIAL, Counted, Hashes, cut, hashed_words, id_key, merged_filter, mixed, partial_sketch, raw, release, slices, window_hashes, window_starts

WIDTH = 13
FLUSH = 2_000_000
#: Windows that a confirming task compares at once. Of an anchor with more, what is left of each lot goes on by itself.
COMPARED = 1_000_000
#: Words of one anchor's window; a window's anchor is the least hash of so many words in it.
ANCHOR = 5
#: A run of windows with one anchor: a row, the first window's place, pairs of hashes. With no hashes, removed windows.
RUNS = "part long, key long, row long, start long, n long, hashes binary"
#: Removed windows, or with hashes one window that is to be compared again.
CONFIRMED = "key long, row long, start long, n long, high long, low long"
RESULT = "doc_id long, text string, n_words long, n_removed long, kept_sha256 string"


def _second_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Further 64 bits of the windows at ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= np.uint64(0xC2B2AE3D27D4EB4F)
            out += words[starts + i]
    return mixed(out, 29)


def _anchors(words: np.ndarray, width: int) -> np.ndarray:
    """The least hash of a few words in each window: equal windows have equal anchors, and neighbours mostly so."""
    small = window_hashes(words, min(ANCHOR, width))
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = small[:n].copy()
    for i in range(1, width - min(ANCHOR, width) + 1):
        np.minimum(out, small[i : i + n], out=out)
    return out


def _runs(row: np.ndarray, at: np.ndarray, anchor: np.ndarray | None = None) -> np.ndarray:
    """Where runs of neighbouring windows of one row and anchor begin."""
    if not len(row):
        return np.zeros(0, np.int64)
    new = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    return np.flatnonzero(np.concatenate(([True], new if anchor is None else new | (anchor[1:] != anchor[:-1]))))


def _least_elsewhere(high: np.ndarray, low: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each window, the least key among all windows of its two hashes."""
    order = np.argsort(high, kind="stable")
    first, second = high[order], low[order]
    edges = first[1:] != first[:-1]
    if (~edges & (second[1:] != second[:-1])).any():
        order = np.lexsort((low, high))
        first, second = high[order], low[order]
        edges = first[1:] != first[:-1]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(first)), bool), edges | (second[1:] != second[:-1]))))
    least = np.empty(len(keys), np.int64)
    if len(starts):
        least[order] = np.repeat(np.minimum.reduceat(keys[order], starts), np.diff(np.append(starts, len(first))))
    return least


def _removed(key: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Removed windows as runs: keys, rows, starts, lengths."""
    order = np.lexsort((at, row, key))
    key, row, at = key[order], row[order], at[order]
    starts = _runs(row, at)
    return key[starts], row[starts], at[starts], np.diff(np.append(starts, len(key)))


def drop_repeated_substrings(docs: DataFrame, width: int = WIDTH, compared: int = COMPARED) -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts in a document of a smaller doc_id.

    ``docs`` has doc_id and text; nothing else is read. Windows are judged on the input, not on what is left.
    Returns a row for each input row: doc_id, text (kept words joined by one space), n_words, n_removed,
    kept_sha256.

    Null and empty texts, and those of fewer words than a window, stay as they are. Repeats within one document
    stay. A null id counts as the smallest. Rows that share an id are one document, so a window removes nothing from
    rows of its own id; each loses what its own text has of earlier documents. An empty table gives an empty result.
    ``compared`` bounds the windows that a task compares at once; the result is the same for any.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(id_key().alias("key"), F.xxhash64(text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = Hashes(), [], 0
        for part in slices(batches):
            words, offsets = hashed_words(raw(part.column("text")), hashes)
            held.append(window_hashes(words, width)[window_starts(offsets, width)[0]])
            n += len(held[-1])
            if n >= FLUSH:
                yield partial_sketch(np.concatenate(held))
                held, n = [], 0
        if n:
            yield partial_sketch(np.concatenate(held))

    repeated = spark.sparkContext.broadcast(merged_filter(rows.select("text").mapInArrow(count, PARTIAL), Counted))
    names = ["part", "key", "row", "start", "n", "hashes"]

    def settle(key: np.ndarray, row: np.ndarray, at: np.ndarray, high: np.ndarray, low: np.ndarray, anchor: np.ndarray) -> Iterator[pa.RecordBatch]:
        gone = _least_elsewhere(high, low, key) < key
        if gone.any():
            done = _removed(key[gone], row[gone], at[gone])
            yield pa.record_batch([pa.array(x) for x in (done[1], *done)] + [pa.array([b""] * len(done[0]), pa.binary())], names=names)
        key, row, at, high, low, anchor = (x[~gone] for x in (key, row, at, high, low, anchor))
        starts = _runs(row, at, anchor)
        ends = np.append(starts[1:], len(key))
        pairs = np.stack((high, low), 1)
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(key)) * 16).astype(np.int64)), pa.py_buffer(pairs.tobytes())]).cast(pa.binary())
        yield pa.record_batch([pa.array(anchor[starts].view(np.int64)), pa.array(key[starts]), pa.array(row[starts]), pa.array(at[starts]), pa.array(ends - starts), data], names=names)

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = Hashes(), [], 0
        for part in slices(batches):
            words, offsets = hashed_words(raw(part.column("text")), hashes)
            starts, owner = window_starts(offsets, width)
            found = window_hashes(words, width)[starts]
            maybe = repeated.value.has(found)
            starts, owner, found = starts[maybe], owner[maybe], found[maybe]
            anchor = _anchors(words, width)[starts]
            key, row = (np.asarray(part.column(c)).astype(np.int64)[owner] for c in ("key", "row"))
            held.append((key, row, starts - offsets[owner], found, _second_hashes(words, starts, width), anchor))
            n += len(found)
            if n >= FLUSH // 2:
                yield from settle(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from settle(*map(np.concatenate, zip(*held, strict=True)))

    def spread(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """A row for each window: anchor, key, row, place, both hashes."""
        part, key, row, start, n = (np.asarray(batch.column(c)).astype(np.int64) for c in names[:-1])
        pairs = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64).reshape(-1, 2)
        place = np.arange(len(pairs)) + np.repeat(start - (np.cumsum(n) - n), n)
        return np.repeat(part, n), np.repeat(key, n), np.repeat(row, n), place, pairs[:, 0], pairs[:, 1]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All windows of an anchor come one after another; whole anchors are compared at once."""
        held: list[tuple[np.ndarray, ...]] = []
        n, crowded = 0, None

        def answer(key, row, at, n, high=None, low=None) -> pa.RecordBatch:
            hashes = [pa.nulls(len(key), pa.int64())] * 2 if high is None else [pa.array(h.view(np.int64)) for h in (high, low)]
            return pa.record_batch([*map(pa.array, (key, row, at, n)), *hashes], names=["key", "row", "start", "n", "high", "low"])

        def compare(_, key, row, at, high, low, whole: bool) -> Iterator[pa.RecordBatch]:
            gone = _least_elsewhere(high, low, key) < key
            if gone.any():
                yield answer(*_removed(key[gone], row[gone], at[gone]))
            if not whole and not gone.all():
                key, row, at, high, low = (np.ascontiguousarray(x[~gone]) for x in (key, row, at, high, low))
                yield answer(key, row, at, np.ones(len(key), np.int64), high, low)

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, crowded
            if not held:
                return
            every = tuple(map(np.concatenate, zip(*held, strict=True)))
            parts = every[0]
            if crowded is not None:
                own = parts == crowded
                if own.any():
                    yield from compare(*(x[own] for x in every), whole=False)
                    every = tuple(x[~own] for x in every)
                    parts = every[0]
                crowded = crowded if own.all() else None
            tail = np.zeros(len(parts), bool) if final or not len(parts) else parts == parts[-1]
            if len(parts) and tail.all():
                crowded = int(parts[-1])
                yield from compare(*every, whole=False)
                held, n = [], 0
                return
            if not tail.all():
                yield from compare(*(x[~tail] for x in every), whole=True)
            held = [tuple(x[tail] for x in every)] if tail.any() else []
            n = int(tail.sum())

        for batch in batches:
            settled = np.asarray(pc.equal(pc.binary_length(batch.column("hashes")), 0), bool)
            if settled.any():
                done = batch.filter(pa.array(settled))
                yield answer(*(np.asarray(done.column(c)).astype(np.int64) for c in ("key", "row", "start", "n")))
            if not settled.all():
                held.append(spread(batch.filter(pa.array(~settled))))
                n += len(held[-1][0])
                if n >= compared:
                    yield from flush(False)
        yield from flush(True)
        release()

    runs = rows.select("key", "row", "text").mapInArrow(suspected, RUNS)
    confirmed = cut(runs.repartition("part").sortWithinPartitions("part").mapInArrow(confirm, CONFIRMED))
    # Of crowded anchors each lot left one document a window: as many rows of a window as there were lots.
    rest = confirmed.filter("high IS NOT NULL")
    least = rest.groupBy("high", "low").agg(F.min("key").alias("least"))
    late = rest.join(least, ["high", "low"]).filter("least < key").select("key", "row", "start", "n")
    gone = confirmed.filter("high IS NULL").select("key", "row", "start", "n").unionByName(late)
    # Cut off, so that the join is one of two plain shuffles and a text that is everywhere is split.
    gone = cut(gone.groupBy("key", "row").agg(F.collect_set(F.struct("start", "n")).alias("gone")))
    joined = rows.join(gone, ["key", "row"], "left").select("doc_id", "text", "gone")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text, spans in zip(part.column("doc_id").to_pylist(), raw(part.column("text")), part.column("gone"), strict=True):
                words = (text or b"").split()
                total = len(words)
                if spans.is_valid:
                    starts = np.asarray(spans.values.field("start"), np.int64)
                    stops = np.minimum(starts + np.asarray(spans.values.field("n"), np.int64) + width - 1, total)
                    edges = np.zeros(total + 1, np.int64)
                    inside = starts < total
                    np.add.at(edges, starts[inside], 1)
                    np.add.at(edges, stops[inside], -1)
                    keep = np.cumsum(edges[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                kept = b" ".join(words)
                for column, value in zip(out, (doc, kept.decode("utf-8", "replace"), total, total - len(words), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())], names=["doc_id", "text", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(rewrite, RESULT)
