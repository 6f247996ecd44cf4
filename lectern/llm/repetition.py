"""Quality rules on repetition: maximal repeated substrings of words, from suffix arrays.

Texts are taken a slice at a time, so that one vectorised suffix array over (text, words) serves thousands of
short texts or one long one. A suffix's longest repeat is the deeper of the two longest-common-prefix intervals
that meet at it; the union of these repeats is the union of all maximal repeats' occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import Hashes, hashed_words, raw, slices

SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
FIELDS = [("doc_id", "long", pa.int64()), ("n_words", "long", pa.int64()), ("word_chars", "long", pa.int64()), ("n_symbols", "long", pa.int64()), ("n_dup_lines", "long", pa.int64()), ("n_repeat_words", "long", pa.int64()), ("base_failed", "boolean", pa.bool_()), ("kept", "boolean", pa.bool_()), ("covered", "long", pa.int64()), ("longest_repeat", "long", pa.int64()), ("repeats", "array<struct<start:long,stop:long>>", SPANS)]


def _changes(values: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))


def longest_repeats(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word, the longest run of words from it on that its text has from another word on, too.

    The suffix array is made by prefix doubling; a rank is the number of smaller suffixes, and each round ranks
    again only those that share theirs. The ranks of all rounds give the common prefix of neighbours.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = offsets[1:][owner]
    codes = np.unique(words, return_inverse=True)[1]
    keys, active = owner * np.int64(n) + codes, np.arange(n)
    rank, levels, width = np.zeros(n, np.int64), [], 1
    while True:
        order = np.argsort(keys)
        active, keys = active[order], keys[order]
        at = np.arange(len(active))
        first = _changes(keys)
        start = np.maximum.accumulate(np.where(first, at, 0))
        old = rank[active]
        group = np.maximum.accumulate(np.where(_changes(old), at, 0))
        rank = rank.copy()
        rank[active] = old + start - group
        levels.append(rank.astype(np.int32))
        shared = ~(first & np.concatenate((first[1:], [True])))
        active = active[shared]
        if not len(active):
            break
        beyond = active + width
        keys = rank[active] * np.int64(n + 1) + np.where(beyond < ends[active], rank[np.minimum(beyond, n - 1)] + 1, 0)
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < ends[a]) & (y < ends[b])
        ok &= levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
        common[ok] += 1 << k
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered_words(best: np.ndarray, least: int, at_most: int | None = None) -> np.ndarray:
    """Which words lie in a repeat of ``least`` words or more, or in its first ``at_most`` words."""
    at = np.arange(len(best))
    reach = np.where(best >= least, at + (best if at_most is None else np.minimum(best, at_most)), 0)
    return np.maximum.accumulate(reach) > at if len(best) else np.zeros(0, bool)


def repeated_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(SPACE):
            seen.add(line)
    return n


def repetition_rules(docs: DataFrame, least_words: int = 50, most_repeat_share: float = 0.5, least_repeat: int = 10, most_covered: float = 0.5, most_longest: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """Base measures and the verdict on repeated substrings of each text.

    ``docs`` has doc_id and text; nothing else is read. Returns a row for each input row: doc_id, n_words,
    word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line),
    n_repeat_words (words in 3-word windows that the text has twice), base_failed, kept, covered (words in
    repeats of ``least_repeat`` words or more), longest_repeat (in words) and repeats (their united spans).

    A text fails the base with fewer than ``least_words`` words, or when more than ``most_repeat_share`` of them
    are repeat words. Else it is kept if repeats cover ``most_covered`` of its words at most and none is longer
    than ``most_longest``. Null and empty texts have no words and fail. Rows that share an id are judged each on
    its own. Texts of any length are judged whole. Columns named in ``carry`` come along in a struct, ``row``.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for part in slices(batches):
            texts = [t or b"" for t in raw(part.column("text"))]
            words, offsets = hashed_words(texts, hashes)
            n = np.diff(offsets)
            best = longest_repeats(words, offsets)
            repeated = np.concatenate(([0], np.cumsum(covered_words(best, 3, 3))))
            repeat_words = repeated[offsets[1:]] - repeated[offsets[:-1]]
            inside = covered_words(best, least_repeat)
            total = np.concatenate(([0], np.cumsum(inside)))
            covered = total[offsets[1:]] - total[offsets[:-1]]
            longest = np.zeros(len(n), np.int64)
            longest[n > 0] = np.maximum.reduceat(best, offsets[:-1][n > 0]) if len(best) else 0
            chars = np.asarray(pc.fill_null(pc.utf8_length(part.column("text")), 0), np.int64) - np.array([len(t) - len(t.translate(None, SPACE)) for t in texts], np.int64)
            failed = (n < least_words) | (repeat_words > most_repeat_share * n)
            kept = ~failed & (covered <= most_covered * n) & (longest <= most_longest)
            owner = np.repeat(np.arange(len(n)), n)
            edge = np.ones(len(inside), bool)
            edge[1:] = (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])
            starts = np.flatnonzero(edge)
            stops = np.append(starts[1:], len(inside))
            own = inside[starts] if len(inside) else np.zeros(0, bool)
            starts, stops = starts[own], stops[own]
            whose = owner[starts]
            spans = pa.StructArray.from_arrays([pa.array(starts - offsets[whose]), pa.array(stops - offsets[whose])], names=["start", "stop"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(len(n) + 1)).astype(np.int32)), spans)
            columns = [part.column("doc_id"), n, chars, [len(t) - len(t.translate(None, SYMBOLS)) for t in texts], [repeated_lines(t) for t in texts], repeat_words, failed, kept, covered, longest, lists]
            made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, (_, _, t) in zip(columns, FIELDS, strict=True)]
            if carry:
                made.append(part.column("row"))
            yield pa.record_batch(made, names=[f[0] for f in FIELDS] + ["row"] * bool(carry))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.struct(*carry).alias("row")] * bool(carry))
    row = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    return rows.mapInArrow(judge, ", ".join(f"{name} {kind}" for name, kind, _ in FIELDS) + row)
