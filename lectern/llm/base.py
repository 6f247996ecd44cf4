"""Helpers that the text operators share: shared storage, text slices, word hashes and sparse sketches."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regex of a word, and the white space that separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: A slice of rows that one vectorised step works on holds about so many bytes of text.
SLICE_BYTES = 2 << 20
#: Words that a worker remembers the hash of.
REMEMBERED_WORDS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one that was set as checkpoint folder before.

    Only where the master is local, so that there is no other machine, a temporary one stands in for it.
    """
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir")
    if there:
        return there
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def id_key(name: str = "doc_id") -> Column:
    """An id as a sortable long; a null id counts as the smallest."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)))


def release() -> None:
    """Give freed memory back to the system, so that a worker that is used again starts small."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(library := ctypes.CDLL(libc), "malloc_trim"):
        library.malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows holding about ``most`` bytes in ``column``; a longer row stands alone."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def list_slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` items in a list column; a longer list stands alone."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(column)), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def hashed_words(texts: list[bytes | None], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words start (one more offset at the end)."""
    words = [(t or b"").split() for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    found = np.fromiter((hashes[w] for own in words for w in own), np.uint64, int(offsets[-1]))
    return found, offsets


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))).astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on; the last width - 1 positions have none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= np.uint64(0x9DDFEA08EB382D69)
            out += words[i : i + n]
    return mixed(out)


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of one text starts, and the index of that text."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[:-1][owner] + within, owner


def _packed(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ascending non-negative integers, one after another, each as variable-length differences: bytes, and where each list's begin."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    gaps[starts] = values[starts]
    sizes = np.ones(len(gaps), np.int64)
    for bits in range(7, 64, 7):
        sizes += gaps >= np.uint64(1) << np.uint64(bits)
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for i in range(int(sizes.max(initial=0))):
        own = sizes > i
        out[at[own] + i] = (gaps[own] >> np.uint64(7 * i)).astype(np.uint8) & 127 | (sizes[own] > i + 1).astype(np.uint8) << 7
    return out, at[starts]


def unpacked(blob: bytes) -> np.ndarray:
    """The values of one list of ``_packed``."""
    data = np.frombuffer(blob, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], data[:-1] < 128)))
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    return np.cumsum(np.add.reduceat((data & 127).astype(np.uint64) << (place * 7).astype(np.uint64), first))


#: A sketch has 2 ** CELL_BITS counters in CHUNKS parts: a part, 2 ** 25 counters, is merged by itself, so that a
#: merging task's memory is fixed whatever the input.
CELL_BITS, CHUNKS = 36, 1 << 11
#: Counters of a part that are sorted at once; more of them are added to a table of the whole part.
SORTED_CELLS = 2_000_000
PARTIAL = "chunk int, cells binary"
#: A filter that goes to all executors has so many bits at most (64 MB), and so many from each part.
FILTER_BITS = 1 << 29
CHUNK_BITS = FILTER_BITS // CHUNKS


def partial_sketch(hashes: np.ndarray) -> pa.RecordBatch:
    """One task's counters above 0, by chunk: ascending, those of 2 or more twice. Schema PARTIAL.

    Only touched counters are sent on, about 2 bytes each, so that what is shuffled follows the input
    whatever the number of tasks.
    """
    cells = hashes >> np.uint64(64 - CELL_BITS)
    # A chunk is a run of neighbouring counters, so that one sort serves all chunks.
    cells.sort()
    if len(cells):
        same = np.concatenate(([False], cells[1:] == cells[:-1]))
        cells = cells[~(same & np.concatenate(([False], same[:-1])))]
    width = np.uint64((1 << CELL_BITS) // CHUNKS)
    chunk = cells // width
    starts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))) if len(chunk) else np.zeros(0, np.int64)
    data, at = _packed(cells % width, starts)
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
    return pa.record_batch([pa.array(chunk[starts].astype(np.int32)), blobs], names=["chunk", "cells"])


def bit_places(cells: np.ndarray, bits: int | np.ndarray) -> list[np.ndarray]:
    """The places of each counter in a Bloom filter of so many bits (powers of 2)."""
    mask = np.asarray(bits, np.uint64) - np.uint64(1)
    x, y = mixed(cells, 7), mixed(cells, 11)
    return [(x & mask).astype(np.int64), (y & mask).astype(np.int64), ((x >> np.uint64(33)) + (y >> np.uint64(31)) & mask).astype(np.int64)]


class Bits:
    """A Bloom filter."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(bits, bool)

    def add(self, cells: np.ndarray) -> None:
        for at in bit_places(cells, self.bits):
            self.table[at] = True

    def has(self, cells: np.ndarray) -> np.ndarray:
        first, second, third = bit_places(cells, self.bits)
        return self.table[first] & self.table[second] & self.table[third]

    def folded(self) -> Bits:
        """The same filter with the fewest bits that keep it less than a sixth full: places are the last bits of hashes, so halves are laid over each other."""
        small = Bits(self.bits)
        small.table = self.table
        while small.bits > 64 and (half := small.table[: small.bits // 2] | small.table[small.bits // 2 :]).mean() < 1 / 6:
            small.bits, small.table = small.bits // 2, half
        return small


class Once:
    """The counters of a part that were touched at all, in a Bloom filter of fixed size."""

    def __init__(self) -> None:
        self.found = Bits(CHUNK_BITS)

    def add(self, cells: np.ndarray) -> None:
        self.found.add(cells)

    def made(self) -> Bits:
        return self.found.folded()


class OnceTwice:
    """Two Bloom filters of a part, both of fixed size: what meets itself in the once-seen filter goes to the twice-seen one."""

    def __init__(self) -> None:
        self.once, self.twice = Bits(1 << 21), Bits(CHUNK_BITS)

    def add(self, cells: np.ndarray) -> None:
        again = np.concatenate(([False], cells[1:] == cells[:-1])) if len(cells) else np.zeros(0, bool)
        self.twice.add(cells[again])
        cells = cells[~again]
        self.twice.add(cells[self.once.has(cells)])
        self.once.add(cells)

    def made(self) -> Bits:
        return self.twice.folded()


class Counted:
    """Count-min: the counters of a part, added up to 2. Few are kept as a list, more in a table of the part's whole width."""

    def __init__(self) -> None:
        self.held, self.n, self.table = [], 0, None

    def add(self, cells: np.ndarray) -> None:
        self.held.append(cells)
        self.n += len(cells)
        if self.n > SORTED_CELLS:
            self._settle()

    def _settle(self) -> None:
        if self.table is None:
            self.table = np.zeros((1 << CELL_BITS) // CHUNKS, np.uint8)
        for cells in self.held:
            again = np.concatenate(([False], cells[1:] == cells[:-1]))
            at = cells.astype(np.int64)
            self.table[at[~again]] = np.minimum(self.table[at[~again]] + 1, 2)
            self.table[at[again]] = 2
        self.held, self.n = [], 0

    def made(self) -> Bits:
        bits = Bits(CHUNK_BITS)
        if self.table is not None:
            self._settle()
            bits.add(np.flatnonzero(self.table == 2).astype(np.uint64))
        else:
            cells = np.sort(np.concatenate(self.held))
            bits.add(np.unique(cells[1:][cells[1:] == cells[:-1]]))
        return bits.folded()


class Filter:
    """Bloom filters of all parts, as one table that is broadcast: FILTER_BITS bits at most."""

    def __init__(self, rows: list):
        sizes = np.full(CHUNKS, 64, np.int64)
        for row in rows:
            sizes[row["chunk"]] = len(row["bits"]) * 8
        self.sizes = sizes.astype(np.uint64)
        self.starts = np.cumsum(sizes // 8) - sizes // 8
        self.table = np.zeros(int(sizes.sum()) // 8, np.uint8)
        for row in rows:
            at = self.starts[row["chunk"]]
            self.table[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cells = hashes >> np.uint64(64 - CELL_BITS)
        width = np.uint64((1 << CELL_BITS) // CHUNKS)
        chunk = (cells // width).astype(np.int64)
        rest, base = cells % width, self.starts[chunk]
        found = np.ones(len(hashes), bool)
        for at in bit_places(rest, self.sizes[chunk]):
            found &= (self.table[base + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return found


def merged_filter(partial: DataFrame, kind: Callable[[], Once | OnceTwice | Counted]) -> Filter:
    """The filter that ``kind`` makes of each part's partial sketches. A task meets its parts one after another and holds one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([np.packbits(own.made().table).tobytes()], pa.binary())], names=["chunk", "bits"])

        for batch in batches:
            for chunk, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells"), strict=True):
                if chunk != at:
                    if own is not None:
                        yield done()
                    at, own = chunk, kind()
                own.add(unpacked(cells.as_py()))
        if own is not None:
            yield done()
        release()

    return Filter(partial.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary").collect())
