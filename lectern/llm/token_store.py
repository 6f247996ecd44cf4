"""Token ids on disk, compressed by Re-Pair grammars.

Documents stand in ascending doc_id order. A *shard* is a run of whole documents of about SHARD_TOKENS ids; it
is one row of a Parquet table and holds a grammar of its own::

    part int, seq int           place of the shard: range partition, then number within it
    docs list<long>             doc_ids, ascending
    starts list<int>            symbols before each document in the stream
    counts list<int>            ids of each document, with its end id
    rules binary                pairs of little-endian uint16; rule i makes the symbol first_rule + i
    spans binary                little-endian uint16 a rule: ids that it expands to
    symbols binary              the stream, little-endian uint16
    first_rule int

A symbol never crosses the end of a document, so any document is decoded from its own slice of the stream and
the shard's rules. Expansion lengths let a reader skip to the n-th id without decoding what stands before.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.base import mixed, shared_dir, slices

SHARD_TOKENS = 1 << 20
#: Rules that one round of counting and replacing makes at most, those of the most frequent pairs. Rounds end when no
#: pair is found twice, when no symbol is free, or when every pair found twice is too long for its length to be stored.
RULES_A_ROUND = 5000
SYMBOLS = 1 << 16
#: Words whose ids a worker remembers.
REMEMBERED = 2_000_000
#: White space in the widest sense, two in a row or at an end: the words of such texts are not encoded one by one.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
APART = rf"{SPACE}{SPACE}|\A{SPACE}|{SPACE}\z"
# The pieces that byte-level BPE cuts a text into before it merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The last character of the scripts that are spelled here, and what stands between pieces meanwhile.
SPELLED, BETWEEN = 0x24F, "\uffff"


def _byte_alphabet() -> dict[int, str]:
    """Characters that stand for bytes: printable ones for themselves, others from U+0100 on in their order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


SPELLING = {c: "".join(map(_byte_alphabet().__getitem__, chr(c).encode())) for c in range(SPELLED + 1)} | {ord(BETWEEN): " "}
SHARDS = "part int, seq int, docs array<long>, starts array<int>, counts array<int>, rules binary, spans binary, symbols binary, first_rule int"
ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("rules", pa.binary()), ("spans", pa.binary()), ("symbols", pa.binary()), ("first_rule", pa.int32())])


_RANDOM = np.random.default_rng(12).integers(0, 2**64, (2, 256), np.uint64)
_ODD = (np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F))


def digests_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two times 64 bits of each word: sums of random numbers for its bytes, times powers for their places. No word becomes a Python string."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    lengths = np.diff(offsets)
    out = (np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64))
    full = np.flatnonzero(lengths)
    if len(full):
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts = (offsets[:-1] - offsets[0])[full]
        place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths[full])
        with np.errstate(over="ignore"):
            for sums, table, odd in zip(out, _RANDOM, _ODD, strict=True):
                powers = np.cumprod(np.full(int(lengths.max()), odd, np.uint64))
                sums[full] = mixed(np.add.reduceat(table[data] * powers[place], starts) + lengths[full].astype(np.uint64))
    return out


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer always cuts before a single space that follows a character other than white space, so
    each space-led word has the same ids in any text: new words are encoded once, all in one string, and
    remembered. Texts with white space in a row, and tokenizers of other kinds, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = spec["model"]["vocab"]
        self.size = max([*vocabulary.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        # In a byte-level vocabulary U+0120 stands for a space.
        self.leads = np.zeros(self.size, bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        # The model alone, for text that is cut into pieces and spelled in the byte-level alphabet before.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        # Words met, as digests of 128 bits, ascending by the first half, with places in a stream of ids.
        self.digests, self.checks, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint16)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words led by a space, one after another, and where each word's begin (one more place at the end)."""
        text = "\n".join(words)
        if "\x00" in text or any(a in text for a in self.added):
            each = self.plain([" " + w for w in words])
            return np.concatenate(each).astype(np.uint16), np.concatenate(([0], np.cumsum([len(x) for x in each])))
        text = " " + " ".join(words)
        if max(text) <= chr(SPELLED):
            ids = np.array(self.model.encode_batch_fast([BETWEEN.join(PIECES.findall(text)).translate(SPELLING)], add_special_tokens=False)[0].ids, np.uint32)
        else:
            ids = self.plain([text])[0]
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != len(words):
            raise RuntimeError("a word's ids do not begin with a space")
        return ids.astype(np.uint16), np.append(starts, len(ids))

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A stream of ids, and each distinct word's place and number of ids in it. What was met before is remembered."""
        digests, checks = digests_of(words)
        place = np.searchsorted(self.digests, digests)
        place[place == len(self.digests)] = 0
        known = (self.digests[place] == digests) & (self.checks[place] == checks) if len(self.digests) else np.zeros(len(words), bool)
        at, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at[known], n[known] = self.at[place[known]], self.n[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            # Common scripts are spelled here, others by the library: words of either kind are learnt together.
            fresh = words.take(pa.array(new)).to_pylist()
            order = np.zeros(len(new), bool)
            if max("".join(fresh), default="") > chr(SPELLED):
                order[:] = [max(w, default="") > chr(SPELLED) for w in fresh]
            parts = [self.learn([fresh[i] for i in np.flatnonzero(own).tolist()]) for own in (~order, order) if own.any()]
            new = np.concatenate((new[~order], new[order]))
            ids = np.concatenate([x for x, _ in parts])
            bounds = np.concatenate([parts[0][1], *[b[1:] + len(parts[0][0]) for _, b in parts[1:]]])
            at[new], n[new] = bounds[:-1] + len(self.ids), np.diff(bounds)
            self.ids = np.concatenate((self.ids, ids))
            if len(self.digests) + len(new) <= REMEMBERED:
                # Merged into what is there, which is in order already.
                new = new[np.argsort(digests[new], kind="stable")]
                before = np.searchsorted(self.digests, digests[new])
                self.digests, self.checks = np.insert(self.digests, before, digests[new]), np.insert(self.checks, before, checks[new])
                self.at, self.n = np.insert(self.at, before, at[new].astype(np.uint32)), np.insert(self.n, before, n[new].astype(np.uint32))
        return self.ids, at, n

    def settle(self) -> None:
        """Forget ids of words that are not remembered."""
        self.ids = self.ids[: int((self.at + self.n).max(initial=0))]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none of a null."""
        texts = pc.fill_null(texts, "")
        if not self.by_word or self.size > SYMBOLS:
            return self.plain(texts.to_pylist())
        apart = pc.match_substring_regex(texts, pattern=APART)
        for token in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, pattern=token))
        apart = np.asarray(apart, bool)
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(apart)
        for i, ids in zip(np.flatnonzero(apart).tolist(), self.plain(texts.filter(pa.array(apart)).to_pylist()), strict=True):
            out[i] = ids.astype(np.uint16)
        split = pc.split_pattern(texts.filter(pa.array(~apart)), " ")
        starts = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        leading = np.zeros(int(starts[-1]), bool)
        leading[starts[:-1]] = True
        words = split.flatten()
        firsts = self.plain(words.filter(pa.array(leading)).to_pylist())
        coded = words.filter(pa.array(~leading)).dictionary_encode()
        flat, at, n = self.of_words(coded.dictionary)
        codes = np.asarray(coded.indices)
        n, at = n[codes], at[codes]
        ends = np.cumsum(n)
        places = np.repeat((at - (ends - n)).astype(np.int32), n)
        places += np.arange(len(places), dtype=np.int32)
        stream = flat[places]
        bounds = np.concatenate(([0], ends))[starts - np.arange(len(starts))].tolist()
        for i, first, lo, hi in zip(np.flatnonzero(~apart).tolist(), firsts, bounds[:-1], bounds[1:], strict=True):
            out[i] = np.concatenate((first.astype(np.uint16), stream[lo:hi]))
        self.settle()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A worker's encoder of a file, which keeps the words it has met from one task to the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int, symbols_at_most: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, symbols up to each document's end, rules, ids that each rule expands to).

    A round counts all adjacent pairs, makes rules of the most frequent ones, and replaces their occurrences
    from left to right; of overlapping occurrences every other one is replaced. Pairs never span documents. It goes on
    until no pair is found twice or all of ``symbols_at_most`` symbols are in use; an expansion has 65,535 ids at most.
    """
    symbols, last = ids.astype(np.uint16), np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    spans = [np.ones(first_rule, np.int64)]
    free = symbols_at_most - first_rule
    while free > 0 and len(symbols) > 1:
        most = min(RULES_A_ROUND, free)
        pairs = symbols[:-1].astype(np.uint32) << np.uint32(16) | symbols[1:]
        ordered = np.sort(pairs[~last[:-1]])
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(counts >= 2)
        length = np.concatenate(spans)
        found = ordered[starts[often]]
        fits = length[found >> np.uint32(16)] + length[found & np.uint32(0xFFFF)] < SYMBOLS
        often, found = often[fits], found[fits]
        if not len(found):
            break
        if len(found) > most:
            # The highest counts, of equal ones the least pairs.
            ranks = counts[often].astype(np.uint64) << np.uint64(32) | ~found.astype(np.uint32)
            found = ~np.partition(ranks, len(ranks) - most)[len(ranks) - most :].astype(np.uint32)
        found = np.sort(found)
        # Rules by the number of the left and of the right symbol among those of chosen pairs; 0 for none.
        left, right = found >> np.uint32(16), found & np.uint32(0xFFFF)
        row, column = np.zeros(SYMBOLS, np.int32), np.zeros(SYMBOLS, np.int32)
        lefts, rights = np.unique(left), np.unique(right)
        row[lefts], column[rights] = np.arange(1, len(lefts) + 1) * (len(rights) + 1), np.arange(1, len(rights) + 1)
        grid = np.zeros((len(lefts) + 1) * (len(rights) + 1), np.uint16)
        grid[row[left] + column[right]] = np.arange(1, len(found) + 1)
        rule = grid[row[symbols[:-1]] + column[symbols[1:]]]
        rule[last[:-1]] = 0
        at = np.flatnonzero(rule)
        rule = rule[at].astype(np.int64) - 1
        run = np.concatenate(([True], np.diff(at) > 1))
        order = np.arange(len(at))
        keep = (order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0
        at, rule = at[keep], rule[keep]
        base = symbols_at_most - free
        symbols[at] = (base + rule).astype(np.uint16)
        last[at] = last[at + 1]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, last = symbols[stays], last[stays]
        rules.append(found)
        spans.append(length[found >> np.uint32(16)] + length[found & np.uint32(0xFFFF)])
        free -= len(found)
    cut = np.flatnonzero(last) + 1
    made = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    return symbols, cut, np.stack((made >> np.uint32(16), made & np.uint32(0xFFFF)), 1).astype("<u2"), np.concatenate(spans)[first_rule:].astype("<u2")


class Grammar:
    """Rules of a shard, made ready for decoding."""

    def __init__(self, rules: bytes, spans: bytes, first_rule: int):
        pairs = np.frombuffer(rules, "<u2").reshape(-1, 2)
        self.spans = np.concatenate((np.ones(first_rule, np.int64), np.frombuffer(spans, "<u2").astype(np.int64)))
        self.starts = np.cumsum(self.spans) - self.spans
        # All rules are expanded at once, as often as they nest.
        symbols = pairs.reshape(-1).astype(np.int64)
        while len(nested := np.flatnonzero(symbols >= first_rule)):
            n = np.ones(len(symbols), np.int64)
            n[nested] = 2
            ends = np.cumsum(n)
            wider = np.repeat(symbols, n)
            wider[ends[nested] - 2], wider[ends[nested] - 1] = pairs[symbols[nested] - first_rule].T
            symbols = wider
        self.ids = np.concatenate((np.arange(first_rule), symbols)).astype(np.uint16)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.spans[symbols]
        ends = np.cumsum(n)
        within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
        return self.ids[np.repeat(self.starts[symbols], n) + within]

    def slice(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a stream, without expanding what stands before or after."""
        ends = np.cumsum(self.spans[symbols])
        lo, hi = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[lo - 1]) if lo else 0
        return self.expand(symbols[lo:hi])[start - before : stop - before]


def _shard(part: int, seq: int, docs: list[int | None], ids: list[np.ndarray], first_rule: int) -> pa.RecordBatch:
    counts = np.array([len(x) for x in ids], np.int64)
    symbols, cut, rules, spans = compress(np.concatenate(ids), np.cumsum(counts), first_rule)
    row = {"part": part, "seq": seq, "docs": docs, "starts": np.concatenate(([0], cut[:-1])).astype(np.int32), "counts": counts.astype(np.int32), "rules": rules.tobytes(), "spans": spans.tobytes(), "symbols": symbols.astype("<u2").tobytes(), "first_rule": first_rule}
    return pa.record_batch([pa.array([row[f.name]], f.type) for f in ARROW], schema=ARROW)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | Callable[[], str], end_id: int = 0, parts: int | None = None) -> None:
    """Encode whole texts and write them, in ascending doc_id order, as shards to ``path``.

    ``tokenizer`` is a file of the tokenizers library, or a function that gives its path on an executor. A null
    or empty text is its end id alone. Null ids come first; rows that share an id stand next to each other in
    the order of their texts. An empty table gives a readable table without shards. The vocabulary must leave
    room for rules below 65,536.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer() if callable(tokenizer) else tokenizer)
        if encoder.size >= SYMBOLS:
            raise ValueError("the vocabulary leaves no room for rules")
        part, seq, held, ids, n = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], np.uint32)
        for batch in slices(batches, most=3 << 20):
            for doc, own in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                held.append(doc)
                ids.append(np.concatenate((own, end)).astype(np.uint16))
                n += len(own) + 1
                if n >= SHARD_TOKENS:
                    yield _shard(part, seq, held, ids, encoder.size)
                    seq, held, ids, n = seq + 1, [], [], 0
        if held:
            yield _shard(part, seq, held, ids, encoder.size)

    ordered.mapInArrow(encode, SHARDS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the files at ``path``: doc_id, start (ids of all documents before it), n_tokens, ids."""
    return _read(spark, path, keep_ids=True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_tokens``, with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids."""
    return _read(spark, path, keep_ids=False)


def _read(spark: SparkSession, path: str, keep_ids: bool) -> DataFrame:
    shards = spark.read.schema(SHARDS).parquet(path)
    # A row for each shard is all that the offsets need; within a part they are summed first, so the one task that
    # adds up parts has as many rows as there are parts.
    sizes = shards.select("part", "seq", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    offsets = sizes.withColumn("own", F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).join(parts, "part").select("part", "seq", (F.col("own") + F.col("part_start")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                grammar = Grammar(row["rules"], row["spans"], row["first_rule"])
                symbols, counts = np.frombuffer(row["symbols"], "<u2"), np.array(row["counts"], np.int64)
                ids = grammar.expand(symbols).astype("<u4")
                ends = np.cumsum(counts)
                cuts = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
                last = pa.array([ids[a:b] for a, b in cuts], pa.list_(pa.int32())) if keep_ids else pa.array([zlib.crc32(ids[a:b]) for a, b in cuts], pa.int64())
                yield pa.record_batch([pa.array([row["part"]] * len(counts), pa.int32()), pa.array([row["seq"]] * len(counts), pa.int32()), pa.array(row["docs"], pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts), last], names=["part", "seq", "doc_id", "within", "n_tokens", "last"])

    decoded = shards.mapInArrow(decode, f"part int, seq int, doc_id long, within long, n_tokens long, last {'array<int>' if keep_ids else 'long'}")
    return decoded.join(offsets, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", F.col("last").alias("ids" if keep_ids else "ids_crc32"))


def token_table(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
