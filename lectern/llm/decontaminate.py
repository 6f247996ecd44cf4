"""Benchmark decontamination: template canonicalisation.

Numbers, names and units become typed placeholders. Windows of such templates are joined by hash, and a match
counts where the slots' values of item and document correspond one to one, so that verbatim copies and
re-parameterised questions are found alike and mere likeness of form is not. Windows of neighbouring offsets are
united, so that inserted and deleted words do not split a match. Capitalised words at the start of a sentence are
read both as words and as names, and windows of few words are also joined by their exact values.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import PARTIAL, REMEMBERED_WORDS, Once, cut, id_key, merged_filter, partial_sketch, raw, slices

WIDTH, LEAST = 8, 4
# Words that stand for numbers, and units of measure.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNITS = "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres mph kmh hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar usd eur gbp dollar dollars euro euros cent cents percent degree degrees".split()
#: Units that are common words, and count as units after a number only.
WORDS = {b"in", b"a"}
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Readings of a text: sentence-first capitalised words as words, or as names; exact values.
AS_WORDS, AS_NAMES, EXACT = 0, 1, 2
EDGES = b"\"'`.,;:!?()[]{}<>*_#$%&|~^+=/\\-"
WINDOWS = "hash long, key long, row long, reading int, at array<long>, slots array<string>"
ITEM_WINDOWS = "hash long, item long, item_reading int, item_at array<long>, item_slots array<string>, item_tokens long"
RESULT = "doc_id long, item_id long, matched long, item_tokens long, share double, changed_slots long, verbatim boolean, contaminated boolean"


class Tokens(dict):
    """What a raw word is: a hash with, in the lowest bits, its type, whether it ends a sentence, and whether the parts of
    a name or of a number in words can follow (16) or precede it (32) as one value, and whether it is a unit after a
    number only (64); 0 if nothing is left of it."""

    numbers, units = {w.encode() for w in NUMBERS}, {w.encode() for w in UNITS}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        core = word.strip(EDGES)
        low = core.decode("utf-8", "replace").lower().encode()
        ends = word.rstrip(b"\"')]*#$%&|<>")[-1:] in (b".", b"!", b"?", b":")
        if not core:
            value = int(ends)
        else:
            digits = sum(48 <= c <= 57 for c in core)
            kind = LITERAL
            if low in self.numbers or digits and not core.translate(None, b"0123456789.,:/%+-"):
                kind = NUMBER
            elif low in self.units:
                kind = UNIT
            else:
                text = core.decode("utf-8", "replace")
                if text[0].isupper() and len(text) > 1 and text[1:].islower():
                    kind = NAME
            part = kind == NAME or low in self.numbers
            value = xxhash.xxh3_64_intdigest(low) & ~127 | 8 | kind << 1 | ends | (part and word.endswith(core)) << 4 | (part and word.startswith(core)) << 5 | (low in WORDS) << 6
        self[word] = value
        return value


SLOT_HASH = np.array([0, 0x51AF3C, 0x9D2E71, 0xC3B8A5], np.uint64)


def templates(texts: list[bytes | None], known: Tokens) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of all texts' tokens: offsets of texts, raw words, which of these are tokens, which tokens may be names by their
    place only, and for each reading: hashes, types, and which tokens are further parts of the value before them."""
    split = [(t or b"").split() for t in texts]
    words = [w for own in split for w in own]
    codes = np.fromiter((known[w] for w in words), np.uint64, len(words))
    counts = np.array([len(own) for own in split], np.int64)
    starts = np.cumsum(counts) - counts
    ends = (codes & np.uint64(1)).astype(bool)
    token = (codes & np.uint64(8)) != 0
    after = np.ones(len(words), bool)
    after[1:] = ends[:-1]
    after[starts[counts > 0]] = True
    plain = (codes >> np.uint64(1) & np.uint64(3)).astype(np.int64)
    numbered = np.zeros(len(words), bool)
    numbered[1:] = plain[:-1] == NUMBER
    numbered[starts[counts > 0]] = False
    names = plain.copy()
    names[(codes & np.uint64(64) != 0) & ~numbered] = LITERAL
    first = after & (names == NAME)
    kinds = np.where(first, LITERAL, names)
    follows = np.zeros(len(words), bool)
    follows[1:] = (codes[:-1] & np.uint64(16) != 0) & (codes[1:] & np.uint64(32) != 0)
    follows[starts[counts > 0]] = False
    values, readings = codes & ~np.uint64(127), []
    for own in (kinds, names):
        joined = np.zeros(len(words), bool)
        joined[1:] = follows[1:] & (own[1:] == own[:-1]) & (own[1:] != LITERAL)
        readings.append((np.where(own == LITERAL, values, SLOT_HASH[own])[token], own[token], joined[token]))
    # Types of exact values depend on the word alone, so that copies agree wherever they stand.
    readings.append((values[token], plain[token], np.zeros(int(token.sum()), bool)))
    return np.concatenate(([0], np.cumsum(token)))[np.append(starts, len(words))], words, np.flatnonzero(token), first[token], readings


def merged(hashes: np.ndarray, kinds: np.ndarray, offsets: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names and numbers of several words as one token: hashes, types, offsets of texts, and where each token starts among all words' tokens."""
    heads = np.flatnonzero(~joined)
    return hashes[heads], kinds[heads], np.concatenate(([0], np.cumsum(~joined)))[offsets], np.append(heads, len(joined))


def _windows(hashes: np.ndarray, kinds: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and text of each window whose tokens are words for a half at least."""
    from lectern.llm.base import mixed, window_hashes, window_starts

    starts, owner = window_starts(offsets, width)
    enough = _count(kinds == LITERAL, starts, starts + width) * 2 >= width
    starts, owner = starts[enough], owner[enough]
    return mixed(window_hashes(hashes, width)[starts], 40 + width), starts, owner


def _exact_windows(hashes: np.ndarray, special: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and text of each window of exact values whose tokens are ``special`` for more than a half, or near it."""
    from lectern.llm.base import mixed, window_hashes, window_starts

    starts, owner = window_starts(offsets, width)
    few = _count(special, starts, starts + width) * 2 >= width - 1
    starts, owner = starts[few], owner[few]
    return mixed(window_hashes(hashes, width)[starts], 140 + width), starts, owner


def _count(flags: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[stops] - sums[starts]


class Text:
    """Some texts' tokens in all readings."""

    def __init__(self, texts: list[bytes | None], known: Tokens):
        self.first, self.words, self.token, self.ambiguous, readings = templates(texts, known)
        self.readings = [merged(hashes, kinds, self.first, joined) for hashes, kinds, joined in readings]
        self.lengths = np.array([np.diff(offsets) for _, _, offsets, _ in self.readings])
        kinds = self.readings[EXACT][1]
        # Whether a word is a name depends on its case, which exact values do not have.
        self.numeric = np.where(kinds == NAME, LITERAL, kinds)

    def windows(self, reading: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and text of the windows of a reading; as names, only those that differ from those as words."""
        hashes, kinds, offsets, bounds = self.readings[reading]
        if reading == EXACT:
            return _exact_windows(hashes, kinds != LITERAL, offsets, width)
        found, starts, owner = _windows(hashes, kinds, offsets, width)
        if reading == AS_NAMES:
            own = _count(self.ambiguous, bounds[starts], bounds[starts + width]) > 0
            found, starts, owner = found[own], starts[own], owner[own]
        return found, starts, owner

    def at(self, reading: int, start: int, owner: int, width: int) -> list[int]:
        return (self.readings[reading][3][start : start + width + 1] - self.first[owner]).tolist()

    def slots(self, reading: int, start: int, width: int) -> list[str]:
        _, kinds, _, bounds = self.readings[reading]
        return _slots(self.words, self.token, self.numeric if reading == EXACT else kinds, bounds, start, width)


def _slots(words: list[bytes], token: np.ndarray, kinds: np.ndarray, bounds: np.ndarray, start: int, width: int) -> list[str]:
    values = ((i, b" ".join(words[k].strip(EDGES) for k in token[bounds[start + i] : bounds[start + i + 1]])) for i in range(width) if kinds[start + i] != LITERAL)
    return [f"{i}:{kinds[start + i]}:{value.decode('utf-8', 'replace').lower()}" for i, value in values]


class Run:
    """The windows of one document and item at one offset: document places by item token, and slots by item token."""

    def __init__(self) -> None:
        self.places: dict[int, int] = {}
        self.slots: dict[int, tuple[str, str, str]] = {}

    def add(self, at: list[int], slots: list[str], item_at: list[int], item_slots: list[str]) -> None:
        for i, place in enumerate(at[:-1]):
            for own in range(item_at[i], item_at[i + 1]):
                self.places.setdefault(own, place)
        for mine, other in zip(item_slots, slots, strict=True):
            i, kind, value = mine.split(":", 2)
            self.slots.setdefault(item_at[int(i)], (kind, value, other.split(":", 2)[2]))


def one_to_one(slots: list[tuple[str, str, str]]) -> bool:
    """Whether values of item and document correspond one to one by type."""
    pairs = set(slots)
    return len(pairs) == len({(k, a) for k, a, _ in pairs}) == len({(k, b) for k, _, b in pairs})


def united(windows: list[tuple], n: int, least_share: float) -> tuple[int, int, int] | None:
    """Of an item of ``n`` tokens and its windows in a document: matched tokens, slots that differ (negative), offsets in use (negative).

    Around each offset, those that lie within half of the item's length (``WIDTH`` at least) add what they match
    besides, larger ones first: a token of the document stands for one of the item, and slots stay one to one.
    None if that is below ``least_share`` of the item everywhere.
    """
    runs: dict[int, Run] = {}
    for at, slots, item_at, item_slots in sorted(windows):
        runs.setdefault(at[0] - item_at[0], Run()).add(at, slots, item_at, item_slots)
    runs = {o: run for o, run in runs.items() if one_to_one(list(run.slots.values()))}
    offsets, drift, best = sorted(runs), max(WIDTH, n // 2), None
    sums = np.concatenate(([0], np.cumsum([len(runs[o].places) for o in offsets])))
    for seed in sorted(offsets, key=lambda o: (-len(runs[o].places), o)):
        low, high = bisect_left(offsets, seed - drift), bisect_right(offsets, seed + drift)
        if sums[high] - sums[low] < n * least_share:
            continue
        covered, slots, used = dict(runs[seed].places), dict(runs[seed].slots), 1
        taken = set(covered.values())
        for o in sorted(offsets[low:high], key=lambda o: (-len(runs[o].places), abs(o - seed), o)):
            more = {i: place for i, place in runs[o].places.items() if i not in covered and place not in taken}
            if not more:
                continue
            both = slots | {i: slot for i, slot in runs[o].slots.items() if i in more}
            if one_to_one(list(both.values())):
                covered, slots, used = covered | more, both, used + 1
                taken.update(more.values())
        found = len(covered), -sum(a != b for _, a, b in slots.values()), -used
        if found[0] >= n * least_share and (best is None or found > best):
            best = found
        if best == (n, 0, -1):
            break
    return best


def judged(windows: list[tuple], n: int, least_share: float) -> tuple[int, int, int] | None:
    """The best of ``united`` over the windows of all readings and of some, so that slots of one reading never undo a match of another."""
    plain = {(tuple(w[2]), tuple(w[4])) for w in windows if max(w[0], w[1]) == AS_WORDS}
    levels = [(max(w[0], w[1]), w[2:]) for w in windows]
    levels = [(level, w) for level, w in levels if level != AS_NAMES or (tuple(w[0]), tuple(w[2])) not in plain]
    best, seen = None, set()
    for wanted in ({AS_WORDS, AS_NAMES, EXACT}, {AS_WORDS, EXACT}, {AS_WORDS, AS_NAMES}, {AS_WORDS}, {EXACT}):
        use = frozenset(wanted & {level for level, _ in levels})
        if use and use not in seen:
            seen.add(use)
            found = united([w for level, w in levels if level in use], n, least_share)
            best = max((x for x in (best, found) if x), default=None)
        if best == (n, 0, -1):
            break
    return best


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_share: float = 0.6) -> DataFrame:
    """Documents that hold a benchmark item, word for word or with other numbers, names and units.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; nothing else is read. Returns a row for each
    document and item found in it, and none for other documents: doc_id, item_id, matched (tokens of the item in
    template windows found near one another), item_tokens, share, changed_slots (slot values that differ), verbatim
    (no such slot, and all at one offset), contaminated (true). Each item that a document matches has its row, also items of
    one template or one text.

    A pair counts when matched tokens are ``least_share`` of the item's and the slots' values correspond one to
    one by type. Windows of offsets that differ by half of the item's tokens or ``WIDTH`` at most are united; names of
    several words, and numbers in several, are one slot. Items shorter than ``width`` match as a whole; those of fewer than 4 tokens, and null or empty
    texts match nothing. Windows of more placeholders than words match by their exact values only. A capitalised word
    at the start of a sentence is read as a word and as a name; all those of a window are read alike. A null doc_id stays null. Rows that share an id
    give one row for each item. Items may be many: a filter of their windows, of bounded size, is broadcast, and
    the windows that pass it are joined with them.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key().alias("key"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for part in slices(batches):
            texts, names = Text(raw(part.column("text")), known), []
            for i in range(part.num_rows):
                a, b = texts.first[i], texts.first[i + 1]
                parts = [b" ".join(texts.words[k].strip(EDGES).decode("utf-8", "replace").lower().encode() for k in texts.token[a:b])]
                for _, kinds, offsets, bounds in texts.readings:
                    parts += [kinds[offsets[i] : offsets[i + 1]].tobytes(), (bounds[offsets[i] : offsets[i + 1]] - a).tobytes()]
                names.append(xxhash.xxh3_64_intdigest(b"|".join(parts)))
            yield pa.record_batch([part.column("item"), part.column("text"), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(texts.lengths.T.tolist(), pa.list_(pa.int64()))], names=["item", "text", "class", "m"])

    # Only items whose tokens are the same in all readings are a class; matches are joined back to all its members.
    listed = cut(items.mapInArrow(named, "item long, text string, class long, m array<long>").filter(F.col("m")[EXACT] >= LEAST))
    members = listed.select("item", "class").distinct()
    classes = listed.groupBy(F.col("class").alias("item")).agg(F.min("text").alias("text"), F.min("m").alias("m"))
    lengths = classes.select(F.transform("m", lambda m: F.least(m, F.lit(width))).alias("m")).distinct().collect()
    # In each reading, items have windows of a few widths.
    steps = sorted({(reading, w) for r in lengths for reading, w in enumerate(r["m"])})

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for part in slices(batches):
            texts, ids = Text(raw(part.column("text")), known), part.column("item").to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for reading, w in steps:
                for h, start, owner in zip(*(x.tolist() for x in texts.windows(reading, w)), strict=True):
                    if w == min(width, texts.lengths[reading][owner]):
                        for column, value in zip(out, (h, ids[owner], reading, texts.at(reading, start, owner, w), texts.slots(reading, start, w), texts.lengths[EXACT][owner]), strict=True):
                            column.append(value)
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64())
            yield pa.record_batch([pa.array(np.array(out[0], np.uint64).view(np.int64)), *(pa.array(c, t) for c, t in zip(out[1:], types, strict=True))], names=["hash", "item", "item_reading", "item_at", "item_slots", "item_tokens"])

    wanted = cut(classes.select("item", "text").mapInArrow(item_windows, ITEM_WINDOWS))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield partial_sketch(np.asarray(batch.column("hash")).astype(np.int64).view(np.uint64))

    passing = spark.sparkContext.broadcast(merged_filter(wanted.select("hash").mapInArrow(keys, PARTIAL), Once))

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for part in slices(batches, most=2 << 20):
            own = raw(part.column("text"))
            texts, ids = Text(own, known), np.asarray(part.column("key")).astype(np.int64)
            for reading, w in steps:
                found, starts, owner = texts.windows(reading, w)
                passed = passing.value.has(found)
                found, starts, owner = found[passed], starts[passed], owner[passed]
                if len(found):
                    names = {o: xxhash.xxh3_64_intdigest(own[o]) for o in set(owner.tolist())}
                    at = [texts.at(reading, s, o, w) for s, o in zip(starts.tolist(), owner.tolist(), strict=True)]
                    slots = [texts.slots(reading, s, w) for s in starts.tolist()]
                    row = np.array([names[o] for o in owner.tolist()], np.uint64).view(np.int64)
                    yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(ids[owner]), pa.array(row), pa.array(np.full(len(found), reading, np.int32)), pa.array(at, pa.list_(pa.int64())), pa.array(slots, pa.list_(pa.string()))], names=["hash", "key", "row", "reading", "at", "slots"])

    # Rows that share an id are told apart by their texts; windows of one text and item meet in one row.
    met = rows.mapInArrow(doc_windows, WINDOWS).join(wanted, "hash")
    met = met.groupBy("key", "row", "item", "item_tokens").agg(F.collect_set(F.struct("reading", "item_reading", "at", "slots", "item_at", "item_slots")).alias("windows"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, item, n, windows in zip(*(batch.column(c) for c in ("key", "item", "item_tokens", "windows")), strict=True):
                n = n.as_py()
                best = judged([tuple(w.values()) for w in windows.as_py()], n, least_share)
                if best:
                    for column, value in zip(out, (key.as_py(), item.as_py(), n, *best), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["key", "item", "item_tokens", "matched", "same", "runs"])

    found = met.mapInArrow(judge, "key long, item long, item_tokens long, matched long, same long, runs long")
    found = found.withColumnRenamed("item", "class").join(members, "class")
    best = found.groupBy("key", "item", "item_tokens").agg(F.max(F.struct("matched", "same", "runs")).alias("best"))
    return best.select(
        F.when(F.col("key") != -(2**63), F.col("key")).alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("best.matched").alias("matched"),
        "item_tokens",
        (F.col("best.matched") / F.col("item_tokens")).alias("share"),
        (-F.col("best.same")).alias("changed_slots"),
        ((F.col("best.same") == 0) & (F.col("best.runs") == -1)).alias("verbatim"),
        F.lit(True).alias("contaminated"),
    )
