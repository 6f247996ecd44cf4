"""MinHash near-dedup of word shingles.

One-permutation hashing with optimal densification gives each distinct set a signature; bands of it are buckets.
A bucket's members are compared with one centre, the member whose buckets hold most documents, which for copies
of one text is the same in all their buckets: about one edge for each document and not one for each pair. What a
centre leaves apart is compared again only where size, shared shingles and the distances to the centre allow a
link. In buckets of more than a million such pairs members meet by their rarest shingles, of which any two that link
share one, so that a family of unlike pages does not meet all against all; this finds the same links. Links are
confirmed on full sets, and components follow from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import PARTIAL, Counted, Hashes, Once, cut, hashed_words, id_key, list_slices, merged_filter, mixed, partial_sketch, raw, slices, window_hashes
from lectern.llm.components import components

#: Bands and values in a band. Texts of similarity 0.85 share no band with probability 2e-7, of 0.8 with 3e-5.
BANDS, ROWS = 26, 5
#: Pairs of members left apart and others that are compared in a bucket; in one with more, members meet by rare shingles.
#: As the fewer of them are 1,024 at most, a member meets so many others in a bucket at most, and all pairs grow as the
#: members do. Results do not depend on it.
CROWD = 1 << 20
#: Bits that select a counter of shingles. Counts only order shingles, so that shared counters change no result.
COUNTER_BITS = 18
#: 64-bit words of a set's parities: a bit for the shingles of each of 64 * PARITIES kinds, set if their number is odd.
PARITIES = 16
FLUSH = 1_000_000
EMPTY = np.uint64(1) << np.uint64(63)


@lru_cache
def sources_of_bins(bins: int, seed: int = 5) -> np.ndarray:
    """For each bin, all bins in the order in which it borrows from them when it is empty."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS, seed: int = 17) -> np.ndarray:
    """Band hashes of non-empty sets of 64-bit values."""
    bins = bands * rows
    values = mixed(np.concatenate(sets), seed)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bin_of = ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    least = np.full(len(sets) * bins, EMPTY, np.uint64)
    np.minimum.at(least, owner * bins + bin_of, values & np.uint64(0xFFFFFFFF))
    least = least.reshape(len(sets), bins)
    filled, order = least.copy(), sources_of_bins(bins)
    at, to = np.nonzero(least == EMPTY)
    for turn in range(bins):
        if not len(at):
            break
        borrowed = least[at, order[to, turn]]
        found = borrowed != EMPTY
        filled[at[found], to[found]] = borrowed[found] | np.uint64(turn + 1) << np.uint64(40)
        at, to = at[~found], to[~found]
    grouped = filled.reshape(len(sets), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands)).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = mixed(out * np.uint64(0x9DDFEA08EB382D69) + grouped[:, :, i])
    return out


def shingle_sets(texts: list[bytes | None], hashes: Hashes, width: int) -> list[np.ndarray]:
    """Distinct hashes of ``width`` words; of fewer words the hash of all of them; of none an empty set."""
    words, offsets = hashed_words([(t or b"").lower() for t in texts], hashes)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = words[a:b]
        if len(own) >= width:
            out.append(np.unique(window_hashes(own, width)))
        else:
            out.append(mixed(window_hashes(own, len(own)), 100 + len(own)) if len(own) else np.zeros(0, np.uint64))
    return out


def _signed(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, crowd: int = CROWD) -> DataFrame:
    """Components of documents whose shingle sets are similar: 100 * intersection >= ``percent`` * union.

    ``docs`` has doc_id and text; nothing else is read. A-Z count as lower case. Returns a row for each input
    row: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (doc_id = component_id).

    A text of fewer than ``width`` words is one shingle; without words, or null, its set is empty and it links
    with nothing. Documents with equal sets are one node of the graph, however many they are. A null id counts
    as the smallest, and a component that it heads has a null component_id. Rows that share an id are one node, which
    links as any of their texts does; those of them without words are left with their own id. An empty table gives an
    empty result. Whatever ``crowd`` is, the same texts are linked.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key().alias("key"), F.col("text").cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for part in slices(batches):
            sets = shingle_sets(raw(part.column("text")), hashes, width)
            some = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if some:
                for i, own in zip(some, signatures([sets[i] for i in some]).view(np.int64), strict=True):
                    bands[i] = own
            digests = [_signed(xxhash.xxh3_128_digest(s.tobytes())) for s in sets]
            yield pa.record_batch([part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "n", "high", "low", "bands"])

    nodes = cut(rows.mapInArrow(sketch, "key long, n long, high long, low long, bands array<long>"))
    classes = nodes.filter("n > 0").groupBy("high", "low").agg(F.min("key").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # A band's hash names its band, too. Buckets of one class are of no use.
    member = classes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    member = cut(member.join(sizes, "bucket"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield partial_sketch(mixed(np.asarray(batch.column("node")).astype(np.int64).view(np.uint64), 23))

    wanted = spark.sparkContext.broadcast(merged_filter(member.select("node").distinct().mapInArrow(keys, PARTIAL), Once))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            own = wanted.value.has(mixed(np.asarray(batch.column("key")).astype(np.int64).view(np.uint64), 23))
            for part in slices([batch.filter(pa.array(own))]):
                sets = [s.view(np.int64) for s in shingle_sets(raw(part.column("text")), hashes, width)]
                yield pa.record_batch([part.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "items"])

    # A row without words may share its id with one that has some; its empty set is like no other.
    items = cut(rows.mapInArrow(sets_of, "key long, items array<long>").filter(F.size("items") > 0))

    # How many shingles of a set are in another set, too: what two documents share is no more than that.
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in list_slices(batches, "items"):
            held.append(np.asarray(batch.column("items").flatten(), np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= FLUSH:
                yield partial_sketch(np.concatenate(held))
                held, n = [], 0
        if held:
            yield partial_sketch(np.concatenate(held))

    shared = spark.sparkContext.broadcast(merged_filter(items.select("items").mapInArrow(once, PARTIAL), Counted))

    def supported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in list_slices(batches, "items"):
            lists = batch.column("items")
            lengths = np.asarray(pc.list_value_length(lists), np.int64)
            found = np.concatenate(([0], np.cumsum(shared.value.has(np.asarray(lists.flatten(), np.int64).view(np.uint64)))))
            ends = np.cumsum(lengths)
            yield pa.record_batch([batch.column("key"), pa.array(found[ends] - found[ends - lengths])], names=["node", "support"])

    support = items.mapInArrow(supported, "node long, support long").groupBy("node").agg(F.max("support").alias("support"))
    # A set whose shingles are nearly all its own links with nothing.
    member = member.join(support, "node").filter(F.col("support") * 100 >= F.col("n") * percent)
    score = member.groupBy("node").agg(F.sum("size").alias("score"))
    member = cut(member.join(score, "node").select("node", "n", "support", "bucket", F.struct(F.col("score"), F.bitwise_not("node").alias("order"), F.col("node").alias("node"), (-F.col("n")).alias("less"), F.col("support").alias("support")).alias("rank")))
    # Of several sets of the centre's in its bucket the least counts, as it may link with all that the others may.
    centre = member.groupBy("bucket").agg(F.max("rank").alias("centre"))
    starred = member.join(centre, "bucket").select("bucket", "node", "n", "support", F.col("centre.node").alias("hub"), (-F.col("centre.less")).alias("hub_n"), F.col("centre.support").alias("hub_support"))

    first = starred.filter("node != hub").filter(_may_link(F.col("n"), F.col("hub_n"), F.col("support"), F.col("hub_support"), percent)).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    measured = cut(_measured(first, items))
    links = measured.filter(_similar(percent)).select("u", "v")
    # Cut off, so that the class of a text that is everywhere is joined by two plain shuffles and split.
    known = cut(classes.select("high", "low", "node"))
    # An id of several sets links the classes that hold them.
    several = cut(nodes.filter("n > 0").groupBy("key").agg(F.min("high").alias("a"), F.max("high").alias("b"), F.min("low").alias("c"), F.max("low").alias("d")).filter("a < b OR c < d").select("key"))
    if not several.isEmpty():
        links = links.unionByName(nodes.filter("n > 0").join(several, "key").join(known, ["high", "low"]).select(F.col("key").alias("u"), F.col("node").alias("v")).distinct())
    linked = cut(components(links))
    # Members that the centre left apart, against all of their bucket in other components. The distance 1 - similarity
    # is a metric, so two that link are about as far from their centre as each other.
    seen = measured.select(F.col("u").alias("hub"), F.col("v").alias("node"), (1 - F.col("both") / (F.col("n_u") + F.col("n_v") - F.col("both"))).alias("distance"))
    own = starred.join(seen, ["hub", "node"], "left").withColumn("distance", F.when(F.col("node") == F.col("hub"), 0.0).otherwise(F.col("distance")))
    own = own.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    hubs = linked.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    own = own.join(hubs, "hub", "left").withColumn("apart", F.col("component") != F.coalesce("hub_component", "hub"))
    own = cut(own.select("bucket", "node", "n", "support", "component", "distance", "hub", "apart"))
    rest = _apart(own, items, percent, crowd)
    more = _measured(rest, items).filter(_similar(percent)).select("u", "v")
    more = cut(more)
    if not more.isEmpty():
        linked = cut(components(links.unionByName(more)))
    answer = nodes.join(known, ["high", "low"], "left").join(linked, "node", "left")
    component = F.when(F.col("n") == 0, F.col("key")).otherwise(F.coalesce("component", "node"))
    least = F.lit(-(2**63))
    return answer.select(
        F.when(F.col("key") != least, F.col("key")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(component != least, component).alias("component_id"),
        (F.col("key") == component).alias("kept"),
    )


def _may_link(n: Column, m: Column, s: Column, t: Column, percent: int) -> Column:
    """Whether sets of these sizes and supports can be similar enough."""
    most = F.least(s, t)
    return most * 100 >= (n + m - most) * percent


def _apart(own: DataFrame, items: DataFrame, percent: int, crowd: int) -> DataFrame:
    """(u, v) of members that the centres left apart and others of their buckets in other components, each pair once.

    ``own`` has bucket, node, n, support, component, distance, hub and apart. Buckets of more than ``crowd`` such pairs
    are left to ``_crowded``.
    """
    met = own.filter("node != hub").join(own.filter("apart").select("bucket").distinct(), "bucket", "left_semi")
    sizes = met.groupBy("bucket").agg((F.count("*") * F.count_if("apart")).alias("pairs"))
    met = cut(met.join(sizes, "bucket"))
    crowded = met.filter(F.col("pairs") > crowd)
    met = met.filter(F.col("pairs") <= crowd)
    # A pair that shares several keys is met by the first of them only, so that a node of several sets, which may be in
    # different buckets, stands in each for all of them: the least may link with all that the others may.
    keys = met.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("keys"), F.min("n").alias("n"))
    met = met.drop("n").join(keys, "node")
    left = met.filter("apart").select("bucket", F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("support").alias("s_u"), F.col("component").alias("c_u"), F.col("distance").alias("d_u"), F.col("keys").alias("k_u"))
    right = met.select("bucket", F.col("node").alias("v"), "n", "support", "component", "distance", "apart", "keys")
    near = F.col("d_u").isNull() | F.col("distance").isNull() | (F.abs(F.col("d_u") - F.col("distance")) * 100 <= 100 - percent + 1e-6)
    pairs = left.join(right, "bucket").filter((F.col("c_u") != F.col("component")) & (~F.col("apart") | (F.col("u") < F.col("v"))) & near & _may_link(F.col("n_u"), F.col("n"), F.col("s_u"), F.col("support"), percent) & (F.get(F.array_intersect("k_u", "keys"), F.lit(0)) == F.col("bucket")))
    pairs = pairs.select("u", "v")
    return pairs if crowded.isEmpty() else pairs.unionByName(_crowded(crowded, items, percent)).distinct()


def _crowded(met: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(u, v) of members that share a bucket in different components, but for some that cannot link.

    Shingles have one order, the rarest first. What two sets share begins with the same shingle in both, and as it is
    most of either set, that one is among the first of both: those of the smaller (or equal) set that may be missing
    from one no smaller, and those of the larger that may be missing from any. Each difference of two sets turns one
    parity, so their parities differ in no more bits than the sets in shingles.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in list_slices(batches, "items"):
            counts += np.bincount(_counter(np.asarray(batch.column("items").flatten(), np.int64)), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["counter", "n"])

    total = items.select("items").mapInArrow(counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[np.asarray(total.column("counter"))] = np.asarray(total.column("n"))
    frequency = items.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in list_slices(batches, "items"):
            firsts, parities = [], []
            for own in batch.column("items"):
                own = np.asarray(own.values, np.int64)
                order = np.lexsort((own, frequency.value[_counter(own)]))
                firsts.append(own[order[: len(own) * (100 - percent) // 100 + 1]])
                parities.append(np.packbits((np.bincount(own & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1).astype(bool)).view(np.int64))
            yield pa.record_batch([batch.column("key"), pc.list_value_length(batch.column("items")).cast(pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))], names=["node", "n", "firsts", "parities"])

    members = met.groupBy("node").agg(F.max("support").alias("support"), F.min("component").alias("component"), F.max("apart").alias("apart"), F.collect_set("bucket").alias("buckets"))
    own = items.join(members.select(F.col("node").alias("key")).distinct(), "key", "left_semi").mapInArrow(rarest, "node long, n long, firsts array<long>, parities array<long>")
    sets = cut(members.join(own, "node"))
    rows = sets.select("node", "n", "component", "apart", F.posexplode("firsts").alias("at", "shingle"))
    small = rows.filter(F.col("at") * (100 + percent) <= F.col("n") * (100 - percent)).select("shingle", F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("at").alias("at_u"), F.col("component").alias("c_u"), F.col("apart").alias("apart_u"))
    large = rows.withColumnRenamed("node", "v")
    share = F.least(F.col("n_u") - F.col("at_u"), F.col("n") - F.col("at"))
    order = (F.col("n_u") < F.col("n")) | ((F.col("n_u") == F.col("n")) & (F.col("u") < F.col("v")))
    able = (F.col("c_u") != F.col("component")) & order & (share * (100 + percent) >= (F.col("n_u") + F.col("n")) * percent)
    # Members that no centre left apart are in their centres' components: they meet those left apart, and not one another.
    pairs = small.filter("apart_u").join(large, "shingle").filter(able).select("u", "v")
    pairs = pairs.unionByName(small.filter("NOT apart_u").join(large.filter("apart"), "shingle").filter(able).select("u", "v")).distinct()
    left = sets.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("support").alias("s_u"), F.col("buckets").alias("b_u"), F.col("parities").alias("p_u"))
    right = sets.select(F.col("node").alias("v"), "n", "support", "buckets", "parities")
    turned = reduce(add, (F.bit_count(F.get("p_u", F.lit(i)).bitwiseXOR(F.get("parities", F.lit(i)))) for i in range(PARITIES)))
    alike = (turned * (100 + percent) <= (F.col("n_u") + F.col("n")) * (100 - percent)) & _may_link(F.col("n_u"), F.col("n"), F.col("s_u"), F.col("support"), percent) & F.arrays_overlap("b_u", "buckets")
    return pairs.join(left, "u").join(right, "v").filter(alike).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _measured(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Sizes and intersections of the sets at both ends; of rows that share an id, each one's set. Both joins are plain
    shuffles, so adaptive execution splits a hub's."""
    both = edges.join(items.select(F.col("key").alias("v"), F.col("items").alias("b")), "v").join(items.select(F.col("key").alias("u"), F.col("items").alias("a")), "u")
    return both.select("u", "v", F.size("a").alias("n_u"), F.size("b").alias("n_v"), F.size(F.array_intersect("a", "b")).alias("both"))


def _similar(percent: int) -> Column:
    return F.col("both") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("both")) * percent
