"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

All is DataFrame work. A source's documents stand in digest order as one ring of words, which shards cut into
stretches. Blocks of equal size are dealt to sources by highest quotients; a source's blocks are a run on its ring from
a seeded block on, and the part of the run in a shard's stretch is that shard's quota. What a shard's stretch cannot
hold is so handed on to the next, and totals hold whatever the number of shards. A document's share follows from its
place in its shard alone, and no block is ever listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.base import WORD, cut

#: Words in a block, and words in a shard on average. A shard's cell of one source is the largest group that
#: meets in one task, so shards stay small however large the corpus or a source is.
BLOCK, SHARD_WORDS = 64, 1 << 19
#: Shards whose words are added up together before they are added over a whole source.
GROUP = 4096


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...], most_repeats: int) -> DataFrame:
    """Targets of sources, from their (source, src, source_size): shares of the sum by repeating weights, each
    ``most_repeats`` times its source's size at most and the excess reshared by weight until none is above.

    With sources in the order of the level that fills them, the common level is the largest of (sum - sizes
    filled before) / weights left: one pass of windows instead of rounds. The table has a row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("place", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    ranked = ranked.withColumn("most", F.col("source_size") * most_repeats)
    filling = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before, left = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(left)
    ranked = ranked.withColumn("level", level)
    return ranked.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.max("level").over(everything))).select("src", "place", "source_size", "target")


def source_quotas(targets: DataFrame, most_repeats: int, block: int) -> DataFrame:
    """(src, source_size, target, quota): words of whole blocks that the highest quotients give each source.

    A source that is taken as often as may be is taken whole, without a rest below a block. The divisor that apportions
    all blocks lies between sum / (blocks + sources / 2) and sum / (blocks - sources / 2), so only the few quotients of
    each source between these two are ranked.
    """
    everything = Window.partitionBy()
    shares = targets.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / block).otherwise(F.lit(0.0)))
    shares = shares.withColumn("shares", F.sum("share").over(everything)).withColumn("blocks", F.round(F.col("shares"))).withColumn("parties", F.count("*").over(everything))
    ratio = F.when(F.col("shares") > 0, F.col("share") / F.col("shares")).otherwise(F.lit(0.0))
    most = F.floor(F.col("source_size") * most_repeats / block)
    shares = shares.withColumn("sure", F.least(most, F.greatest(F.lit(0), F.floor(ratio * (F.col("blocks") - F.col("parties") / 2) + 0.5) - 1)).cast("long"))
    shares = shares.withColumn("possible", F.least(most, F.floor(ratio * (F.col("blocks") + F.col("parties") / 2) + 0.5) + 1).cast("long"))
    shares = shares.withColumn("open", F.col("blocks") - F.sum("sure").over(everything))
    seats = shares.filter(F.col("possible") > F.col("sure")).select("src", "place", "share", "open", F.explode(F.sequence(F.col("sure") + 1, F.col("possible"))).alias("seat"))
    ranked = seats.withColumn("rank", F.row_number().over(Window.orderBy((F.col("share") / (F.col("seat") * 2 - 1)).desc(), "place", "seat")))
    won = ranked.filter(F.col("rank") <= F.col("open")).groupBy("src").agg(F.count("*").alias("won"))
    whole = F.col("source_size") * most_repeats
    quota = F.when(F.col("target") >= whole, whole).otherwise((F.col("sure") + F.coalesce("won", F.lit(0))) * block)
    return shares.join(won, "src", "left").select("src", "source_size", "target", quota.cast("long").alias("quota"))


def shard_quotas(cells: DataFrame, quotas: DataFrame, block: int, seed: str) -> DataFrame:
    """For each (src, shard, cell_size): what it takes of its source, as times of the whole and two runs of its own words.

    Returns these, source_size, target, repeats, low, high, again and shard_quota: all words ``repeats`` times, those from
    ``low`` to ``high`` and those up to ``again`` once more; shard_quota is their sum. Words before a shard are added up
    in groups of shards first, so that no task has all shards of a source.
    """
    grouped = cells.withColumn("group", F.floor(F.col("shard") / GROUP))
    ahead = (Window.unboundedPreceding, -1)
    groups = grouped.groupBy("src", "group").agg(F.sum("cell_size").alias("n"))
    groups = groups.select("src", "group", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("group").rowsBetween(*ahead)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("cell_size").over(Window.partitionBy("src", "group").orderBy("shard").rowsBetween(*ahead)), F.lit(0))
    placed = grouped.withColumn("inside", inside).join(groups, ["src", "group"]).withColumn("base", F.col("before") + F.col("inside")).join(quotas, "src")
    n = F.greatest(F.col("source_size"), F.lit(1))
    first = _number(F.md5(F.concat(F.lit(seed), F.lit("|"), "src"))) % F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)) * block
    placed = placed.withColumn("repeats", F.floor(F.col("quota") / n)).withColumn("first", first)
    stop = F.col("first") + F.col("quota") - F.col("repeats") * n
    placed = placed.withColumn("low", F.greatest(F.lit(0), F.col("first") - F.col("base"))).withColumn("high", F.least("cell_size", stop - F.col("base"))).withColumn("again", F.least("cell_size", stop - n - F.col("base")))
    words = F.col("repeats") * F.col("cell_size") + F.greatest(F.lit(0), F.col("high") - F.col("low")) + F.greatest(F.lit(0), F.col("again"))
    return placed.select("src", "shard", "source_size", "target", "repeats", "low", "high", "again", words.cast("long").alias("shard_quota"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most_repeats: int = 3, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` has doc_id, text and source; nothing else is read. Sources in code point order, null last, have
    ``weights``, repeating. Returns a row for each input row: doc_id, size (its words), source, source_size,
    target (of its source), shard, shard_quota (words that its shard takes of its source), taken (words the mix takes,
    repeats counted; ``most_repeats`` times its size at most).

    A null or empty text has size 0 and is taken 0 times. Null is a source of its own. Rows that share an id
    are documents of their own; those without one have their places by their texts. A source's total is within two
    blocks of its target whatever the number of shards and however short its documents are. An empty table, or one
    without words, gives targets of 0. Reruns agree: order and places come from digests of ``seed`` and ids.

    Sources are ranked in one task, a row each; documents in one for each source and shard.
    """
    text = F.col("text").cast("string")
    own = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), own)).alias("digest"),
    )
    sized = cut(sized.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    totals = cut(sized.groupBy("src", "source").agg(F.sum("size").alias("source_size")))
    words = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    sized = sized.withColumn("shard", _number("digest") % F.lit(max(1, -(-words // shard_words))))
    quotas = source_quotas(source_targets(totals, weights, most_repeats), most_repeats, block)
    cells = shard_quotas(sized.groupBy("src", "shard").agg(F.sum("size").alias("cell_size")), quotas, block, seed)
    placed = sized.join(cells, ["src", "shard"]).withColumn("end", F.sum("size").over(Window.partitionBy("src", "shard").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("end") - F.col("size")
    part = F.greatest(F.lit(0), F.least("end", "high") - F.greatest(begin, F.col("low"))) + F.greatest(F.lit(0), F.least("end", "again") - begin)
    return placed.select("doc_id", "size", "source", "source_size", "target", "shard", "shard_quota", F.when(F.col("size") > 0, F.col("repeats") * F.col("size") + part).otherwise(F.lit(0)).cast("long").alias("taken"))
