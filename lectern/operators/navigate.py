"""Headings: breadcrumbs by windows, outlines, path resolution, reading sections whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import casefolded, token_estimate
from lectern.schema import PATH_SEPARATOR


def breadcrumbs(headings: DataFrame, levels: int = 6) -> DataFrame:
    """Adds heading_path to (doc_id, idx, level, title): the open ancestors of each heading and itself.

    The last heading of level l before a row is its ancestor if it is later than the last of each level above l;
    that is what a stack popped to the row's level holds, and needs one sort of each document and no loop.
    """
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.coalesce(F.last(F.when(F.col("level") == n, F.struct("idx", "title")), ignorenulls=True).over(before)["idx"], F.lit(-1)) for n in range(1, levels + 1)}
    title = {n: F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(before) for n in range(1, levels + 1)}
    out = headings.select("*", *[last[n].alias(f"_at{n}") for n in last], *[title[n].alias(f"_of{n}") for n in title])
    kept = []
    for n in range(1, levels + 1):
        above = F.greatest(F.lit(-1), *[F.col(f"_at{m}") for m in range(1, n)], F.lit(-1))
        kept.append(F.when((F.col("level") > n) & (F.col(f"_at{n}") > above), F.col(f"_of{n}")))
    parents = F.filter(F.array(*kept), lambda x: x.isNotNull())
    return out.select(*headings.columns, F.array_join(parents, PATH_SEPARATOR).alias("parent_path"), F.array_join(F.concat(parents, F.array("title")), PATH_SEPARATOR).alias("heading_path"))


def sectioned(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """Sections of (doc_id, line, text) lines: each runs from its heading to the next; blank lines at its ends go."""
    marked = lines.join(headings.select("doc_id", F.col("idx").alias("line"), "heading_path", "level", "title"), ["doc_id", "line"], "left")
    so_far = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("start", F.last(F.when(F.col("heading_path").isNotNull(), F.col("line")), ignorenulls=True).over(so_far))
    grouped = owned.groupBy("doc_id", F.coalesce("start", F.lit(-1)).alias("start")).agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("lines"), F.max("heading_path").alias("heading_path"), F.max("level").alias("level"))
    full = F.filter("lines", lambda x: F.trim(x["text"]) != "")
    first, last = F.element_at(full, 1)["line"], F.element_at(full, -1)["line"]
    content = F.array_join(F.transform(F.filter("lines", lambda x: (x["line"] >= first) & (x["line"] <= last)), lambda x: x["text"]), "\n")
    return grouped.filter(F.size(full) > 0).select("doc_id", F.coalesce("heading_path", F.lit("[Overview / Preamble]")).alias("heading_path"), F.coalesce("level", F.lit(0)).alias("heading_level"), (first + 1).cast("int").alias("start_line"), (last + 1).cast("int").alias("end_line"), content.alias("content"))


def outline(sections: DataFrame) -> DataFrame:
    """One row for each base_path of a document: tokens summed, parts counted, the last line."""
    return sections.groupBy("doc_id", "base_path").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum(token_estimate(F.col("content"))).alias("tokens"), F.count_if(F.col("part_index") > 0).alias("parts"), F.min("heading_level").alias("heading_level"))


def joined_parts(sections: DataFrame) -> DataFrame:
    """Parts of a base_path put together byte for byte: the newlines between follow from the line numbers."""
    order = Window.partitionBy("doc_id", "base_path").orderBy("part_index")
    gap = F.greatest(F.lit(0), F.col("start_line") - F.lag("end_line").over(order))
    spaced = sections.withColumn("piece", F.concat(F.coalesce(F.repeat(F.lit("\n"), gap.cast("int")), F.lit("")), "content"))
    return spaced.groupBy("doc_id", "base_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_index", "piece"))), lambda x: x["piece"]), "").alias("content"))


def normal_path(path: Column) -> Column:
    return F.trim(F.regexp_replace(path, r"\s*>\s*", PATH_SEPARATOR))


def resolve(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, matches, heading_path) of (query_id, doc_id, path): the first tier with a match decides.

    Whole paths come first, as written, then with even spacing, then in any case; then the same for paths that end
    with what was asked. More than one match is ambiguous and names none.
    """
    own = sections.select("doc_id", "heading_path").distinct()
    met = asked.join(own, "doc_id")
    want, have = F.col("path"), F.col("heading_path")
    even, low = normal_path(want), casefolded(normal_path(want))
    tiers = [have == want, have == even, casefolded(have) == low]
    tiers += [have.endswith(F.concat(F.lit(PATH_SEPARATOR), x)) for x in (want, even)] + [casefolded(have).endswith(F.concat(F.lit(PATH_SEPARATOR), low))]
    tier = F.lit(None).cast("int")
    for n in range(len(tiers) - 1, -1, -1):
        tier = F.when(tiers[n], n).otherwise(tier)
    ranked = met.withColumn("tier", tier).filter("tier IS NOT NULL").withColumn("best", F.min("tier").over(Window.partitionBy("query_id"))).filter("tier = best")
    found = ranked.groupBy("query_id").agg(F.count("*").alias("matches"), F.min("heading_path").alias("heading_path"))
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("heading_path")).alias("heading_path"))


def with_descendants(sections: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sections of each chosen (doc_id, heading_path) and all below it, up to the next heading of its level."""
    order = Window.partitionBy("doc_id").orderBy("start_line", "part_index")
    numbered = sections.withColumn("at", F.row_number().over(order))
    heads = numbered.join(chosen, ["doc_id", "heading_path"], "left_semi").select("doc_id", F.col("heading_path").alias("asked"), F.col("at").alias("from_at"), F.col("heading_level").alias("top"))
    later = heads.join(numbered.select("doc_id", "at", "heading_level"), "doc_id").filter((F.col("at") > F.col("from_at")) & (F.col("heading_level") <= F.col("top")))
    ends = later.groupBy("doc_id", "asked").agg(F.min("at").alias("to_at"))
    span = heads.join(ends, ["doc_id", "asked"], "left")
    return span.join(numbered, "doc_id").filter((F.col("at") >= F.col("from_at")) & (F.col("to_at").isNull() | (F.col("at") < F.col("to_at")))).drop("from_at", "to_at", "top", "at")
