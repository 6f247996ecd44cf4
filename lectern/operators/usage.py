"""Call logs: pairing calls with results, what follows a search, chains of searches, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paired_calls(uses: DataFrame, results: DataFrame) -> DataFrame:
    """First in, first out: the n-th use of (file, id) with the n-th result that came while a use was waiting.

    ``uses`` and ``results`` have file, id and seq. A result before any waiting use answers nothing, so results
    are counted by how far the balance of the log has been below zero.
    """
    log = uses.select("file", "id", "seq", F.lit(1).alias("step")).unionByName(results.select("file", "id", "seq", F.lit(-1).alias("step")))
    so_far = Window.partitionBy("file", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("balance", F.sum("step").over(so_far))
    log = log.withColumn("low", F.least(F.lit(0), F.coalesce(F.min("balance").over(before), F.lit(0))))
    useful = log.filter((F.col("step") == 1) | (F.col("balance") >= F.col("low")))
    numbered = useful.withColumn("turn", F.row_number().over(Window.partitionBy("file", "id", "step").orderBy("seq")))
    used = numbered.filter("step = 1").select("file", "id", "turn", F.col("seq").alias("use_seq"))
    answered = numbered.filter("step = -1").select("file", "id", "turn", F.col("seq").alias("result_seq"))
    return used.join(answered, ["file", "id", "turn"], "left").drop("turn")


def follow_ups(calls: DataFrame, reach: int = 4) -> DataFrame:
    """For each search of calls (session, idx, kind): which kinds are among its session's next ``reach`` calls."""
    ahead = Window.partitionBy("session").orderBy("idx").rowsBetween(1, reach)
    seen = calls.withColumn("next", F.collect_list("kind").over(ahead)).filter("kind = 'search'")
    return seen.select("session", "idx", *[F.array_contains("next", k).alias(f"then_{k}") for k in ("read", "search", "file", "other")])


def chains(calls: DataFrame, reach: int = 4) -> DataFrame:
    """(session, first_idx, searches) of searches each within ``reach`` calls of the one before, two or more."""
    order = Window.partitionBy("session").orderBy("idx")
    placed = calls.withColumn("at", F.row_number().over(order)).filter("kind = 'search'")
    islands = placed.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(order) > reach).cast("int"), F.lit(1))).withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("session", "chain").agg(F.min("idx").alias("first_idx"), F.count("*").alias("searches")).filter("searches > 1").drop("chain")


def sessions(calls: DataFrame) -> DataFrame:
    """Counts of each session's calls by kind, and whether it read documentation at all."""
    return calls.groupBy("session").agg(F.count("*").alias("calls"), F.count_if(F.col("kind") == "search").alias("searches"), F.count_if(F.col("kind") == "read").alias("reads"), F.count_if("failed").alias("failures"), F.bool_or(F.col("kind").isin("search", "read")).alias("documented"))


def task_context(turns: DataFrame, most: int = 400) -> DataFrame:
    """For each turn (conv_id, turn, role, text), the user's last request before it, cut to ``most`` characters."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("conv_id", "turn", F.substr(F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before), F.lit(1), F.lit(most)).alias("request"))


def distinct_queries(calls: DataFrame) -> DataFrame:
    """(query, n, places) of calls (query, place), the most frequent first."""
    return calls.groupBy("query").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("place")).alias("places")).orderBy(F.col("n").desc(), "query")


def normalised_calls(lines: DataFrame) -> DataFrame:
    """(file, seq, id, name, failed) of two agents' event logs (file, seq, line), in one shape.

    One agent's lines hold messages with parts of type tool_use and, later, tool_result; the other's hold an item once
    it is complete, a tool's or a shell command. Lines that are no JSON, or anything else, give nothing.
    """
    parsed = lines.withColumn("v", F.try_parse_json("line")).filter("v IS NOT NULL")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    part = "array<struct<type:string,id:string,name:string,tool_use_id:string,is_error:boolean>>"
    parts = parsed.select("file", "seq", F.explode(get("$.message.content", part)).alias("p"))
    uses = parts.filter("p.type = 'tool_use'").select("file", "seq", "p.id", "p.name")
    results = parts.filter("p.type = 'tool_result'").select("file", F.col("seq").alias("result_seq"), F.col("p.tool_use_id").alias("id"), F.coalesce("p.is_error", F.lit(False)).alias("failed"))
    pairs = paired_calls(uses.select("file", "id", "seq"), results.select("file", "id", F.col("result_seq").alias("seq")))
    one = uses.join(pairs.withColumnRenamed("use_seq", "seq"), ["file", "id", "seq"], "left").join(results, ["file", "id", "result_seq"], "left").select("file", "seq", "id", "name", F.coalesce("failed", F.lit(False)).alias("failed"))
    item = parsed.filter(get("$.type", "string") == "item.completed").select("file", "seq", get("$.item.type", "string").alias("kind"), get("$.item.id", "string").alias("id"), F.concat_ws("__", F.lit("mcp"), get("$.item.server", "string"), get("$.item.tool", "string")).alias("tool"), get("$.item.exit_code", "int").alias("code"), get("$.item.status", "string").alias("status"), get("$.item.error", "string").alias("error"))
    failed = F.when(F.col("kind") == "command_execution", F.coalesce(F.col("code") != 0, F.lit(False))).otherwise(F.col("error").isNotNull() | F.coalesce(F.col("status") == "failed", F.lit(False)))
    other = item.filter(F.col("kind").isin("command_execution", "mcp_tool_call")).select("file", "seq", "id", F.when(F.col("kind") == "command_execution", "Bash").otherwise(F.col("tool")).alias("name"), failed.alias("failed"))
    return one.unionByName(other)


def adopted(calls: DataFrame) -> DataFrame:
    """(session, searched, before_reading) of calls (session, idx, kind): whether it searched at all, and before it first read a file by hand."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("idx")))
    own = calls.groupBy("session").agg(first("search").alias("s"), first("file").alias("r"))
    return own.select("session", F.col("s").isNotNull().alias("searched"), (F.col("s").isNotNull() & (F.col("r").isNull() | (F.col("s") < F.col("r")))).alias("before_reading"))


def access(tool: Column, argument: Column) -> Column:
    """How a call reaches documentation: by the index's tools, by reading a Markdown file, by a shell command that prints or
    searches one, by editing one, or not at all. ``argument`` is the path or the command."""
    markdown = F.regexp_like(argument, F.lit(r"(?i)\.(?:md|markdown)\b"))
    shell = F.regexp_like(argument, F.lit(r"(?:^|[;&|(\s])(?:cat|less|more|head|tail|sed|awk|grep|rg|bat)\s"))
    return (
        F.when(tool.startswith("mcp__docs__"), "index")
        .when(tool.isin("Edit", "Write") & markdown, "edit")
        .when((tool == "Read") & markdown, "file")
        .when((tool == "Bash") & markdown & shell, "shell")
        .otherwise("none")
    )


def access_report(calls: DataFrame) -> DataFrame:
    """(access, n, failed, share) of calls (session, tool, argument, failed). A file that its session edits is work, not documentation, and does not count as read."""
    own = calls.withColumn("access", access(F.col("tool"), F.col("argument")))
    edited = own.filter("access = 'edit'").select("session", F.col("argument").alias("edited")).distinct()
    kept = own.filter("access <> 'file'").unionByName(own.filter("access = 'file'").join(edited, (own["session"] == edited["session"]) & (own["argument"] == edited["edited"]), "left_anti"))
    counts = kept.groupBy("access").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    return counts.select("access", "n", "failed", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))
