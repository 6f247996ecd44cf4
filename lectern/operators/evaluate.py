"""Evaluation of retrieval: grades, paired comparison, exact tests, intervals, bootstrap."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def graded(results: DataFrame, qrels: DataFrame, cut: int = 5, deepest: int = 20) -> DataFrame:
    """(query_id, rank, any_valid, ndcg) of results (query_id, label, rank) against (query_id, label, grade).

    A label is credited once, at its first rank. ``rank`` is that of a label of the highest grade within
    ``deepest``; the ideal order is that of the grades.
    """
    credit = results.groupBy("query_id", "label").agg(F.min("rank").alias("rank")).join(qrels, ["query_id", "label"])
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    got = credit.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= cut, gain).otherwise(0.0)).alias("dcg"), F.min(F.when((F.col("grade") >= 3) & (F.col("rank") <= deepest), F.col("rank"))).alias("rank"), F.max((F.col("rank") == 1).cast("int")).alias("valid"))
    placed = qrels.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "label"))).filter(F.col("place") <= cut)
    ideal = placed.groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1.0)).alias("ideal"))
    return ideal.join(got, "query_id", "left").select("query_id", F.col("rank").cast("int").alias("rank"), (F.coalesce("valid", F.lit(0)) == 1).alias("any_valid"), F.round(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"))


def rates(grades: DataFrame, *by: str) -> DataFrame:
    """Top-1, top-3 and top-5 rates, any valid first, and the mean nDCG of each group; of grades with ``ms``, its median and 95th percentile."""
    hit = [F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), 6).alias(f"top{k}") for k in (1, 3, 5)]
    latency = [F.round(F.median("ms"), 6).alias("median_ms"), F.round(nearest_rank("ms", 0.95), 6).alias("p95_ms")] if "ms" in grades.columns else []
    return grades.groupBy(*by).agg(F.count("*").alias("n"), *hit, F.round(F.avg(F.col("any_valid").cast("int")), 6).alias("any_valid"), F.round(F.avg("ndcg"), 6).alias("ndcg"), *latency)


def nth(rows: DataFrame, n: int, order: str, *by: str) -> DataFrame:
    """The row of each group with ``n`` others before it, counted from 0, in descending order; of groups with fewer, none."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc(), *[c for c in rows.columns if c not in (order, *by)]))
    return rows.withColumn("_place", place).filter(F.col("_place") == n + 1).drop("_place")


def nearest_rank(value: str, share: float) -> Column:
    """The ordered value at the nearest rank, ``share`` of the way; percentile_disc has the same definition."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def paired_violations(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(key, rule) where a candidate record (key, rank, any_valid, ndcg, hits) is worse than the base's."""
    pair = base.alias("b").join(candidate.alias("c"), "key")
    worse = F.array(
        F.when(F.col("b.rank").isNotNull() & (F.col("c.rank").isNull() | (F.col("c.rank") > F.col("b.rank"))), "rank"),
        F.when(F.col("b.any_valid") & ~F.col("c.any_valid"), "any_valid"),
        F.when(F.col("c.ndcg") < F.col("b.ndcg") - 1e-9, "ndcg"),
        F.when((F.col("b.hits") > 0) & (F.col("c.hits") == 0), "empty"),
    )
    return pair.select("key", F.explode(F.filter(worse, lambda x: x.isNotNull())).alias("rule"))


def binomial_tail(wins: int, losses: int, two_sided: bool) -> float:
    """The exact chance of an outcome at least so uneven, were wins and losses alike."""
    n = wins + losses
    if not n:
        return 1.0
    if two_sided:
        return min(1.0, 2 * sum(comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)
    return sum(comb(n, i) for i in range(wins, n + 1)) / 2**n


def tail_column(wins: Column, losses: Column, two_sided: bool) -> Column:
    """``binomial_tail`` as a column, in steps as many as there are outcomes.

    The chance of the middle term is a product of factors below 1, so its logarithm is a sum without cancellation; each
    further term is the one before by a ratio.
    """
    n = wins + losses
    most = F.least(wins, losses) if two_sided else F.when(wins >= losses, losses).otherwise(wins - 1)

    def upto(k: Column) -> Column:
        return F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))

    even = F.aggregate(upto(most), F.lit(0.0), lambda a, i: a + F.log1p(-1.0 / (2.0 * i)))
    middle = F.aggregate(upto(n - 2 * most), even, lambda a, i: a + F.log1p(-1.0 * i / (2.0 * (most + i))))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def further(a: Column, i: Column) -> Column:
        term = a["term"] * (most - i + 1) / (n - most + i)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    tail = F.exp(middle) * F.aggregate(upto(most), start, further, lambda a: a["total"])
    if two_sided:
        return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
    return F.when(wins == 0, 1.0).when(wins >= losses, tail).otherwise(1 - tail)


def wilson_bounds(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def drawn(clusters: DataFrame, rounds: int, seed: int = 1) -> DataFrame:
    """``clusters`` (place from 0 and other columns) drawn with replacement as often as there are, in each of ``rounds`` rounds.

    A draw is the first 32 bits of the MD5 of seed, round and turn, modulo the number of clusters, so draws are
    independent and any engine has the same. Clusters are drawn, not members: a round joins as many rows as there are
    clusters.
    """
    n = clusters.agg(F.count("*").alias("n"))
    turns = clusters.sparkSession.range(rounds).select(F.col("id").alias("round")).crossJoin(F.broadcast(n)).select("round", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("turn"))  # rounds and a count, not clusters
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col("turn").cast("string"))), 1, 8), 16, 10).cast("long")
    return turns.select("round", (number % F.col("n")).alias("place")).join(clusters, "place")


def bootstrap_ratio(clusters: DataFrame, rounds: int, seed: int = 1) -> DataFrame:
    """(round, ratio) of sums over clusters (place from 0, top, bottom) drawn with replacement."""
    return drawn(clusters, rounds, seed).groupBy("round").agg((F.sum("top") / F.sum("bottom")).alias("ratio"))


def upper_bound(ratios: DataFrame, share: float = 0.95, value: str = "ratio") -> DataFrame:
    """(rounds, bound): of n ordered values the one at int(share * n) - 1, counted from 0."""
    return ratios.agg(F.count("*").alias("rounds"), F.sort_array(F.collect_list(value)).alias("all")).select("rounds", F.element_at("all", F.greatest(F.lit(1), F.floor(F.col("rounds") * share)).cast("int")).alias("bound"))  # as many values as rounds


def recalled(results: DataFrame, qrels: DataFrame, cut: int = 5, least: int = 2) -> DataFrame:
    """(query_id, recalled) of all queries with grades: whether a label graded ``least`` or more is among the first ``cut``."""
    good = results.filter(F.col("rank") <= cut).join(qrels.filter(F.col("grade") >= least), ["query_id", "label"], "left_semi").select("query_id").distinct()
    return qrels.select("query_id").distinct().join(good.withColumn("hit", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("recalled"))


def paired_interval(clusters: DataFrame, rounds: int, margin: float, seed: int = 1) -> DataFrame:
    """(low, high, exit) of the mean paired difference: the 95 % interval over ``rounds`` resamples of documents.

    ``clusters`` has place, top (the sum of a document's differences) and bottom (its queries). The exit is 0 if the
    interval is above ``-margin``, 1 if it is below, else 2: it decides nothing.
    """
    whole = bootstrap_ratio(clusters, rounds, seed).agg(F.sort_array(F.collect_list("ratio")).alias("all"))  # as many values as rounds
    n = F.size("all")
    low, high = F.element_at("all", F.greatest(F.lit(1), F.ceil(n * 0.025)).cast("int")), F.element_at("all", F.ceil(n * 0.975).cast("int"))
    return whole.select(low.alias("low"), high.alias("high")).withColumn("exit", F.when(F.col("low") > -margin, 0).when(F.col("high") < -margin, 1).otherwise(2))


def weighted_kappa(pairs: DataFrame, highest: int) -> DataFrame:
    """(items, kappa) of pairs (a, b) of grades from 0 to ``highest``: agreement beyond chance, disagreements weighed by their distance."""
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("items"), F.sum(F.col("n") * F.abs(F.col("a") - F.col("b"))).alias("seen"))
    left, right = counts.groupBy("a").agg(F.sum("n").alias("left")), counts.groupBy("b").agg(F.sum("n").alias("right"))
    chance = left.crossJoin(right).agg(F.sum(F.col("left") * F.col("right") * F.abs(F.col("a") - F.col("b"))).alias("expected"))  # grades, of which there are few
    return total.crossJoin(chance).select("items", F.when(F.col("expected") == 0, 1.0).otherwise(1 - F.col("seen") * F.col("items") / F.col("expected")).alias("kappa"))


def resolved_labels(labels: DataFrame, sections: DataFrame) -> DataFrame:
    """(label, matches, file_path, heading_path): which section a label names; more or fewer than one is a fault of the label.

    A label is a heading path, or that after the end of a file's path and two colons. ``sections`` has file_path and
    heading_path. Each section's file is spelled by the ends of its path, so labels are joined and not tried one by one.
    """
    parts = F.split("file_path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("::", F.array_join(F.slice(parts, i, F.size(parts)), "/"), F.col("heading_path")))
    spelled = sections.distinct().select("file_path", "heading_path", F.explode(F.concat(F.array("heading_path"), ends)).alias("label"))
    found = labels.select("label").distinct().join(spelled, "label", "left")
    found = found.groupBy("label").agg(F.count("file_path").alias("matches"), F.min("file_path").alias("file_path"), F.min("heading_path").alias("heading_path"))
    return found.select("label", "matches", *[F.when(F.col("matches") == 1, F.col(c)).alias(c) for c in ("file_path", "heading_path")])


def contained_phrases(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of items (item_id, text) whose tokens are a run of the document's (doc_id, text), whole.

    An item is looked for by the one of its tokens that the fewest documents have, and compared whole with those alone.
    Items without tokens are in nothing.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    phrase = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    own = items.select("item_id", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    own = own.select("item_id", phrase(F.col("t")).alias("phrase"), F.array_distinct("t").alias("t"))
    wanted = own.select(F.explode("t").alias("token")).distinct()
    sent = (lambda df: F.broadcast(df)) if _small(wanted) else (lambda df: df)
    held = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    often = held.join(sent(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.select("item_id", F.explode("t").alias("token")).join(often, "token", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
    rarest = rarest.filter("r.n > 0").select("item_id", "r.token")
    met = held.join(sent(rarest), "token").select("item_id", "doc_id").distinct()
    texts = docs.select("doc_id", "text").join(met, "doc_id").select("item_id", "doc_id", phrase(tokens(F.col("text"))).alias("own"))
    return texts.join(own.select("item_id", "phrase"), "item_id").filter(F.col("own").contains(F.col("phrase"))).select("item_id", "doc_id").distinct()


def _small(rows: DataFrame, most: int = 50_000) -> bool:
    """Whether so few short rows are asked for that they may go to all tasks."""
    return rows.limit(most + 1).count() <= most


def no_answer(pages: DataFrame, *by: str) -> DataFrame:
    """Of pages (hits, no_match, payload) for questions without an answer: how many were left empty, how many had no keyword, and the usual payload."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return pages.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("hits") == 0).alias("abstained"), share(F.col("no_match")).alias("no_match"), F.round(F.median("payload"), 6).alias("payload"))


def fingerprints(rows: DataFrame, by: list[str], order: str, value: str, fan: int = 1000, levels: int = 4) -> DataFrame:
    """(by..., digest): a digest of each group's ``value`` in the order of the whole number ``order``, by a tree.

    Rows whose numbers agree but for the last three digits are digested together, then what they gave, and so on, so
    that no task has more than ``fan`` rows of a node, however large a group is.
    """
    own = rows.select(*by, F.col(order).cast("long").alias("at"), F.sha2(F.coalesce(F.col(value).cast("string"), F.lit("")), 256).alias("digest"))
    for _ in range(levels):
        listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda s: F.concat(s["at"].cast("string"), F.lit(":"), s["digest"]))
        own = own.groupBy(*by, F.floor(F.col("at") / fan).alias("up")).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("digest")).withColumnRenamed("up", "at")
    return own.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda s: s["digest"]), "\n"), 256).alias("digest"))


def deltas(scores: DataFrame, baseline: DataFrame, fields: list[str]) -> DataFrame:
    """(name, field, delta, note) of scores and a frozen baseline, both (name, cases, fields...): percentage points, where both were scored on the same cases."""
    old = baseline.select("name", F.col("cases").alias("_cases"), *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_known"))
    note = F.when(F.col("_known").isNull(), "no baseline").when(F.col("_cases").isNull(), "baseline of unknown cases").when(F.col("_cases") != F.col("cases"), "baseline of other cases")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), ((F.col(f) - F.col(f"_{f}")) * 100).alias("delta")) for f in fields]))
    return scores.join(old, "name", "left").withColumn("note", note).select("name", "note", each.alias("x")).select("name", "x.field", F.round(F.when(F.col("note").isNull(), F.col("x.delta")), 6).alias("delta"), "note")


def below_floors(scores: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(name, field, value) of scores that are under their floor."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(float(x)).alias("floor")) for f, x in floors.items()]))
    return scores.select("name", each.alias("x")).filter("x.value < x.floor").select("name", "x.field", "x.value")


def latency_verdict(times: DataFrame, *by: str, median: float = 0.10, p95: float = 0.25) -> DataFrame:
    """Whether ``on`` is slower than off, of (on, ms), by no more than the ceilings: as ratios of medians and of 95th percentiles."""
    side = lambda on: F.when(F.col("on") == on, F.col("ms"))
    at95 = lambda on: F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN `on` = {str(on).lower()} THEN ms END)")
    found = times.groupBy(*by).agg((F.median(side(True)) / F.median(side(False))).alias("median"), (at95(True) / at95(False)).alias("p95"))
    return found.select(*by, F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), ((F.col("median") <= 1 + median) & (F.col("p95") <= 1 + p95)).alias("held"))


def harms(grades: DataFrame, points: float = 0.15, abstentions: int = 2) -> DataFrame:
    """(agent, drop, fewer, harm) of (agent, task, answerable, a, b), the grades of both arms of a task.

    Arm b does harm if its share of correct answers is ``points`` or more below a's, or if it abstains rightly on
    ``abstentions`` fewer tasks that have no answer.
    """
    asked, unasked = F.col("answerable"), ~F.col("answerable")
    lost = F.count_if(asked & (F.col("a") == "correct")) - F.count_if(asked & (F.col("b") == "correct"))
    found = grades.groupBy("agent").agg(lost.alias("lost"), F.count_if(asked).alias("asked"), (F.count_if(unasked & (F.col("a") == "abstained")) - F.count_if(unasked & (F.col("b") == "abstained"))).alias("fewer"))
    # Whole numbers, as a share of exactly 15 points counts.
    return found.select("agent", F.round(F.when(F.col("asked") > 0, F.col("lost") / F.col("asked")).otherwise(0.0), 6).alias("drop"), "fewer", ((F.col("asked") > 0) & (F.col("lost") * 100 >= F.col("asked") * round(points * 100)) | (F.col("fewer") >= abstentions)).alias("harm"))


def ships(effects: DataFrame, harmed: DataFrame) -> DataFrame:
    """(ship): an effect (agent, effect) for one agent at least and harm (agent, harm) for none."""
    return effects.join(harmed, "agent", "full_outer").agg((F.coalesce(F.bool_or("effect"), F.lit(False)) & ~F.coalesce(F.bool_or("harm"), F.lit(False))).alias("ship"))


def adoption_by(pairs: DataFrame, *by: str) -> DataFrame:
    """Of kept pairs (a, b: whether each arm's session adopted): counts of both arms with b's interval, and the paired difference."""
    found = pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if("a").alias("a"), F.count_if("b").alias("b"), (F.count_if(F.col("b") & ~F.col("a")) - F.count_if(F.col("a") & ~F.col("b"))).alias("difference"))
    low, high = wilson_bounds(F.col("b"), F.col("pairs"))
    return found.select("*", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def kept_attempts(attempts: DataFrame, expected: DataFrame) -> DataFrame:
    """(task, a, b, state) of attempts (task, arm, attempt, value) at the expected tasks: the last attempt of each arm.

    A pair is kept if both arms' last attempts have a value, dropped if one has none, missing if an arm never ran.
    """
    last = attempts.groupBy("task", "arm").agg(F.max_by(F.struct("value"), "attempt").alias("last"))
    pair = last.groupBy("task").agg(F.max(F.when(F.col("arm") == "A", F.col("last"))).alias("a"), F.max(F.when(F.col("arm") == "B", F.col("last"))).alias("b"))
    state = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a.value").isNull() | F.col("b.value").isNull(), "dropped").otherwise("kept")
    return expected.select("task").distinct().join(pair, "task", "left").select("task", F.col("a.value").alias("a"), F.col("b.value").alias("b"), state.alias("state"))


def judge_items(hits: DataFrame, seed: str) -> DataFrame:
    """What a judge sees of each hit (item, query, file_path, heading_path, content, section, payload, whole) and its key.

    The excerpt (content) and the whole section are shown as A and B in an order that a digest draws; a hit without an
    excerpt shows the section alone. Costs are token estimates, and texts are bound to their verdicts by digests.
    """
    tokens = lambda c: F.when(F.length(c) == 0, 0).otherwise(F.ceil(F.length(c) / 4)).cast("bigint")
    cut, first = F.col("content") != F.col("section"), F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("item").cast("string"))), 1, 1) < "8"
    excerpt = F.when(cut, F.when(first, "A").otherwise("B"))
    return hits.select(
        "item", "query", F.concat_ws(" :: ", "file_path", "heading_path").alias("cluster"),
        F.when(cut & ~first, F.col("section")).otherwise(F.col("content")).alias("a"), F.when(cut, F.when(first, F.col("section")).otherwise(F.col("content"))).alias("b"),
        excerpt.alias("excerpt"), F.when(excerpt == "A", "B").otherwise("A").alias("whole_as"),
        tokens(F.col("payload")).alias("payload_tokens"), tokens(F.col("whole")).alias("whole_tokens"), tokens(F.col("section")).alias("read_tokens"),
        F.sha2("query", 256).alias("query_sha256"), F.sha2("section", 256).alias("section_sha256"),
    )


def verdict_errors(items: DataFrame, verdicts: DataFrame, allowed: list[str]) -> DataFrame:
    """(item, error) of a judge's verdicts (item, verdict): for items it was not given, given twice, of no known kind, or missing."""
    counted = verdicts.groupBy("item").agg(F.count("*").alias("n"), F.min(F.col("verdict").isin(*allowed)).alias("known"))
    both = items.select("item", F.lit(True).alias("given")).distinct().join(counted, "item", "full_outer")
    error = F.when(F.col("given").isNull(), "not given").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "twice").when(~F.coalesce("known", F.lit(False)), "malformed")
    return both.select("item", error.alias("error")).filter("error IS NOT NULL")


def merged_grades(grades: DataFrame, scale: list[str]) -> DataFrame:
    """(item, grade, disagreed) of two graders' (item, a, b, key): where they agree their grade, else the key's, else the lower on the ``scale``."""
    place = F.array(*map(F.lit, scale))
    lower = F.element_at(place, F.least(F.array_position(place, F.col("a")), F.array_position(place, F.col("b"))).cast("int"))
    return grades.select("item", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.coalesce("key", lower)).alias("grade"), (F.col("a") != F.col("b")).alias("disagreed"))


def payload_ratios(pages: DataFrame, *by: str) -> DataFrame:
    """What an answer costs, of (payload, answer) in tokens: the median and the 95th percentile of their ratio, and all payload."""
    each = pages.withColumn("_ratio", F.col("payload") / F.col("answer"))
    return each.groupBy(*by).agg(F.round(F.median("_ratio"), 6).alias("median_ratio"), F.round(nearest_rank("_ratio", 0.95), 6).alias("p95_ratio"), F.sum("payload").cast("long").alias("total"))


def replayed(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Texts that are asked (text) with what is stored for the same text, and whether nothing is."""
    return asked.select("text").distinct().join(stored.withColumn("_there", F.lit(True)), "text", "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def record_errors(records: DataFrame, constraints: dict[str, Column], strata: str | None = None, sizes: dict | None = None) -> DataFrame:
    """(key, error) of records that break a constraint, share their key, or belong to a stratum of another size than it must have (key null)."""
    broken = F.filter(F.array(*[F.when(F.coalesce(~holds, F.lit(True)), message) for message, holds in constraints.items()]), lambda e: e.isNotNull())
    out = records.select("key", F.explode(broken).alias("error"))
    out = out.unionByName(records.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit("key used twice").alias("error")))
    if strata and sizes:
        wanted = records.sparkSession.createDataFrame([(str(k), int(n)) for k, n in sizes.items()], "stratum string, wanted long")
        found = records.groupBy(F.col(strata).cast("string").alias("stratum")).agg(F.count("*").alias("n"))
        off = wanted.join(found, "stratum", "full_outer").filter(~F.col("n").eqNullSafe(F.col("wanted")))
        out = out.unionByName(off.select(F.lit(None).cast(records.schema["key"].dataType).alias("key"), F.concat(F.lit("stratum "), "stratum", F.lit(" has "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" of "), F.coalesce("wanted", F.lit(0)).cast("string")).alias("error")))
    return out


def retention(judged: DataFrame, *by: str) -> DataFrame:
    """How often excerpts kept the answer, of (kept, cost, whole): the share, and their cost with a second read of the whole where they did not, over that of whole sections."""
    cost = F.col("cost") + F.when(F.col("kept"), 0).otherwise(F.col("whole"))
    return judged.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("kept").cast("int")), 6).alias("retention"), F.round(F.sum(cost) / F.sum("whole"), 6).alias("cost_ratio"))


def majority(votes: DataFrame) -> DataFrame:
    """(item, yes, majority) of judges' votes (item, vote): whether more than half said 1."""
    return votes.groupBy("item").agg(F.sum("vote").cast("long").alias("yes"), (2 * F.count_if(F.col("vote") == 1) > F.count("*")).alias("majority"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(item, drift) of what keeps a frozen set of (item, value) from being the same set: missing, added or changed."""
    both = old.select("item", F.struct("value").alias("a")).join(new.select("item", F.struct("value").alias("b")), "item", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("item", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").otherwise("changed").alias("drift"))


def evicted(entries: DataFrame, most: int, *by: str) -> DataFrame:
    """Entries (key, size, used) of a cache to drop: those that the more recently used ones leave no room for within ``most``."""
    newer = Window.partitionBy(*by).orderBy(F.col("used").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_total", F.sum("size").over(newer)).filter(F.col("_total") > most).select(*by, "key")


def cache_key(*parts) -> Column:
    """A name for what was made of all these parts, each bound to its place."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])), 256)


def field_differences(held: DataFrame, made: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) in which two tables of metadata differ, and "missing" or "added" for rows that one has alone."""
    a, b = held.select(key, F.struct(*fields).alias("a")), made.select(key, F.struct(*fields).alias("b"))
    differ = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields]), lambda x: x.isNotNull())
    which = F.when(F.col("b").isNull(), F.array(F.lit("missing"))).when(F.col("a").isNull(), F.array(F.lit("added"))).otherwise(differ)
    return a.join(b, key, "full_outer").select(key, F.explode(which).alias("field"))


def slowest(times: DataFrame, limit: float, count: int = 10, value: str = "ms") -> DataFrame:
    """The ``count`` slowest rows over a limit."""
    return times.filter(F.col(value) > limit).orderBy(F.col(value).desc(), *[c for c in times.columns if c != value]).limit(count)


def even_spread(rows: DataFrame, count: int, by: str, order: str) -> DataFrame:
    """Of each group about ``count`` rows at an even stride in the order of ``order``: places are counted in ranges first, so no task has a group."""
    from lectern.operators.incremental import placed

    own = placed(rows, [F.col(by), F.col(order)], "_place")
    sizes = own.groupBy(by).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / count))
    at = F.col("_place") - F.col("_first")
    return own.join(sizes, by).filter((at % step == 0) & (at / step < count)).select(*rows.columns)


def churn(old: DataFrame, new: DataFrame) -> DataFrame:
    """(query_id, top1, members, order) of two rankings (query_id, item, rank): what changed."""
    def listed(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias(name))

    both = listed(old, "a").join(listed(new, "b"), "query_id", "full_outer").select("query_id", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("a", "b")])
    return both.select("query_id", (~F.get("a", F.lit(0)).eqNullSafe(F.get("b", F.lit(0)))).alias("top1"), (F.array_sort("a") != F.array_sort("b")).alias("members"), (F.col("a") != F.col("b")).alias("reordered"))
