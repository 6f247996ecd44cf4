"""A documentation index over a folder: index it, list it, read it, search it."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.stem import stemmed
from lectern.functions.text import preview, walk_key
from lectern.operators import incremental, keyword, navigate, vector
from lectern.operators.literal import excerpt, literal_ranking
from lectern.schema import CANDIDATES, LIMIT_MOST, LITERAL_CANDIDATES, MAX_QUERY_TERMS, PASSAGES_PER_CANDIDATE, RRF_K
from lectern.sources import markdown
from lectern.sources.scope import exclusive, ignored, inside, locked, valid_path, without_ignored
from lectern.sources.snapshot import Index

Embedder = Callable[[DataFrame], DataFrame]
#: Failures that a report names; it counts all of them, and ``Engine.failures`` lists them.
FAILURES_NAMED = 1000
VECTOR_FORMAT = 2
#: A pointer with this for weights says that the vectors are not to be trusted.
REVOKED = "(revoked)"
# What a page says for each state of the keyword lane.
MESSAGES = {
    "indexing": "The index is being written; results may lack documents.",
    "abstained": "No section in scope holds what was looked up.",
    "no_terms": "The query has no terms to look for.",
    "no_match": "No section holds any term; results are by meaning alone.",
    "filtered": "Sections hold too little of the query; results are by meaning alone.",
    "unavailable": "The keyword lane failed; results are by meaning alone.",
}


@dataclass
class Report:
    """What an indexing run did: files by state, failures, and vectors embedded and taken over."""

    states: dict[str, int]
    failures: dict[str, str]
    sections: int
    generation: int
    failed: int = 0
    embedded: int = 0
    reused: int = 0
    git: str = "off"


@dataclass
class Hit:
    section_id: int
    file_path: str
    heading_path: str
    start_line: int
    end_line: int
    score: float
    content: str
    preview: str = ""
    excerpt: tuple[int, int] | None = None


@dataclass
class Page:
    keyword_match: str
    hits: list[Hit] = field(default_factory=list)
    abstained: bool = False
    indexing: bool = False

    @property
    def message(self) -> str | None:
        """What the page says beside its hits: that the index is being written first, then that nothing was found, then how."""
        return MESSAGES.get("indexing" if self.indexing else "abstained" if self.abstained else self.keyword_match)

    def as_dict(self) -> dict:
        """The first hit with its text or excerpt, the others as pointers with a preview."""
        out = []
        for i, hit in enumerate(self.hits):
            row = asdict(hit)
            text, short, window = row.pop("content"), row.pop("preview"), row.pop("excerpt")
            if i:
                row["preview"] = short
            else:
                row["content"] = text if window is None else "\n".join(text.split("\n")[slice(*window)])
            out.append(row)
        return {"keyword_match": self.keyword_match, "results": out} | ({"message": self.message} if self.message else {})


class Ambiguous(LookupError):
    """More than one document or section fits what was asked."""


class ForeignWeights(RuntimeError):
    """The index holds vectors of other weights than the query's."""


class Engine:
    """``home`` holds the snapshots; ``embed`` makes (owner_id, embedding) of (owner_id, text), ``weights`` names its
    model, and ``analyze`` makes tokens of a text."""

    def __init__(self, spark: SparkSession, home: str, embed: Embedder = vector.hashed_embeddings, weights: str = "hashed-64", analyze: keyword.Analyzer = stemmed):
        self.spark, self.index, self.embed, self.weights, self.analyze = spark, Index(spark, home), embed, weights, analyze

    # -- indexing

    def index_directory(self, directory: str, exclude: list[str] | None = None, force: bool = False, stop: Callable[[], bool] | None = None) -> Report:
        """Bring the index in line with a folder: only new and changed files are parsed, only texts that no vector was
        made of before are embedded, and vanished files go where their absence is evidence.

        All of it becomes visible at once, after the new snapshot was checked. A second run at the same time is refused;
        one that was overtaken, or that ``stop`` asks to end, leaves nothing. With ``force`` everything is made anew.
        """
        with exclusive(self.spark, self.index.root):
            return self._index(directory, exclude, force, stop or (lambda: False))

    def _index(self, directory: str, exclude: list[str] | None, force: bool, stop: Callable[[], bool]) -> Report:
        began = self.index.current(migrate=True)
        git, left_out = ignored(directory)
        walked = markdown.walk(self.spark, directory)
        files = without_ignored(markdown.scan(self.spark, directory, exclude, walked), left_out).withColumn("doc_id", F.xxhash64("file_path"))
        manifest = files.select("file_path", "content_hash", F.lit(VECTOR_FORMAT).alias("vector_format"), F.lit(self.weights).alias("weights_revision"), F.col("mtime").alias("mtime_ns"), "length", "doc_id")
        snapshot = began["snapshot"] if began else None
        old = self.index.table("manifest", snapshot) if began else None
        if old is None or force:
            states = manifest.select("file_path", F.lit("new" if old is None else "changed").alias("state"))
        else:
            # Vectors that were revoked are no ground to leave a file alone.
            trusted = old if began.get("weights") != REVOKED else old.withColumn("weights_revision", F.lit(None).cast("string"))
            states = incremental.manifest_diff(trusted, manifest)
        states = states.cache()
        parsed = markdown.parsed(files.join(states.filter("state IN ('new', 'changed')"), "file_path", "left_semi")).cache()
        water = (began or {}).get("high_water", 0)
        numbered = incremental.numbered(markdown.sections(parsed), [walk_key(F.col("file_path")), F.col("place")], water).cache()
        titles = parsed.select("file_path", "title", "error")
        sections, known, hidden = numbered, titles, None
        if old is not None and not force:
            hidden = states.filter("state = 'vanished'").join(incremental.purged(old, files, walked.unreachable), "file_path", "left_anti").select("file_path")
            stays = states.filter("state IN ('unchanged', 'touched')").select("file_path").unionByName(hidden)
            sections = numbered.unionByName(self.index.table("sections", snapshot).join(stays, "file_path", "left_semi").select(*numbered.columns))
            known = titles.unionByName(self.index.table("documents", snapshot).select("file_path", "title", "error").join(stays, "file_path", "left_semi"))
            manifest = manifest.unionByName(old.select(*manifest.columns).join(hidden, "file_path", "left_semi"))
        if stop():
            raise InterruptedError("stopped before anything was written")
        fresh = numbered.select("section_id", "heading_path", F.posexplode("passages").alias("ordinal", "p")).select(F.xxhash64("section_id", "ordinal").alias("owner_id"), "section_id", "ordinal", F.col("p.text").alias("text"), F.concat_ws(": ", "heading_path", "p.text").alias("embedded"))
        units, embedded, reused = self._embedded(fresh, snapshot if began and began.get("weights") == self.weights and not force else None)
        if old is not None and not force:
            units = units.unionByName(self.index.table("units", snapshot).select(*units.columns).join(sections.select("section_id"), "section_id", "left_semi"))
        vectors = vector.pooled(units.select(F.col("section_id").alias("owner_id"), "ordinal", "embedding")).withColumnRenamed("owner_id", "section_id")
        highest = numbered.agg(F.coalesce(F.max("section_id"), F.lit(water)).alias("n")).first()["n"]
        tables = {"manifest": manifest, "documents": known, "sections": sections, "units": units, "vectors": vectors}
        tables["postings"] = keyword.stored_order(keyword.postings(sections, analyze=self.analyze))
        tables["lengths"] = keyword.lengths(sections, analyze=self.analyze)
        verified = not walked.unreachable and git != "unavailable"
        made = self.index.commit(tables, began, check=self._checked, high_water=highest, root=directory, verified=verified, git=git)
        counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
        failures = self.failures()
        named = {r["file_path"]: r["error"] for r in failures.orderBy("file_path").limit(FAILURES_NAMED).collect()}
        report = Report(counts, named, self.index.table("sections").count(), made["generation"], failures.count(), embedded, reused, git)
        for frame in (states, parsed, numbered):
            frame.unpersist()
        return report

    def _embedded(self, fresh: DataFrame, snapshot: str | None) -> tuple[DataFrame, int, int]:
        """(section_id, ordinal, text, embedded, embedding) of new passages, how many were embedded, and how many had their vector from the same text before."""
        wanted = fresh.select("owner_id", F.col("embedded").alias("text"))
        if snapshot is None:
            found = self.embed(wanted)
            embedded, reused = wanted.count(), 0
        else:
            known = self.index.table("units", snapshot).select(F.col("embedded").alias("text"), "embedding", F.col("section_id").alias("source_id"))
            met = incremental.reused(wanted, known).cache()
            made = self.embed(met.filter("embedding IS NULL").select("owner_id", "text"))
            found = made.unionByName(met.filter("embedding IS NOT NULL").select("owner_id", "embedding"))
            reused = met.filter("embedding IS NOT NULL").count()
            embedded = met.count() - reused
        return fresh.join(found, "owner_id").select("section_id", "ordinal", "text", "embedded", "embedding"), embedded, reused

    def _checked(self, tables: Callable[[str], DataFrame], began: dict | None) -> dict:
        """What a new snapshot says of its vectors; raises if its parts do not fit together."""
        vectors = tables("vectors")
        widths = vectors.select(F.size("embedding").alias("n")).distinct().limit(2).collect()
        if len(widths) > 1:
            raise ValueError("vectors of more than one width")
        dim = widths[0]["n"] if widths else None
        if began and dim and began.get("dim") not in (None, dim) and began.get("weights") == self.weights:
            raise ValueError(f"vectors of {dim} places where the index has {began['dim']}")
        sections = tables("sections")
        problems = incremental.integrity_problems(tables("manifest"), sections, tables("units"), vectors, dim or 0).limit(3).collect()
        if problems:
            raise ValueError("; ".join(f"{p['problem']}: {p['id']}" for p in problems))
        owners = vectors.join(sections.select("section_id", "doc_id"), "section_id").select("doc_id")
        certified = incremental.certifiable(tables("manifest"), owners, self.weights).isEmpty()
        # Without a vector there is nothing that weights were needed for.
        return {"dim": dim, "weights": None if dim is None else self.weights if certified else REVOKED}

    def revoke(self, reason: str) -> None:
        """Trust none of the stored vectors from now on: searches are refused until the next run has made them anew."""
        with exclusive(self.spark, self.index.root):
            self.index.renote(weights=REVOKED, reason=reason, notices=[*(self.index.current() or {}).get("notices", []), f"vectors revoked: {reason}"])

    def notices(self) -> list[str]:
        """What there is to say since the last call; it is kept until it was said."""
        found = (self.index.current() or {}).get("notices", [])
        if found:
            self.index.renote(notices=[])
        return found

    def failures(self) -> DataFrame:
        """(file_path, error) of all files that could not be parsed."""
        return self.index.table("documents").filter("error IS NOT NULL").select("file_path", "error")

    # -- standing

    def changes(self, directory: str, exclude: list[str] | None = None) -> DataFrame:
        """(file_path, state) of a folder's files against the index. Times and lengths are compared first; only files that moved are read."""
        walked = markdown.walk(self.spark, directory)
        left_out = ignored(directory)[1]
        listed = without_ignored(markdown.listing(self.spark, directory, exclude, walked), left_out)
        old = self.index.table("manifest")
        same = old.join(listed, (old["file_path"] == listed["file_path"]) & (old["mtime_ns"] == listed["mtime"]) & (old["length"] == listed["length"]), "left_semi").withColumn("weights_revision", F.lit(self.weights)).select(*old.columns)
        moved = listed.join(same, "file_path", "left_anti")
        read = markdown.read(self.spark, directory, moved, walked)
        manifest = read.select("file_path", "content_hash", F.lit(VECTOR_FORMAT).alias("vector_format"), F.lit(self.weights).alias("weights_revision"), F.col("mtime").alias("mtime_ns"))
        return incremental.manifest_diff(old, manifest.unionByName(same.select(*manifest.columns)))

    def status(self, directory: str, exclude: list[str] | None = None) -> dict:
        """How the index stands against a folder: counts, the first directories with stale documents, and a verdict."""
        busy, current = locked(self.spark, self.index.root), self.index.current()
        if current is None:
            return {"verdict": "empty", "indexed": 0, "failed": 0, "stale": 0, "directories": [], "indexing": busy}
        stale = self.changes(directory, exclude).filter("state IN ('new', 'changed', 'vanished')").cache()
        documents = self.index.table("documents").agg(F.count("*").alias("indexed"), F.count("error").alias("failed"))
        one = documents.crossJoin(stale.agg(F.count("*").alias("stale")))  # single rows
        row = one.select("*", incremental.verdict(F.col("indexed"), F.col("failed"), F.col("stale"), F.lit(bool(current.get("verified")))).alias("verdict")).first()
        folders = stale.select(F.regexp_replace("file_path", "/?[^/]*$", "").alias("d")).distinct().orderBy("d").limit(3).collect()
        stale.unpersist()
        return row.asDict() | {"directories": [r["d"] for r in folders], "weights_agree": current["weights"] in (None, self.weights), "indexing": busy, "root": current["root"], "git": current.get("git", "off")}

    def why_not(self, directory: str, path: str, exclude: list[str] | None = None) -> str:
        """Why a path is not in the index, or that it is."""
        if (problem := valid_path(path)) or not inside(directory, path):
            return problem or "outside the folder"
        name = posixpath.relpath(path, directory) if path.startswith("/") else posixpath.normpath(path)
        if not self.index.table("documents").filter((F.col("file_path") == name) & F.col("error").isNull()).isEmpty():
            return "indexed"
        failed = self.failures().filter(F.col("file_path") == name).first()
        return f"not readable: {failed['error']}" if failed else markdown.why_left_out(self.spark, directory, name, exclude or [], ignored(directory)[1])

    # -- reading

    def sections(self) -> DataFrame:
        return self.index.table("sections")

    def positions(self, ids: list[int]) -> DataFrame:
        """(section_id, file_path, start_line, part_index) of sections."""
        return self.sections().filter(F.col("section_id").isin(ids)).select("section_id", "file_path", "start_line", "part_index")

    def below(self, directory: str) -> DataFrame:
        """(section_id) of sections of files below a directory."""
        return self.sections().filter(F.col("file_path").startswith(directory.rstrip("/") + "/")).select("section_id")

    def list_documents(self) -> DataFrame:
        """(file_path, title, sections), in the order of a walk."""
        counts = self.sections().groupBy("file_path").agg(F.count("*").alias("sections"))
        return self.index.table("documents").join(counts, "file_path", "left").select("file_path", "title", F.coalesce("sections", F.lit(0)).alias("sections")).orderBy(walk_key(F.col("file_path")))

    def document(self, path: str, cwd: str | None = None) -> str:
        """The one document of a path: as it is, from the folder's root or from ``cwd``, with . and .. resolved, or the only one that ends with it."""
        if problem := valid_path(path):
            raise Ambiguous(f"{path!r}: {problem}")
        root = (self.index.current() or {}).get("root", "")
        spelled = [path, *([posixpath.join(cwd, path)] if cwd else [])]
        spelled += [posixpath.normpath(p) for p in spelled]
        tried = list(dict.fromkeys(posixpath.relpath(p, root) if p.startswith("/") and root.startswith("/") else p for p in spelled))
        files = self.index.table("documents").filter(F.col("file_path").isin(tried) | F.col("file_path").endswith("/" + posixpath.normpath(path))).select("file_path").limit(11).collect()
        names = [r["file_path"] for r in files]
        for name in tried:
            if name in names:
                return name
        if len(names) != 1:
            raise Ambiguous(f"{path}: {', '.join(names) or 'not indexed'}")
        return names[0]

    def outline(self, path: str) -> DataFrame:
        """(base_path, heading_level, start_line, end_line, tokens, parts) of a document, in its order."""
        own = self.sections().filter(F.col("file_path") == self.document(path))
        return navigate.outline(own).drop("doc_id").orderBy("start_line", "base_path")

    def read_section(self, path: str, heading: str | None = None, below: bool = True) -> str:
        """A section's text with what lies below it; without a heading, the whole document."""
        own = self.sections().filter(F.col("file_path") == self.document(path))
        if heading is not None:
            asked = own.select("doc_id").limit(1).select(F.lit(0).alias("query_id"), "doc_id", F.lit(heading).alias("path"))
            paths = own.withColumn("heading_path", F.col("base_path")).unionByName(own.filter("part_index > 0"))
            found = navigate.resolve(paths, asked).first()
            if found is None or found["matches"] != 1:
                raise Ambiguous(f"{heading}: {found['matches'] if found else 0} sections")
            chosen = own.filter((F.col("base_path") == found["heading_path"]) | (F.col("heading_path") == found["heading_path"]))
            if below:
                chosen = navigate.with_descendants(own.withColumn("heading_path", F.when(F.col("part_index") > 1, F.col("heading_path")).otherwise(F.col("base_path"))), chosen.limit(1).select("doc_id", F.col("base_path").alias("heading_path")))
            own = chosen
        rows = own.select("start_line", "end_line", "part_index", "content").orderBy("start_line", "part_index").collect()
        out, before = "", None
        for row in rows:
            out += "\n" * max(0, row["start_line"] - before) if before is not None else ""
            out, before = out + row["content"], row["end_line"]
        return out

    # -- searching

    def search(self, query: str, limit: int = 5, scope: str = "") -> Page:
        """The sections that answer a query: keyword and vector lanes, fused; identifiers as themselves first.

        A lookup of identifiers that no section in scope holds gives an empty page. ``scope`` is a folder's path; it
        chooses what is ranked, while BM25 keeps the statistics of the whole index. A lane that fails leaves the answer
        to the other; if both fail, the search does.
        """
        limit, current = max(1, min(limit, LIMIT_MOST)), self.index.current()
        busy = locked(self.spark, self.index.root)
        if current is None or not query.strip():
            return Page("no_terms", indexing=busy)
        self._trusted(current)
        read = lambda name: self.index.table(name, current["snapshot"])
        everything = read("sections").drop("passages")
        own = everything.filter(F.col("file_path").startswith(scope.rstrip("/") + "/")) if scope else everything
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        errors: list[Exception] = []
        most = max(CANDIDATES, limit)
        state, words, lexical, first, literal = "unavailable", [], [], [], []
        try:
            state, words, lexical, first, literal = self._keywords(read, everything, own, asked, most, bool(scope))
        except PySparkException as error:
            errors.append(error)
        lookup = 0 < len(words) < MAX_QUERY_TERMS and all(w["identifier"] for w in words)
        if lookup and state == "no_match":
            return Page(state, abstained=True, indexing=busy)
        semantic: list[int] = []
        best: dict[int, int] = {}
        if current["weights"] is not None:
            try:
                semantic, best = self._neighbours(read, own, asked, most)
            except PySparkException as error:
                errors.append(error)
                if len(errors) > 1:
                    raise
        elif errors:
            raise errors[0]
        # At most a few hundred ids from here on.
        scores: dict[int, float] = {}
        for lane in (lexical, semantic):
            for i, s in enumerate(lane, 1):
                scores[s] = round(scores.get(s, 0.0) + 1 / (RRF_K + i), 9)
        ids = list(dict.fromkeys([*scores, *first, *literal]))
        wanted = own.filter(F.col("section_id").isin(ids)).select("section_id", "file_path", "heading_title", "heading_path", "start_line", "end_line", "part_index", walk_key(F.col("file_path")).alias("walk"))
        rows = {r["section_id"]: r for r in wanted.collect()}
        fused = sorted(scores, key=lambda s: (-scores[s], rows[s]["walk"], rows[s]["start_line"], rows[s]["part_index"]))
        named = set(literal)
        order = [*first, *[s for s in fused if s in named], *[s for s in literal if s not in scores], *[s for s in fused if s not in named]]
        order = list(dict.fromkeys(order))[:limit]
        texts = {r["section_id"]: r for r in own.filter(F.col("section_id").isin(order)).select("section_id", "content", preview(F.col("content")).alias("preview")).collect()}
        page = Page(state, [Hit(s, *(rows[s][c] for c in ("file_path", "heading_path", "start_line", "end_line")), scores.get(s, 0.0), texts[s]["content"], texts[s]["preview"]) for s in order], indexing=busy)
        if page.hits:
            top = page.hits[0]
            stored = [r["text"] for r in read("units").filter(F.col("section_id") == top.section_id).select("ordinal", "text").orderBy("ordinal").collect()]
            top.excerpt = excerpt(top.content, [w["term"] for w in words], lookup, best.get(top.section_id), rows[top.section_id]["heading_title"], stored)
        self._trusted(self.index.current())
        return page

    def _trusted(self, current: dict) -> None:
        if current["weights"] == REVOKED:
            raise ForeignWeights(f"the vectors were revoked: {current.get('reason', 'index again')}")
        if current["weights"] not in (None, self.weights):
            raise ForeignWeights(f"the index was made by {current['weights']}, the query by {self.weights}")

    def _keywords(self, read, everything: DataFrame, own: DataFrame, asked: DataFrame, most: int, scoped: bool) -> tuple[str, list, list[int], list[int], list[int]]:
        """State, terms, ranked sections, and of a lookup those whose heading is the identifier and others that hold it."""
        lexicon = keyword.Lexicon(read("postings"), read("lengths"))
        terms = keyword.term_table(asked, analyze=self.analyze).cache()
        words = terms.orderBy("term_id").collect()
        found = keyword.occurrences(lexicon, terms).cache()
        scope = own.select("section_id")
        met = found.join(scope, "section_id", "left_semi") if scoped else found
        gated = keyword.gate(own, terms, met).cache()
        state = keyword.keyword_states(asked, terms, gated).first()["keyword_match"]
        lookup = 0 < len(words) < MAX_QUERY_TERMS and all(w["identifier"] for w in words)
        lexical: list[int] = []
        first: list[int] = []
        literal: list[int] = []
        if state in ("matched", "filtered"):
            scored = keyword.bm25(lexicon, terms, scope if scoped else None, found)
            bodies = gated.filter("passed").join(read("units").select("section_id").distinct(), "section_id", "left_semi")
            kept = bodies if not bodies.isEmpty() else gated.filter("passed")
            ranked = keyword.in_order(scored.join(kept.select("section_id"), "section_id", "left_semi"), own).filter(F.col("position") <= most)
            lexical = [r["section_id"] for r in ranked.select("position", "section_id").orderBy("position").collect()]
            if lookup:
                frequencies = {w["term"]: 0 for w in words} | {words[r["term_id"]]["term"]: r["n"] for r in met.groupBy("term_id").agg(F.count("*").alias("n")).collect()}
                candidates = keyword.with_ties(scored, LITERAL_CANDIDATES).select("section_id", "score").join(own, "section_id")
                named = literal_ranking(candidates, [w["term"] for w in words], frequencies, own.count()).select("section_id", "heads").limit(LITERAL_CANDIDATES).collect()
                first, literal = [r["section_id"] for r in named if r["heads"]], [r["section_id"] for r in named if not r["heads"]]
        for frame in (terms, found, gated):
            frame.unpersist()
        return state, words, lexical, first, literal

    def _neighbours(self, read, own: DataFrame, asked: DataFrame, most: int) -> tuple[list[int], dict[int, int]]:
        """Ranked sections by the nearest of their own vector and their passages', and the nearest passage of each."""
        wanted = self.embed(asked.select(F.col("query_id").alias("owner_id"), F.col("query").alias("text"))).withColumnRenamed("owner_id", "query_id")
        scope = own.select("section_id")
        near = vector.nearest(read("vectors").join(scope, "section_id", "left_semi").withColumnRenamed("section_id", "owner_id"), wanted, most).withColumnRenamed("owner_id", "section_id")
        units = read("units").join(scope, "section_id", "left_semi").select(F.struct("section_id", "ordinal").alias("owner_id"), "embedding")
        hits = vector.nearest(units, wanted, PASSAGES_PER_CANDIDATE * most).select("query_id", "owner_id.section_id", "owner_id.ordinal", "distance")
        ranked = keyword.in_order(vector.max_similarity(near, hits), own, "distance", descending=False).filter(F.col("position") <= most)
        rows = ranked.select("position", "section_id", "ordinal").orderBy("position").collect()
        return [r["section_id"] for r in rows], {r["section_id"]: r["ordinal"] for r in rows if r["ordinal"] is not None}
