"""Markdown trees and texts as tables of documents, sections and passages."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import is_excluded, is_pruned, walk_key
from lectern.schema import MAX_FILE_BYTES, MAX_SECTION_CHARS, PRUNED, SUFFIXES

LOG = logging.getLogger(__name__)
FILE = "path string, modificationTime timestamp, length long, content binary"
PARSED = "doc_id long, file_path string, title string, error string, sections array<struct<title:string,level:int,heading_path:string,base_path:string,content:string,start_line:int,end_line:int,part:int,passages:array<struct<text:string,line0:int,line1:int,table_line:int,list0:int,list1:int>>>>"


def is_markdown(path: Column) -> Column:
    """Whether the suffix, in any case, is one of Markdown."""
    return F.lower(F.concat(F.lit("."), F.substring_index(path, ".", -1))).isin(*SUFFIXES)


@dataclass
class Walk:
    """What Spark's own listing does not say of a folder: Markdown files of dotted names or in such folders, folders that
    cannot be read, and files that are another's second name."""

    hidden: list[str]
    unreachable: list[str]
    aliases: list[str]


def walk(spark: SparkSession, root: str) -> Walk:
    """Walk the folders below ``root``, in any file system. A folder that cannot be listed is noted and left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = Walk([], [], []), [(path, "", False)]
    while todo:
        folder, name, dotted = todo.pop()
        try:
            listed = files.listStatus(folder)
        except Exception as error:  # of whatever kind, what is below stays as it was
            if not name:
                raise
            found.unreachable.append(name)
            LOG.warning("%s cannot be read: %s", name, type(error).__name__)
            continue
        for status in listed:
            own = status.getPath().getName()
            below, hidden = f"{name}/{own}".lstrip("/"), dotted or own[:1] in "._"
            if status.isDirectory():
                if own not in PRUNED and not status.isSymlink():
                    todo.append((status.getPath(), below, hidden))
            elif hidden and own.lower().endswith(SUFFIXES):
                found.hidden.append(status.getPath().toString())
    found.hidden.sort()
    found.aliases = _aliases(root)
    return found


def _aliases(root: str) -> list[str]:
    """Files that are links to a Markdown file which is below ``root`` itself, of a folder that this machine sees."""
    top = Path(root.removeprefix("file:"))
    if not top.is_dir():
        return []
    links = [p for suffix in SUFFIXES for p in top.rglob(f"*{suffix}") if p.is_symlink()]
    held = {(s.st_dev, s.st_ino) for suffix in SUFFIXES for p in top.rglob(f"*{suffix}") if p.is_file() and not p.is_symlink() for s in [p.stat()]} if links else set()
    return sorted(str(p.relative_to(top)) for p in links if p.exists() and (p.stat().st_dev, p.stat().st_ino) in held)


def _files(spark: SparkSession, root: str, paths: list[str] | None, walked: Walk) -> DataFrame:
    """Files with their paths below ``root``."""
    read = spark.read.format("binaryFile")
    if paths is not None:
        files = read.load(paths)
    elif walked.unreachable:
        below = [s.getPath() for s in _listed(spark, root)]
        open_ = [p.toString() for p in below if not any(u.split("/", 1)[0] == p.getName() for u in walked.unreachable)]
        files = read.option("recursiveFileLookup", True).load(open_) if open_ else read.schema(FILE).load(root).limit(0)
        files = files.unionByName(read.load(walked.hidden)) if walked.hidden else files
    else:
        files = read.option("recursiveFileLookup", True).load(root)
        files = files.unionByName(read.load(walked.hidden)) if walked.hidden else files
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.\-]*:/*", "")
    return files.withColumn("file_path", F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path))


def _listed(spark: SparkSession, root: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return list(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def _chosen(files: DataFrame, exclude: list[str] | None, walked: Walk) -> DataFrame:
    found = files.filter(F.col("length") <= MAX_FILE_BYTES)
    found = found.filter(is_markdown(F.col("file_path")) & ~is_pruned(F.col("file_path")) & ~is_excluded(F.col("file_path"), exclude or []))
    return found.filter(~F.col("file_path").isin(walked.aliases)) if walked.aliases else found


def _contents(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.sha2("content", 256).alias("content_hash"), F.unix_micros("modificationTime").alias("mtime"), "length", F.decode("content", "UTF-8").alias("text"))


def listing(spark: SparkSession, root: str, exclude: list[str] | None = None, walked: Walk | None = None) -> DataFrame:
    """(file_path, mtime, length) of the Markdown files below a folder; no file is read."""
    walked = walked or walk(spark, root)
    return _chosen(_files(spark, root, None, walked), exclude, walked).select("file_path", F.unix_micros("modificationTime").alias("mtime"), "length")


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, walked: Walk | None = None) -> DataFrame:
    """(file_path, content_hash, mtime, length, text) of the Markdown files below a folder of any file system.

    Folders that are never searched and files of more than 10 MB are left out before anything is read, and so are links
    to files that are listed anyway; bytes that are no UTF-8 are replaced. Paths are relative to ``root``; ``walk_key``
    sorts them as a walk meets them.
    """
    walked = walked or walk(spark, root)
    return _contents(_chosen(_files(spark, root, None, walked), exclude, walked))


def read(spark: SparkSession, root: str, listed: DataFrame, walked: Walk, most: int = 10_000) -> DataFrame:
    """As ``scan``, of the files of ``listed`` alone. Up to ``most`` of them are read by their names, more by a scan that is joined with them."""
    names = [r["file_path"] for r in listed.select("file_path").limit(most + 1).collect()]
    if len(names) > most:
        return _contents(_files(spark, root, None, walked)).join(listed.select("file_path"), "file_path", "left_semi")
    if not names:
        return _contents(spark.createDataFrame([], f"{FILE}, file_path string"))
    return _contents(_files(spark, root, [f"{root.rstrip('/')}/{n}" for n in names], walked))


def why_left_out(spark: SparkSession, root: str, name: str, exclude: list[str], ignored: list[str]) -> str:
    """Why a file below ``root`` is none of those that are indexed; the first reason that holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return "no such file"
    status = files.getFileStatus(path)
    said = spark.range(1).select(is_markdown(F.lit(name)).alias("markdown"), is_pruned(F.lit(name)).alias("pruned"), is_excluded(F.lit(name), exclude).alias("excluded")).first()
    reasons = [
        (status.isDirectory(), "a folder"),
        (not said["markdown"], "not Markdown by its suffix"),
        (said["pruned"], "in a folder that is never searched"),
        (said["excluded"], "excluded by a pattern"),
        (any(name == p or p.endswith("/") and name.startswith(p) for p in ignored), "ignored by version control"),
        (status.getLen() > MAX_FILE_BYTES, "larger than 10 MB"),
        (name in _aliases(root), "a second name of a file that is indexed"),
    ]
    return next((reason for holds, reason in reasons if holds), "not indexed yet")


def parsed(documents: DataFrame, most: int | None = MAX_SECTION_CHARS) -> DataFrame:
    """(doc_id, file_path, title, error, sections) of (doc_id, file_path, text): the kernel, a document at a time.

    Sections of more than ``most`` characters are in parts; without it, all are whole. A document that fails to parse has its error and no sections, and does not stop others. A null text is an empty
    document.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lectern.markdown.document import parse

        for frame in frames:
            out = []
            for doc_id, path, text in zip(frame["doc_id"], frame["file_path"], frame["text"], strict=True):
                stem = (path or "Untitled").rpartition("/")[2].rpartition(".")[0] or "Untitled"
                try:
                    made = parse(text or "", stem, most)
                    sections = [(*astuple(s)[:8], [(p.text, *(p.lines or (None, None)), p.table, *(p.listing or (None, None))) for p in s.passages]) for s in made.sections]
                    out.append((doc_id, path, made.title, None, sections))
                except Exception as error:  # one bad file is that file's failure
                    out.append((doc_id, path, None, f"{type(error).__name__}: {error}", []))
            yield pd.DataFrame(out, columns=["doc_id", "file_path", "title", "error", "sections"])

    return documents.select("doc_id", "file_path", "text").mapInPandas(run, PARSED)


def sections(parsed_documents: DataFrame) -> DataFrame:
    """A row for each section, with the place in its document."""
    spread = parsed_documents.select("doc_id", "file_path", F.posexplode("sections").alias("place", "s"))
    return spread.select("doc_id", "file_path", "place", F.col("s.title").alias("heading_title"), F.col("s.level").alias("heading_level"), "s.heading_path", "s.base_path", "s.content", "s.start_line", "s.end_line", F.col("s.part").alias("part_index"), "s.passages")


def passages(section_rows: DataFrame) -> DataFrame:
    """A row for each passage, with the text that is embedded: its section's path and its own."""
    spread = section_rows.select("doc_id", "place", "heading_path", F.posexplode("passages").alias("ordinal", "p"))
    return spread.select("doc_id", "place", "ordinal", F.col("p.text").alias("content"), F.concat_ws(": ", "heading_path", "p.text").alias("embedded"), "p.line0", "p.line1", "p.table_line", "p.list0", "p.list1")


def fingerprints(section_rows: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): a digest of all that was made of a document: paths, lines, contents and passages, in order."""
    read = F.sha2(F.array_join(F.transform("passages", lambda p: p["text"]), "\n"), 256)
    own = section_rows.select("doc_id", "place", F.concat_ws("|", "heading_path", "base_path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("part_index").cast("string"), F.sha2("content", 256), read).alias("own"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "own"))), lambda x: x["own"])
    return own.groupBy("doc_id").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("fingerprint"))


def in_walk_order(files: DataFrame) -> DataFrame:
    return files.orderBy(walk_key(F.col("file_path")))
