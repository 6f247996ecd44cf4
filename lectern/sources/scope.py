"""What a folder's version control leaves out, where an index of it lives, and who may write to it."""

from __future__ import annotations

import hashlib
import os
import subprocess
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEOUT = 10


def _git(root: str, *more: str) -> subprocess.CompletedProcess:
    command = ["git", *more, "-C", root, "ls-files", "--others", "--ignored", "--exclude-standard", "--directory", "-z"]
    return subprocess.run(command, capture_output=True, timeout=TIMEOUT, env=os.environ | {"LC_ALL": "C", "GIT_OPTIONAL_LOCKS": "0"}, check=False)


def ignored(root: str) -> tuple[str, list[str]]:
    """State and prefixes of what git ignores below ``root``: applied, off, no_repository or unavailable.

    Ignored folders are one prefix each, ending in /. Runs on the driver, for a folder that it can see; for others it is
    off. A checkout whose repository calls itself bare is asked again as one that is not.
    """
    if not os.path.isdir(root):
        return "off", []
    try:
        run = _git(root)
        if run.returncode and b"must be run in a work tree" in run.stderr:
            run = _git(root, "-c", "core.bare=false")
    except (OSError, subprocess.TimeoutExpired):
        return "unavailable", []
    if run.returncode:
        return "no_repository" if b"not a git repository" in run.stderr else "unavailable", []
    return "applied", [p.decode("utf-8", "replace") for p in run.stdout.split(b"\x00") if p]


def without_ignored(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """``files`` but those that a prefix names or holds. Each path is joined by its own ancestors, not tried against all prefixes."""
    if not prefixes:
        return files
    names = files.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string").distinct()
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    out = files.select("file_path", F.explode(above).alias("prefix")).join(names, "prefix", "left_semi").select("file_path").distinct()
    return files.join(out, "file_path", "left_anti")


def home_of(root: str, base: str, model: str = "") -> str:
    """Where the index of a folder lives: its name, a digest of its full path, and the model if that is not the usual one."""
    whole = str(Path(root).resolve())
    digest = hashlib.sha256(whole.encode("utf-8", "surrogateescape")).hexdigest()[:12]
    return "/".join([base.rstrip("/"), "-".join(x for x in (Path(whole).name or "root", digest, model) if x)])


def valid_path(path: str) -> str | None:
    """What is wrong with a path that a user gave, or None."""
    if "\x00" in path:
        return "a path cannot hold a NUL character"
    if any("\ud800" <= c <= "\udfff" for c in path):
        return "a path must be text"
    return "another user's home is not read" if path.startswith("~") and path[:2] != "~/" and path != "~" else None


def inside(root: str, path: str) -> bool:
    """Whether a path, taken from ``root`` if it is relative, stays below it once . and .. are resolved."""
    whole, top = os.path.normpath(os.path.join(root, path)), os.path.normpath(root)
    return whole == top or whole.startswith(top.rstrip("/") + "/")


class Trees:
    """Which of several indexed folders a path belongs to: the deepest that holds it. The least recently used of more than ``most`` is forgotten."""

    def __init__(self, base: str, most: int = 8):
        self.base, self.most, self.homes = base, most, {}

    def add(self, root: str) -> str:
        """The home of a folder's index."""
        home = self.homes.pop(root, None) or home_of(root, self.base)
        self.homes[root] = home
        while len(self.homes) > self.most:
            del self.homes[next(iter(self.homes))]
        return home

    def of(self, path: str) -> tuple[str, str] | None:
        """(root, home) of the tree that holds a path."""
        roots = [r for r in self.homes if inside(r, path) and path.startswith("/")]
        return (root := max(roots, key=len), self.add(root)) if roots else None

    def counterpart(self, path: str, root: str) -> str | None:
        """The same file in another tree."""
        own = self.of(path)
        return os.path.join(root, os.path.relpath(path, own[0])) if own and root in self.homes else None


class Busy(RuntimeError):
    """Another run holds the lock."""


@contextmanager
def exclusive(spark: SparkSession, home: str):
    """Hold the index at ``home``, in any file system: a second run is refused, it does not wait."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{home.rstrip('/')}/_LOCK")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        files.create(path, False).close()
    except Exception as error:
        if files.exists(path):
            raise Busy(f"{home} is being written") from error
        raise
    try:
        yield
    finally:
        files.delete(path, False)


def locked(spark: SparkSession, home: str) -> bool:
    """Whether a run holds the index at ``home``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{home.rstrip('/')}/_LOCK")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
