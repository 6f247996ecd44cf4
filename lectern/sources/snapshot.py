"""An index on disk: immutable snapshots of Parquet tables, and a pointer that names the current one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.schema import SCHEMA_VERSION

POINTER = "_CURRENT"
#: Columns that tables have got since the first version, with their types.
ADDED = {
    "manifest": {"vector_format": "int", "weights_revision": "string", "mtime_ns": "bigint", "length": "bigint"},
    "documents": {"error": "string"},
    "sections": {"base_path": "string", "part_index": "int"},
    "units": {"embedded": "string"},
    "vectors": {},
}


class NewerSchema(RuntimeError):
    """A snapshot that a later version wrote."""


class Conflict(RuntimeError):
    """Another run committed first."""


class Index:
    """Tables below ``root``, in any file system that Spark writes to.

    A commit writes a whole new snapshot and then moves the pointer, so readers see all of a run or nothing of it;
    it fails if the pointer is not the one the run began with.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self, migrate: bool = False) -> dict | None:
        """What the pointer says: snapshot, schema, generation and the run's own notes.

        A later version's is refused. An earlier one's is read with what it lacks left open: with ``migrate``, its
        tables get the columns that came since, and vectors that nothing vouches for are not taken over.
        """
        if not self._fs.exists(self._path(POINTER)):
            return None
        stream = self._fs.open(self._path(POINTER))
        found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if found["schema"] > SCHEMA_VERSION:
            raise NewerSchema(f"schema {found['schema']} is newer than {SCHEMA_VERSION}")
        if found["schema"] < SCHEMA_VERSION and migrate:
            found = self._migrated(found)
        return {"weights": None, "notices": []} | found

    def table(self, name: str, snapshot: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{snapshot or self.current()['snapshot']}/{name}")

    def _migrated(self, found: dict) -> dict:
        """A snapshot of an earlier version in today's form, written beside it. Missing columns are null, so that what they vouch for counts as changed."""
        name, notices = f"snapshot-{uuid.uuid4().hex}", [*found.get("notices", []), f"the index was brought from schema {found['schema']} to {SCHEMA_VERSION}"]
        vouched = found.get("weights") is not None
        for table, columns in ADDED.items():
            if self._fs.exists(self._path(found["snapshot"], table)):
                rows = self.table(table, found["snapshot"])
                missing = {c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in rows.columns}
                rows = rows.withColumns(missing) if missing else rows
                rows.filter(F.lit(vouched or table not in ("units", "vectors"))).write.parquet(f"{self.root}/{name}/{table}")
        if not vouched:
            notices.append("vectors of unknown weights were set aside and are made anew")
        made = found | {"snapshot": name, "schema": SCHEMA_VERSION, "notices": notices, "generation": found["generation"] + 1}
        self._point(made)
        return made

    def commit(self, tables: dict[str, DataFrame], began_with: dict | None, check: Callable[[Callable[[str], DataFrame], dict | None], dict] | None = None, keep: int = 2, **notes) -> dict:
        """Write all ``tables``, have them checked, and make them current. ``notes`` and what ``check`` says are kept.

        A snapshot that fails, or comes too late, is removed; so are those before the last ``keep``, which readers that
        began earlier may still read.
        """
        name = f"snapshot-{uuid.uuid4().hex}"
        try:
            for table, rows in tables.items():
                rows.write.parquet(f"{self.root}/{name}/{table}")
            if check:
                notes |= check(lambda table: self.table(table, name), began_with)
            if (self.current() or {}).get("snapshot") != (began_with or {}).get("snapshot"):
                raise Conflict("another run committed first")
            history = [name, *(began_with or {}).get("history", [(began_with or {}).get("snapshot")])]
            history = [x for x in history if x]
            notices = (began_with or {}).get("notices", [])
            made = {"snapshot": name, "schema": SCHEMA_VERSION, "generation": (began_with or {}).get("generation", 0) + 1, "history": history[:keep], "notices": notices, **notes}
            self._point(made)
        except BaseException:
            self._fs.delete(self._path(name), True)
            raise
        for status in self._fs.listStatus(self._path()):
            old = status.getPath().getName()
            if old.startswith("snapshot-") and old not in made["history"]:
                self._fs.delete(status.getPath(), True)
        return made

    def renote(self, **notes) -> None:
        """Change notes of the current snapshot, in one step."""
        if (found := self.current()) is not None:
            self._point(found | notes)

    def _point(self, made: dict) -> None:
        pending = self._path(f".{POINTER}-{uuid.uuid4().hex}")
        stream = self._fs.create(pending)
        stream.write(bytearray(json.dumps(made, ensure_ascii=False).encode()))
        stream.close()
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        rename = getattr(hadoop, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.valueOf("OVERWRITE")
        hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(pending, self._path(POINTER), how)
