"""Results as lines of JSON: one object each, names in order, no spaces, letters as they are."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON. Nulls are kept, and columns are in the order of their names, so equal rows are equal text."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.mode("overwrite").text(path)


def record(name: str, scores: dict, identity: dict[str, str], now: datetime | None = None) -> str:
    """A run's scores with what they were measured on, as one canonical line; the identities of code and corpus must be named."""
    missing = {"code", "corpus", "cases"} - identity.keys()
    if missing:
        raise ValueError(f"a record must name its {', '.join(sorted(missing))}")
    at = (now or datetime.now(UTC)).isoformat(timespec="seconds")
    return json.dumps({"at": at, "identity": identity, "name": name, "scores": scores}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


