"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from lectern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def clean(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else list(x) if isinstance(x, (list, tuple)) else x for x in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    found = registry.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    relation = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert clean(found.select(*columns).collect()) == clean(relation.project(quoted).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "section_id", "score", "position"]
