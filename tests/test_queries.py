"""Every query with a SQL twin gives the same rows as DuckDB on the same tables."""

import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(set(entry.oracle_sql()) - {n for n in entry.queries() if n.startswith("op")})


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, connection, name):
    frame = entry.queries()[name](spark, SF)
    result = connection.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, result.fetchall())


def test_subpackage_stands_alone():
    assert importlib.util.find_spec("millrace.plans.catalog")
    assert {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} >= set(NAMES)
