"""Every query with SQL gives the same rows in DuckDB on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidelog import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(norm(x) for x in v) if isinstance(v, list) else v


def same(spark_rows, columns, cursor):
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(columns)
    order = [names.index(c) for c in columns]
    expected = [tuple(norm(r[i]) for i in order) for r in cursor.fetchall()]
    assert sorted(map(repr, spark_rows)) == sorted(map(repr, expected))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    same([tuple(norm(x) for x in r) for r in df.collect()], df.columns, duck.execute(queries.ORACLE[name]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).limit(5).collect() is not None


def test_entry_is_imported_before_a_session_exists():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys()"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
