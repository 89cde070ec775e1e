"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from sigmill.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    assert glob.glob(f"{sf_dir}/*")
    yield connection


def cells(rows):
    def cell(x):
        if isinstance(x, float):
            return "NULL" if math.isnan(x) else f"{x:.9g}"
        return "NULL" if x is None else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in ORACLES:
        found = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
        assert sorted(duck.sql(ORACLES[name]).columns) == columns
        assert cells(rows) == cells(found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_numbered_operators(tmp_path):
    """The folder missing, or left behind empty: the other queries load."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for empty in (False, True):
        copy = tmp_path / str(empty)
        shutil.copytree(f"{root}/sigmill", copy / "sigmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(f"{root}/__spark_entry__.py", copy)
        if empty:
            (copy / "sigmill/llm/__pycache__").mkdir(parents=True)
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op1_') for q in e.queries()))"
        found = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
        assert found.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "False"]


@pytest.fixture(scope="module")
def long_keys(spark, tmp_path_factory):
    """Parts enough for more pages than one listing may have, and keys of seven and eight digits, whose codes recur."""
    folder = str(tmp_path_factory.mktemp("long_keys"))
    keys = [*range(5_200), *range(100_000, 100_060), *range(1_000_000, 1_000_600), *range(10_000_000, 10_000_300)]
    names = spark.createDataFrame([(k, f"part {k % 37}") for k in keys], "p_partkey long, p_name string")
    names.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["csv_allowlist", "json_snapshot"])
def test_codes_of_long_keys(spark, long_keys, name):
    df = QUERIES[name](spark, long_keys)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW part AS SELECT * FROM '{long_keys}/part.parquet/*.parquet'")
    found = connection.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})")
    assert cells(df.collect()) == cells(found.fetchall())


def test_faults_of_a_source_of_several_listings(spark, tmp_path):
    spark.createDataFrame([(k, f"part {k % 37}") for k in range(5_200)], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["json_faults"](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert cells(df.collect()) == cells(connection.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['json_faults']})").fetchall())


def test_faults_of_long_keys(spark, long_keys, tmp_path):
    """The SQL takes symbols of one code as they come; here by key."""
    spark.read.parquet(f"{long_keys}/part.parquet").coalesce(1).sortWithinPartitions("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["json_faults"](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert cells(df.collect()) == cells(connection.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['json_faults']})").fetchall())
