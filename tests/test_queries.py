"""Each query against its SQL on the smallest tables, as the driver does."""

import os
import subprocess
import sys

import duckdb
import pytest

from blockcodec.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(rows):
    return sorted(repr([None if x is None else x for x in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


RUN_ALL = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from blockcodec.queries import QUERIES
bad = []
for name, q in QUERIES.items():
    try:
        q(spark, sys.argv[2]).count()
    except Exception as e:
        bad.append(name + ": " + str(e)[:200])
print("BAD", bad)
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_workers_need_not_import_the_package(tmp_path):
    """From another folder, without PYTHONPATH: only the driver can import it."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", RUN_ALL, root, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "BAD []" in out.stdout, out.stdout + out.stderr[-3000:]
