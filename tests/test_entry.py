"""The driver's contract, and every registered query against its SQL."""

from __future__ import annotations

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from codeloom.plans import driver

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return repr(round(value, 9)) if value != int(value) else str(int(value))
    return str(value)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(driver.ORACLE))
def test_query_equals_sql(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cursor = sql.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    assert want and got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_corpus_operators(tmp_path):
    """A copy without the corpus folder still imports and lists the other queries."""
    import shutil

    shutil.copytree(f"{HERE}/codeloom", tmp_path / "codeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=120)
