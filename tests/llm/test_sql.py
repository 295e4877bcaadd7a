"""The corpus queries that SQL can express, and the rule columns of the URL filter, against it."""

from __future__ import annotations

import os

import duckdb
import pytest

from codeloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = sql.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(cursor.fetchall())


def test_url_rules_equal_sql(spark, sql):
    fits = " ".join(f"WHEN (host = '{r[: r.index('/')]}' OR suffix(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/'):]}') THEN '{r}'" for _, r in sorted(queries.URL_RULES, key=lambda x: -len(x[1])))
    want = sql.execute(rf"""
        WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
        p AS (SELECT page_id, {queries._LOWERED.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
        SELECT page_id, host, path, CASE {fits} END AS rule FROM p""").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.op1_url_filter(spark, SF).select("page_id", "host", "path", "rule").collect())
