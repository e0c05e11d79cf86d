"""Every registered query with oracle SQL matches DuckDB on the smallest scale."""
import pytest

import __spark_entry__ as E
from tools.check_oracle import digest

from .conftest import SF_TINY

SQL = E.oracle_sql()
QUERIES = E.queries()


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_TINY)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols, drows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(cols, rows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_TINY).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "hybrid_score" in df.columns
