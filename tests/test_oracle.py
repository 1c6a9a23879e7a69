"""Every registered query with oracle SQL agrees with DuckDB at sf 0.01."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF01
from tests.oracle_util import digest, duck

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_is_registered_with_a_callable():
    assert QUERIES and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    h1, l1 = digest(df.columns, rows)
    h2, l2 = digest(ocols, orows)
    assert h1 == h2, (sorted(set(l1) - set(l2))[:3], sorted(set(l2) - set(l1))[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF01).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert "total_php" in df.columns


def test_each_oracle_runs_alone_on_a_fresh_connection():
    """A DuckDB internal error invalidates the whole connection; no oracle may trigger one."""
    bad = []
    for name, q in sorted(ORACLE.items()):
        c = duck(SF01)
        try:
            c.execute(q).fetchall()
        except Exception as e:  # noqa: BLE001
            bad.append((name, str(e)[:100]))
        finally:
            c.close()
    assert not bad
