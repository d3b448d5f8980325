"""Every key with a DuckDB twin matches it on the smallest driver tables."""

import duckdb
import pytest

from ratelens.plans.registry import ORACLE, QUERIES
from ratelens.sources.tables import TABLES
from tools.check_oracle import rows_of

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    srows, scols = df.collect(), df.columns
    res = con.execute(ORACLE[key])
    dcols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    assert rows_of(scols, srows) == rows_of(dcols, res.fetchall())


def test_every_key_is_registered_with_callable():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 80
