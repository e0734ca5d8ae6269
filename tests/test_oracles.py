"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from folioscope import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(frame):
    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("" if v is None or v != v else str(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    mine, theirs = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
