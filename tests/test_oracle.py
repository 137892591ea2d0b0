"""Every query with SQL against DuckDB on the smallest tables; the others must run and give a stable schema."""

import duckdb
import pytest

from learntrail import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(str([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    rows = [[r[c] for c in sorted(df.columns)] for r in df.collect()]
    if name not in plans.oracle_sql():
        assert df.columns
        return
    want = duck.sql(plans.oracle_sql()[name])
    order = sorted(range(len(want.columns)), key=lambda k: want.columns[k])
    assert sorted(df.columns) == [want.columns[k] for k in order]
    assert shown(rows) == shown([[r[k] for k in order] for r in want.fetchall()])
