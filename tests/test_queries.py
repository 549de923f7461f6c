from pathlib import Path

import duckdb
import pytest

from meldwork.plans.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    """Numbers as floats, as pandas makes floats of integers where there are nulls."""
    return None if x != x else float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(map(plain, r))) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    got = QUERIES[name](spark, str(SF)).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    assert rows(got) == rows(tables.execute(ORACLES[name]).df())
