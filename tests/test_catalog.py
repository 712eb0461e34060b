"""Every query with SQL gives what DuckDB gives on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidewright.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        assert got
        return
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
