"""Every query with SQL gives the rows that DuckDB gives for that SQL on the same tables."""

import math
import os

import duckdb
import pytest

from folio.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    made = registry.queries()[name](spark, SF)
    columns = sorted(made.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in made.collect())
    if name not in registry.oracle_sql():
        assert got
        return
    frame = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(frame.columns) == columns
    want = sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))
    assert len(got) == len(want)
    different = [(g, w) for g, w in zip(got, want) if g != w]
    assert not different, different[:2]
