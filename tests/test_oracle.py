"""Every query that SQL can express, on both engines over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from basalt import suite

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame, columns):
    out = [tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(suite.ORACLE))
def test_agrees_with_sql(spark, duck, name):
    ours = suite.QUERIES[name](spark, str(DATA)).toPandas()
    theirs = duck.sql(suite.ORACLE[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_every_query_has_sql():
    assert set(suite.QUERIES) == set(suite.ORACLE)
