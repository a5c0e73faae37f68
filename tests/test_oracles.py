"""Each query against its SQL on the same tables."""

from pathlib import Path

import duckdb
import pytest

from emberline.plans import queries as q

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_matches_sql(spark, duck, name):
    ours, theirs = q.QUERIES[name](spark, str(FOLDER)).toPandas(), duck.sql(q.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    ours, theirs = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(ours) == len(theirs)
    for c in columns:
        assert ((ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna())).all(), c
