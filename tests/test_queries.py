"""Every query of the library against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from costweave import queries as library

DATA = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_matches_sql(spark, db, name):
    got = library.QUERIES[name](spark, DATA)
    want = db.execute(library.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    found = rows(got.columns, got.collect())
    assert found
    assert found == rows(names, want.fetchall())
