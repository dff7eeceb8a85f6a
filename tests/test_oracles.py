"""Every registered query of the library against its checking SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from specgraph.plans import audits, details, discovery, inventory, landing, lineage, registry, semantics, sources, specs  # noqa: F401
from tests.conftest import DATA

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SMALL}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str([plain(v) for v in value]) if isinstance(value, list | tuple) else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    if name not in registry.ORACLES:
        assert rows
        return
    got = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in places) for r in got.fetchall())
