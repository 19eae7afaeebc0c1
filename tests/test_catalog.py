"""Every registered query of the catalogue against DuckDB running the SQL that says the same."""

from __future__ import annotations

import math

import duckdb
import pytest

from cinequarry.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = ", ".join(f'round("{c}", 6) AS "{c}"' if want[c].dtype.kind == "f" else f'"{c}"' for c in sorted(want.columns))
    duck.register("got", got)
    duck.register("want", want)
    for a, b in (("got", "want"), ("want", "got")):
        left = duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").df()
        assert not len(left), left.head()
    assert not any(isinstance(v, float) and math.isinf(v) for v in got.select_dtypes("float").to_numpy().ravel())
