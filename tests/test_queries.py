"""Every base query against its SQL on the same tables."""

import math

import duckdb
import pytest

from barloom.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 6) + 0.0
    return v if v is None or isinstance(v, (int, bool, str)) else float(v) if type(v).__name__ == "Decimal" else v


def as_rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert as_rows(got.columns, rows) == as_rows(names, want.fetchall())
