"""Every registered query of the library against its DuckDB equivalent on the smallest tables."""

import duckdb
import pytest

from sievewright.plans import language, more  # noqa: F401  (registers further queries)
from sievewright.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark embeddings pages labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.8g}"
    return str(v)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    where = [found.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in where) for r in found.fetchall())
    assert got == want and got
