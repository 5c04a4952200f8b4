"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import os

import pytest

from tesselar.operators import all_queries, all_sql
from tesselar.session import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ in ("Decimal", "int64", "int32", "float64"):
        return f"{float(x):.6f}"
    if hasattr(x, "isoformat"):
        return str(x)[:19]
    return str(x)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in all_sql():
        got = duck.execute(all_sql()[name])
        names = [d[0] for d in got.description]
        want = table(names, got.fetchall())
        have = table(df.columns, rows)
        dates = {n for n, t in df.dtypes if t == "date"}
        if dates:
            cut = [i for i, n in enumerate(want[0]) if n in dates]
            shorten = lambda t: (t[0], sorted(tuple(v[:10] if i in cut and v else v for i, v in enumerate(r)) for r in t[1]))
            want, have = shorten(want), shorten(have)
        assert have == want


def test_all_keys_have_names():
    assert set(all_sql()) <= set(all_queries())
