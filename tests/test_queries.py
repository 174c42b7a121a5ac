"""Every registered query of the library against its SQL on the smallest tables."""

import os

import pytest

DATA = os.environ.get("WEFTLINE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(values):
    return tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in values)


def names():
    from weftline import registry

    return sorted(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from weftline import registry

    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(plain(r) for r in got.select(*columns).collect())
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        picked = ", ".join(f'"{c}"' for c in columns)
        assert rows == sorted(plain(r) for r in duck.sql(f"SELECT {picked} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
