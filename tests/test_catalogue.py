"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from rookery.plans import catalogue

ENTRIES = catalogue.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and v != v:
        return None
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_same_rows_as_sql(spark, data, duck, name):
    df = ENTRIES[name].run(spark, data)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    cursor = duck.execute(ENTRIES[name].sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if not e.sql))
def test_gives_rows(spark, data, name):
    assert ENTRIES[name].run(spark, data).count() > 0
