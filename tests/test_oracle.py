"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from rankweave.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def key(row):
    return tuple((v is None, str(type(v)), 0 if v is None else v) for v in row)


def plain(v):
    return "nan" if isinstance(v, float) and v != v else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    ours = [tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()]
    found = duck.sql(ORACLE[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(df.columns) == sorted(names)
    assert sorted(ours, key=key) == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"lambdamart_scores", "als_similar"}))
def test_has_rows(spark, name):
    assert not QUERIES[name](spark, DATA).isEmpty()
