import duckdb
import pytest

from tidepool.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cells(rows):
    return sorted(tuple("None" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = cells(got.select(*columns).collect())
    if name in ORACLES:
        found = oracle.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == cells(tuple(r[i] for i in order) for r in found.fetchall())
    else:
        assert rows
