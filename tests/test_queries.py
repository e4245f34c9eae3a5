"""Each query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import duckdb
import pytest

from portcullis import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = q.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in q.ORACLE_SQL:
        assert got
        return
    found = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(_norm(r[i]) for i in at) for r in found.fetchall()), key=repr)
