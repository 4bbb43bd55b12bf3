"""Every query with SQL against DuckDB, row by row."""

import duckdb
import pytest

import __spark_entry__ as entry
from bookpulse.plans.oracles import oracles
from bookpulse.plans.runs import ALL as QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracles()
#: Large enough that every cross-section that a query needs has rows.
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows):
    plain = [tuple(0.0 if isinstance(v, float) and v == 0 else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_all_have_sql():
    assert set(SQL) == set(QUERIES)
    assert set(entry.oracle_sql()) >= set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = cur.fetchall()
    assert want, "nothing is compared"
    doubles = [i for i, (_, t) in enumerate((c, dict(df.dtypes)[c]) for c in columns) if t == "double"]
    assert not doubles or any(r[i] is not None for r in want for i in doubles)
    assert canon(map(tuple, df.select(*[df[c] for c in columns]).collect())) == canon(want)


def test_flagship(spark):
    assert entry.entry(spark).count() == 1
