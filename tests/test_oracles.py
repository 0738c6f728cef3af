"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return str(v)[:10] if type(v).__name__ in ("date", "datetime", "Timestamp") else v


def key(row):
    return [(v is not None, type(v).__name__, v if v is not None else 0) for v in row]


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_oracle(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=key)
    rows = sorted(([plain(v) for v in r] for r in want.fetchall()), key=key)
    assert len(got) == len(rows)
    for a, b in zip(got, rows):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(y)), (a, b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
