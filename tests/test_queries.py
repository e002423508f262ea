"""Every query with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from plinth.plans.relational import LINES

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in LINES.split():
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, float | Decimal) else v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    rel = duck.sql(ORACLE[name])
    assert bag(df.columns, df.collect()) == bag(rel.columns, rel.fetchall())
