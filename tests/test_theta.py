"""Joins of a table with itself by equality and order."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from plinth.engine import Engine
from plinth.operators import theta


@pytest.fixture(scope="module")
def both(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, "a", "b", "c"]), rnd.choice([None, *range(9)]), rnd.choice([None, float("nan"), 0.0, -0.0, *[round(rnd.random() * 20, 1)] * 6])) for i in range(150)]
    e, con = Engine(spark), duckdb.connect()
    e.register("s", spark.createDataFrame(rows, "id bigint, k string, x int, y double").cache())
    con.sql("CREATE TABLE s(id bigint, k varchar, x int, y double)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?)", rows)
    return e, con


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a.id, b.id AS i2 FROM s a JOIN s b ON a.k = b.k AND a.x < b.x AND b.y < a.y - 2",
        "SELECT a.id, b.id AS i2 FROM s a JOIN s b ON a.k = b.k AND a.x >= b.x AND a.y <= b.y AND a.id > b.id",
        "SELECT * FROM s a INNER JOIN s AS b ON a.k = b.k AND a.y <= b.y",
        "SELECT a.id, b.id AS i2 FROM s a, s b WHERE a.k = b.k AND a.id > b.x * 9 AND (a.id > 3 OR b.id > 5)",
        "SELECT a.id, b.id AS i2 FROM s a JOIN s b ON a.id > 99 OR b.id > 99 WHERE a.k = b.k AND b.y > a.x",
        "SELECT count(*) AS n, b.*, c.id AS cid FROM s a JOIN s b ON a.k = b.k AND a.x > b.x LEFT JOIN s c ON c.id = b.id + 50 GROUP BY ALL",
        "SELECT id FROM s WHERE EXISTS (SELECT 1 FROM s a JOIN s b ON a.k = b.k AND a.x < b.x AND a.y < b.y WHERE a.id = s.id)",
    ],
)
def test_pairs(both, sql):
    e, con = both
    plain = lambda r: tuple("nan" if v != v else v + 0 if isinstance(v, float) else v for v in r)
    assert "plinth_right" in e.sql(sql)._jdf.queryExecution().analyzed().toString()
    assert Counter(map(plain, e.sql(sql).collect())) == Counter(map(plain, con.sql(sql).fetchall()))


def test_rows_out_of_order_do_not_meet(spark, monkeypatch):
    """One key of 30,000 rows, of which one fits: each row with each other would be 900 million pairs."""
    made, noded = [], theta.noded
    monkeypatch.setattr(theta, "noded", lambda *a: made.append(noded(*a)) or made[-1])
    e = Engine(spark)
    e.register("p", spark.range(30_000).selectExpr("id", "'k' AS brand", "CAST(id % 50 AS INT) AS size", "CASE WHEN id = 0 THEN 1500.05D ELSE 900 + id / 300 END AS price"))
    got = e.sql("SELECT a.id, b.id AS other FROM p a JOIN p b ON a.brand = b.brand AND a.size < b.size AND b.price < a.price - 590").collect()
    assert sorted((r.id, r.other) for r in got) == [(0, i) for i in range(1, 30_000) if i % 50 and 900 + i / 300 < 1500.05 - 590]
    ((left, right),) = made
    met = left.join(right, F.col(theta.LEFT) == F.col(theta.RIGHT)).count()
    assert len(got) <= met < 1.1 * len(got)
