"""ARRAY(SELECT ... ORDER BY ... LIMIT n)."""

import pytest

from plinth.engine import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    rows = [(1, "a", 2.0), (2, "a", None), (3, "b", 7.0), (4, "b", 1.0), (5, None, float("nan")), (6, "a", 7.0), (7, "b", None)]
    e.register("t", spark.createDataFrame(rows, "id bigint, k string, x double").repartition(3))
    return e


@pytest.mark.parametrize(
    ("inner", "expected"),
    [
        ("SELECT id FROM t ORDER BY x DESC, id LIMIT 4", [5, 3, 6, 1]),
        ("SELECT id FROM t ORDER BY x, id DESC LIMIT 4 OFFSET 2", [6, 3, 5, 7]),
        ("SELECT id FROM t ORDER BY x NULLS FIRST, id DESC OFFSET 1", [2, 4, 1, 6, 3, 5]),
        ("SELECT x FROM t ORDER BY id LIMIT 2", [2.0, None]),
        ("SELECT -id FROM t ORDER BY 1 LIMIT 3", [-7, -6, -5]),
        ("SELECT -id AS n FROM t ORDER BY n LIMIT 3", [-7, -6, -5]),
        ("SELECT k FROM t GROUP BY k ORDER BY count(*) DESC, k LIMIT 2", ["a", "b"]),
        ("SELECT id FROM t WHERE id > 9 ORDER BY id LIMIT 2", []),
    ],
)
def test_rows_in_order_without_one_task_for_all(engine, inner, expected):
    df = engine.sql(f"SELECT ARRAY({inner}) AS s")
    assert df.collect()[0].s == expected
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_of_each_row(engine):
    rows = engine.sql("SELECT id, ARRAY(SELECT id FROM t u WHERE u.k = t.k ORDER BY u.x DESC, u.id LIMIT 2) AS s FROM t").collect()
    assert {r.id: r.s for r in rows} == {1: [6, 1], 2: [6, 1], 3: [3, 4], 4: [3, 4], 5: [], 6: [6, 1], 7: [3, 4]}
