"""Queries of the engine and their SQL."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plinth.engine import Engine
from plinth.operators import temporal
from plinth.plans import surface
from plinth.plans.relational import LINES
from plinth.plans.relational import SQL as RELATIONAL
from plinth.session import shared_dir

SQL = RELATIONAL | surface.SQL


#: Schemas by path: a table's files are looked at once a process, as by a catalog.
_SCHEMAS: dict[str, StructType] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def engine(spark: SparkSession, sf_dir: str, sql: str, warehouse: bool = False) -> Engine:
    """An engine that knows the tables which a text names."""
    folder = None
    if warehouse:  # the shared folder where there is one
        folder = f"{shared_dir(spark)}/warehouse-{os.urandom(6).hex()}"
    out = Engine(spark, folder)
    for name in LINES.split():
        if name in sql:
            out.register(name, _table(spark, sf_dir, name))
    return out


def _sql(text: str):
    return lambda spark, sf_dir: engine(spark, sf_dir, text).sql(text)


def _matview(spark, sf_dir) -> DataFrame:
    e = engine(spark, sf_dir, "orders", True)
    e.sql("CREATE MATERIALIZED VIEW busy AS SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey; REFRESH MATERIALIZED VIEW busy; ALTER MATERIALIZED VIEW busy RENAME TO busiest")
    return e.sql("SELECT o_custkey, n FROM busiest WHERE n > 12")


def _permissions(spark, sf_dir) -> DataFrame:
    return engine(spark, sf_dir, "customer").sql("SELECT * FROM customer", {"public.customer": ["c_custkey", "c_mktsegment"]})


def _bind(spark, sf_dir) -> DataFrame:
    """A parameter that would end its literal, if a backslash could; and one with quotes."""
    text = "SELECT n_nationkey, $2 AS said FROM nation WHERE n_name = $1 OR n_nationkey = 4"
    return engine(spark, sf_dir, text).prepare(text).bind("\\' OR 1=1 --", "it's a \\ and a \"").execute()


def _permission_comment(spark, sf_dir) -> DataFrame:
    """A comment can narrow what the caller may see, not widen it."""
    text = """SELECT * FROM customer /*PLINTH_PERMISSIONS {"public.customer": ["c_custkey", "c_acctbal"], "public.orders": ["o_orderkey"]} PLINTH_PERMISSIONS*/"""
    return engine(spark, sf_dir, "customer").sql(text, {"public.customer": ["c_custkey", "c_mktsegment"]})


def _permission_catalog(spark, sf_dir) -> DataFrame:
    e = engine(spark, sf_dir, "customer orders")
    return e.sql("SELECT c.relname, a.attname FROM pg_class c JOIN pg_attribute a ON a.attrelid = c.oid", {"public.customer": ["c_custkey", "c_name"]})


def _permission_view(spark, sf_dir) -> DataFrame:
    """A view is refreshed under the permissions of who made it."""
    e = engine(spark, sf_dir, "customer", True)
    e.sql("CREATE MATERIALIZED VIEW v AS SELECT * FROM customer", {"public.customer": ["c_custkey"]})
    e.sql("REFRESH MATERIALIZED VIEW v")
    return e.sql("SELECT * FROM v")


def _created(spark, sf_dir) -> DataFrame:
    """CREATE TABLE AS, a view WITH NO DATA that is renamed and refreshed, and DROP."""
    e = engine(spark, sf_dir, "nation region", True)
    e.sql("CREATE TABLE a AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey; CREATE MATERIALIZED VIEW b AS SELECT r_regionkey, r_name FROM region WITH NO DATA")
    e.sql("ALTER MATERIALIZED VIEW b RENAME TO c; REFRESH MATERIALIZED VIEW c; CREATE TABLE gone AS SELECT 1 AS x; DROP TABLE gone; DROP TABLE IF EXISTS gone")
    return e.sql("SELECT r_name, n FROM a JOIN c ON r_regionkey = n_regionkey")


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus")


def _store(change):
    """The whole of orders as a stored table, changed."""

    def run(spark, sf_dir) -> DataFrame:
        e = engine(spark, sf_dir, "orders", True)
        rows = _table(spark, sf_dir, "orders").select(*_ORDERS)
        e.store.replace("public", "o", rows)
        change(e.store, rows)
        return e.sql("SELECT * FROM o")

    return run


def _upsert(store, rows):
    late = rows.filter("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X"))
    new = rows.filter("o_orderstatus = 'F'").withColumn("o_custkey", -1 - F.col("o_custkey"))
    store.update("public", "o", late.unionByName(new), ["o_orderkey", "o_custkey"], insert=True)


def _update(store, rows):
    store.update("public", "o", rows.filter("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey", "o_custkey"])


def _append(override):
    """Loads what was ordered before 2000, then appends what lies after the cursor; with override, from the cursor on."""

    def run(spark, sf_dir) -> DataFrame:
        e = engine(spark, sf_dir, "orders", True)
        rows = _table(spark, sf_dir, "orders").select(*_ORDERS, "o_orderdate")
        e.store.replace("public", "o", rows.filter("o_orderdate < DATE '2000-01-01'"))
        last = e.store.last_cursor("public", "o", "o_orderdate")
        at = F.lit(last).cast("timestamp_ntz")
        e.store.append("public", "o", rows.filter(F.col("o_orderdate") >= at if override else F.col("o_orderdate") > at), override=("o_orderdate", last) if override else None)
        return e.sql("SELECT o_orderkey, o_custkey, o_orderstatus FROM o")

    return run


def _events(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _asof(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    return temporal.asof_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen")), "user_id", "ts", "seen").select("event_id", "seen")


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


OTHERS = {
    "matview_refresh": (_matview, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "permission_select": (_permissions, "SELECT c_custkey, c_mktsegment FROM customer"),
    "permission_comment": (_permission_comment, "SELECT c_custkey FROM customer"),
    "permission_catalog": (_permission_catalog, "SELECT * FROM (VALUES ('customer', 'c_custkey'), ('customer', 'c_name')) t(relname, attname)"),
    "permission_view": (_permission_view, "SELECT c_custkey FROM customer"),
    "bind_text": (_bind, "SELECT n_nationkey, 'it''s a \\ and a \"' AS said FROM nation WHERE n_nationkey = 4"),
    "create_rename_drop": (_created, "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "store_upsert": (_store(_upsert), "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey, -1 - o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'"),
    "store_update": (_store(_update), "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "store_delete": (_store(lambda s, rows: s.delete("public", "o", rows.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey"))), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'"),
    "cursor_append": (_append(False), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"),
    "cursor_override": (_append(True), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"),
    "info_schema_columns": (lambda s, d: engine(s, d, "nation region").sql("SELECT table_name, column_name, ordinal_position FROM information_schema.columns"), "SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position FROM information_schema.columns WHERE table_name IN ('nation', 'region')"),
    "pg_class": (lambda s, d: engine(s, d, "nation region").sql("SELECT c.relname, n.nspname FROM pg_catalog.pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace"), "SELECT * FROM (VALUES ('nation', 'public'), ('region', 'public')) t(relname, nspname)"),
    "asof_join": (_asof, "SELECT p.event_id, (SELECT max(v.event_id) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts = (SELECT max(w.ts) FROM events w WHERE w.event_type = 'view' AND w.user_id = p.user_id AND w.ts <= p.ts)) AS seen FROM events p WHERE p.event_type = 'purchase'"),
    "tumbling_window": (lambda s, d: _day(temporal.tumbling(_events(s, d), "ts", "1 day", "event_type")), "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "session_window": (lambda s, d: _day(temporal.sessions(_events(s, d), "user_id", "ts", "6 hours")), "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM h GROUP BY user_id, k"),
}


def queries() -> dict:
    out = {name: _sql(x if isinstance(x, str) else x[0]) for name, x in SQL.items()}
    return out | {name: f for name, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: x if isinstance(x, str) else x[1] for name, x in SQL.items()}
    return out | {name: sql for name, (_, sql) in OTHERS.items()}
