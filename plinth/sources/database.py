"""Discovery of a relational database's tables, columns and keys, and their full refresh into stored tables."""

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.sources.ingest import chosen, database_rows, full_refresh, target_name, unique_key
from plinth.sources.values import SourceColumn, field, typed

#: Answers a query with rows; of JDBC, or of any connection in tests.
Ask = Callable[[str], list[tuple]]

_SYSTEM = "('pg_catalog', 'pg_toast', 'information_schema')"
TABLES = f"SELECT table_schema, table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE' AND table_schema NOT IN {_SYSTEM} ORDER BY 1, 2"
COLUMNS = f"SELECT table_schema, table_name, column_name, udt_name, is_nullable, numeric_precision, numeric_scale, udt_schema FROM information_schema.columns WHERE table_schema NOT IN {_SYSTEM} ORDER BY 1, 2, ordinal_position"
UNIQUE = f"""SELECT s.nspname, t.relname, i.relname, a.attname FROM pg_index x JOIN pg_class t ON t.oid = x.indrelid JOIN pg_namespace s ON s.oid = t.relnamespace JOIN pg_class i ON i.oid = x.indexrelid
    JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = ANY(x.indkey) WHERE x.indisunique AND x.indpred IS NULL AND s.nspname NOT IN {_SYSTEM} ORDER BY 1, 2, 3, array_position(x.indkey::int2[], a.attnum)"""


def jdbc(spark: SparkSession, url: str, **options: str) -> Ask:
    return lambda sql: [tuple(r) for r in spark.read.format("jdbc").option("url", url).option("query", sql).options(**options).load().collect()]


def tables(ask: Ask) -> list[tuple[str, str]]:
    return [(s, t) for s, t in ask(TABLES)]


def columns(ask: Ask) -> dict[tuple[str, str], list[SourceColumn]]:
    """Columns of each table, in order. Types of other schemas are the user's own."""
    out = defaultdict(list)
    for schema, table, name, kind, nullable, precision, scale, home in ask(COLUMNS):
        sized = f"{kind}({precision},{scale or 0})" if kind == "numeric" and precision is not None else kind
        out[schema, table].append(SourceColumn(name, sized, nullable == "YES", home not in (None, "pg_catalog")))
    return dict(out)


def unique_keys(ask: Ask) -> dict[tuple[str, str], list[str]]:
    """The columns of each table's best unique index."""
    indexes: dict = defaultdict(lambda: defaultdict(list))
    for schema, table, index, column in ask(UNIQUE):
        indexes[schema, table][index].append(column)
    return {t: unique_key(x) for t, x in indexes.items()}


def typed_rows(raw: DataFrame, source: list[SourceColumn], ignored: set[str] = frozenset()) -> DataFrame:
    """Rows read with every column as text, by the rules of their source types."""
    out = []
    for c in source:
        if c.name not in ignored:
            f = field(c)
            out.append(typed(F.col(f"`{c.name}`").cast("string"), c).alias(f.name, metadata=f.metadata))
    return raw.select(*out)


def sync(store, url: str, schema: str, include: set[str] | None = None, exclude: set[str] | None = None, ignore: set[str] = frozenset(), **options: str) -> None:
    """Full refresh of a database's tables: discovery, then each read as text (so that no type is lost) and stored; tables gone from the source are dropped.

    ignore: schema.table.column that aren't read.
    """
    ask = jdbc(store.spark, url, **options)
    found = columns(ask)
    frames = {}
    for s, t in chosen(tables(ask), include, exclude):
        gone = {c.rsplit(".", 1)[1] for c in ignore if c.rsplit(".", 1)[0] == f"{s}.{t}"}
        named = ", ".join('"' + c.name.replace('"', '""') + '"::text' for c in found[s, t] if c.name not in gone)
        query = f'(SELECT {named} FROM "{s}"."{t}") AS source'
        frames[target_name(s, t)] = typed_rows(database_rows(store.spark, url, query, **options), found[s, t], gone)
    full_refresh(store, schema, frames)
