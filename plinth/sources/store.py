"""Versioned Parquet tables under a small transactional catalog (SQLite).

A table's version is a manifest: its data files with size, rows and the range of each of the first STATISTICS columns. A write makes
new files and a new manifest, then flips the table's pointer if it is still the one that the write began with: readers see the old
or the new version, never half of one, and of two writers that meet one fails. Files are never changed, so a version shares those that a change
doesn't touch: updates and deletes find the files that hold their keys, by the ranges and then by a semi-join of the key columns alone, and write only
these again. Old versions stay until `vacuum`.
"""

import json
import sqlite3
import uuid
from contextlib import closing
from functools import lru_cache
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Catalog:
    """Tables (schema, name, path, columns) and materialized views (schema, name, definition)."""

    def __init__(self, path: str = ":memory:"):
        self.db = sqlite3.connect(path, check_same_thread=False, isolation_level=None)
        self.db.executescript(
            """CREATE TABLE IF NOT EXISTS tables (schema TEXT, name TEXT, path TEXT, columns TEXT, PRIMARY KEY (schema, name));
            CREATE TABLE IF NOT EXISTS matviews (schema TEXT, name TEXT, definition TEXT, permissions TEXT, PRIMARY KEY (schema, name));"""
        )

    def all(self, sql: str, *args) -> list[tuple]:
        with closing(self.db.execute(sql, args)) as c:
            return c.fetchall()

    def swap(self, sql: str, *args) -> int:
        """Runs one change; how many rows it changed."""
        with closing(self.db.execute(sql, args)) as c:
            return c.rowcount

    def transaction(self, *steps: tuple[str, tuple]) -> None:
        self.db.execute("BEGIN IMMEDIATE")
        try:
            for sql, args in steps:
                self.db.execute(sql, args)
            self.db.execute("COMMIT")
        except BaseException:
            self.db.execute("ROLLBACK")
            raise


#: Columns, from the first, whose least and greatest value a manifest keeps for each file.
STATISTICS = 32
_RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.DecimalType)


class Conflict(RuntimeError):
    """A table was changed while a change of it was written."""


class Store:
    """Tables of one warehouse folder (any Hadoop path)."""

    def __init__(self, spark: SparkSession, warehouse: str, catalog: Catalog):
        self.spark, self.warehouse, self.catalog = spark, warehouse.rstrip("/"), catalog

    def exists(self, schema: str, name: str) -> bool:
        return bool(self.catalog.all("SELECT 1 FROM tables WHERE schema = ? AND name = ?", schema, name))

    def tables(self) -> list[tuple[str, str]]:
        return self.catalog.all("SELECT schema, name FROM tables ORDER BY 1, 2")

    def schema_of(self, schema: str, name: str) -> T.StructType:
        rows = self.catalog.all("SELECT columns FROM tables WHERE schema = ? AND name = ?", schema, name)
        if not rows:
            raise LookupError(f'relation "{schema}.{name}" does not exist')
        return T.StructType.fromJson(json.loads(rows[0][0]))

    # --- files

    def _path(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _pointer(self, schema: str, name: str) -> str:
        rows = self.catalog.all("SELECT path FROM tables WHERE schema = ? AND name = ?", schema, name)
        if not rows:
            raise LookupError(f'relation "{schema}.{name}" does not exist')
        return rows[0][0]

    @lru_cache(maxsize=256)  # noqa: B019  a manifest never changes
    def _manifest(self, pointer: str) -> list[dict]:
        fs, at = self._path(pointer)
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def files(self, schema: str, name: str) -> list[dict]:
        """The data files of a table's version: path, batch, bytes, rows, and ranges (least and greatest, as text) by column."""
        return self._manifest(self._pointer(schema, name))

    def _write_manifest(self, schema: str, name: str, entries: list[dict]) -> str:
        pointer = f"{self.warehouse}/{schema}/{name}/metadata/{uuid.uuid4().hex}.json"
        fs, at = self._path(pointer)
        stream = fs.create(at, False)
        try:
            stream.write(bytearray(json.dumps(entries).encode()))
        finally:
            stream.close()
        return pointer

    def _write(self, schema: str, name: str, df: DataFrame) -> str:
        path = f"{self.warehouse}/{schema}/{name}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def _entries(self, folder: str, columns: T.StructType) -> list[dict]:
        """Manifest entries of a folder just written. Ranges come from one pass over it, a row for each file."""
        ranged = [f.name for f in columns.fields[:STATISTICS] if isinstance(f.dataType, _RANGED)]
        ends = [f(f"`{c}`").cast("string").alias(f"{n}{i}") for i, c in enumerate(ranged) for n, f in (("a", F.min), ("b", F.max))]
        rows = self.spark.read.schema(columns).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"), *ends)
        return [{"path": unquote(r["path"]), "batch": folder, "bytes": r["bytes"], "rows": r["rows"], "ranges": {c: [r[f"a{i}"], r[f"b{i}"]] for i, c in enumerate(ranged)}} for r in rows.collect()]

    def _frame(self, entries: list[dict], columns: T.StructType) -> DataFrame:
        return self.spark.read.schema(columns).parquet(*[e["path"] for e in entries]) if entries else self.spark.createDataFrame([], columns)

    def _swap(self, schema: str, name: str, old: str | None, entries: list[dict], columns: T.StructType) -> None:
        new = self._write_manifest(schema, name, entries)
        if old is None:
            done = self.catalog.swap("INSERT OR IGNORE INTO tables VALUES (?, ?, ?, ?)", schema, name, new, columns.json())
        else:
            done = self.catalog.swap("UPDATE tables SET path = ?, columns = ? WHERE schema = ? AND name = ? AND path = ?", new, columns.json(), schema, name, old)
        if not done:
            raise Conflict(f"{schema}.{name} was changed during this change")

    # --- tables

    def read(self, schema: str, name: str) -> DataFrame:
        return self._frame(self.files(schema, name), self.schema_of(schema, name))

    def replace(self, schema: str, name: str, df: DataFrame) -> None:
        """Full replace: new files, then one pointer flip."""
        old = self._pointer(schema, name) if self.exists(schema, name) else None
        self._swap(schema, name, old, self._entries(self._write(schema, name, df), df.schema), df.schema)

    def _same_columns(self, schema: str, name: str, df: DataFrame) -> DataFrame:
        have = self.schema_of(schema, name)
        if set(df.columns) != set(have.names):
            raise ValueError(f"columns {sorted(df.columns)} differ from the table's {sorted(have.names)}")
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in have])

    def landed(self, df: DataFrame) -> DataFrame:
        """df as written files of no table: it is computed once. `vacuum` deletes them."""
        path = self._write("_landed", "rows", df)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, schema: str, name: str, df: DataFrame, small: int = 100 << 20, override: tuple[str, str] | None = None) -> None:
        """Adds files; the column set must be the table's. A last batch of under `small` bytes is written again with the new rows.

        override: a cursor column and its last value; the last batch is then written again in any case, without the rows that have
        it, which df brings anew. A table that was changed meanwhile fails the append instead of losing the other change.
        """
        old, columns = self._pointer(schema, name), self.schema_of(schema, name)
        rows, kept = self._same_columns(schema, name, df), self._manifest(old)
        last = [e for e in kept if e["batch"] == kept[-1]["batch"]]
        if last and (override or sum(e["bytes"] for e in last) < small):
            again = self._frame(last, columns)
            if override:
                again = again.filter(F.coalesce(F.col(f"`{override[0]}`") != F.lit(override[1]).cast(columns[override[0]].dataType), F.lit(True)))
            rows, kept = again.unionByName(rows), kept[: -len(last)]
        self._swap(schema, name, old, kept + self._entries(self._write(schema, name, rows), columns), columns)

    def touched(self, entries: list[dict], columns: T.StructType, keys: DataFrame) -> list[dict]:
        """The files of entries that hold a key. Their number bounds what comes to the driver."""
        ends = [f(f"`{c}`").alias(f"{n}{i}") for i, c in enumerate(keys.columns) for n, f in (("a", F.min), ("b", F.max))]
        if not ends or not entries:
            return []
        low_high = keys.agg(*ends).first()

        def apart(e: dict) -> bool:
            for i, c in enumerate(keys.columns):
                a, b = e["ranges"].get(c, (None, None))
                x, y = low_high[f"a{i}"], low_high[f"b{i}"]
                if x is None:
                    return True  # no key, or null ones only
                if a is not None and isinstance(columns[c].dataType, T.LongType | T.IntegerType | T.ShortType | T.ByteType) and isinstance(x, int) and (int(b) < x or int(a) > y):
                    return True
                if a is not None and isinstance(columns[c].dataType, T.StringType) and isinstance(x, str) and (b.encode() < x.encode() or a.encode() > y.encode()):
                    return True
            return False

        near = [e for e in entries if not apart(e)]
        if not near:
            return []
        rows = self._frame(near, columns).select(*[f"`{c}`" for c in keys.columns], F.col("_metadata.file_path").alias("_plinth_file"))
        there = {unquote(r[0]) for r in rows.join(keys, keys.columns, "left_semi").select("_plinth_file").distinct().collect()}
        return [e for e in near if e["path"] in there]

    def update(self, schema: str, name: str, df: DataFrame, keys: list[str], insert: bool = False) -> None:
        """Rows whose whole key is in df take df's values; with insert, unmatched rows of df are added (upsert). Only files that hold a key are written again."""
        old, columns = self._pointer(schema, name), self.schema_of(schema, name)
        new, entries = self._same_columns(schema, name, df), self._manifest(old)
        files = self.touched(entries, columns, new.select(*keys))
        rows = self._frame(files, columns)
        kept = rows.join(new.select(*keys), keys, "left_anti").select(*columns.names)
        taken = new if insert else new.join(rows.select(*keys), keys, "left_semi").select(*columns.names)
        self._rewrite(schema, name, old, entries, files, kept.unionByName(taken), columns)

    def delete(self, schema: str, name: str, keys: DataFrame) -> None:
        """Rows whose whole key is in keys go; null keys match nothing. Only files that hold a key are written again."""
        old, columns = self._pointer(schema, name), self.schema_of(schema, name)
        entries = self._manifest(old)
        files = self.touched(entries, columns, keys)
        if files:
            self._rewrite(schema, name, old, entries, files, self._frame(files, columns).join(keys, keys.columns, "left_anti").select(*columns.names), columns)

    def _rewrite(self, schema: str, name: str, old: str, entries: list[dict], gone: list[dict], rows: DataFrame, columns: T.StructType) -> None:
        paths = {e["path"] for e in gone}
        kept = [e for e in entries if e["path"] not in paths]
        self._swap(schema, name, old, kept + self._entries(self._write(schema, name, rows), columns), columns)

    def last_cursor(self, schema: str, name: str, column: str) -> str | None:
        return self.read(schema, name).agg(F.max(column).cast("string")).first()[0]

    def rename(self, schema: str, name: str, to: str) -> None:
        self.catalog.transaction(*[(f"UPDATE {t} SET name = ? WHERE schema = ? AND name = ?", (to, schema, name)) for t in ("tables", "matviews")])

    def drop(self, schema: str, name: str) -> None:
        self.catalog.transaction(*[(f"DELETE FROM {t} WHERE schema = ? AND name = ?", (schema, name)) for t in ("tables", "matviews")])

    def vacuum(self) -> None:
        """Deletes files and manifests that no table's version holds."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        pointers = [p for (p,) in self.catalog.all("SELECT path FROM tables")]
        tail = lambda path: "/".join(path.split("/")[-2:])
        live = {tail(p) for p in pointers} | {tail(e["path"]) for p in pointers for e in self._manifest(p)}
        for pattern in ("data/*/*", "metadata/*"):
            root = jvm.org.apache.hadoop.fs.Path(f"{self.warehouse}/*/*/{pattern}")
            fs = root.getFileSystem(conf)
            for status in fs.globStatus(root) or []:
                if tail(status.getPath().toString()) not in live:
                    fs.delete(status.getPath(), True)
