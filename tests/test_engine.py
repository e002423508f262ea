"""The engine's safety, dialect and stored tables, beside the queries that the oracle covers."""

import logging

import pytest
from pyspark.sql import functions as F

from plinth.engine import Engine, narrowed
from plinth.functions import dialect
from plinth.functions.tokens import UnsupportedSyntax, comments, tokens
from plinth.sources import database
from plinth.sources.ingest import json_rows
from plinth.sources.store import Catalog, Conflict, Store
from plinth.sources.sync import COMMANDS, DatabaseConfig
from plinth.sources.values import SourceColumn


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.register("t", spark.createDataFrame([(i, f"N{i % 3}", f"s{i}") for i in range(9)], "k int, n string, s string"))
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("said", ["\\' OR 1=1 --", "\\", "' OR '1'='1", "\\\\'", "${env:HOME}", "a\nb", "/*", "N0' --", "é\\u0027"])
def test_parameters_are_values(engine, said):
    assert rows(engine.prepare("SELECT count(*) FROM t WHERE n = $1").bind(said).execute()) == [(0,)]
    assert rows(engine.prepare("SELECT $1 AS x, 'N' AS y").bind(said).execute()) == [(said, "N")]


def test_literals():
    for text, want in (("'a\\b'", "'a\\\\b'"), ("E'a\\nb\\'c\\\\'", "'a\nb''c\\\\'"), ("e'\\x41\\u0042\\103'", "'ABC'"), ("'it''s'", "'it''s'")):
        assert dialect.literals(tokens(text))[0].text == want
    assert dialect.array_items('{a,"b,c",NULL,"NULL","d\\"e", x y }') == ["a", "b,c", None, "NULL", 'd"e', "x y"] and dialect.array_items("{}") == []
    with pytest.raises(UnsupportedSyntax):
        tokens("'\x00' \x01")


def test_permissions_narrow_only(engine):
    comment = '/*PLINTH_PERMISSIONS {"public.t": ["k", "s"]} PLINTH_PERMISSIONS*/'
    assert engine.sql(f"SELECT * FROM t {comment}", {"public.t": ["k"]}).columns == ["k"]
    assert engine.sql(f"SELECT * FROM t WHERE s <> '{comment}'", {"public.t": ["k", "s"]}).columns == ["k", "s"]
    assert engine.sql(f"SELECT * FROM t {comment}").columns == ["k", "s"]
    assert engine.sql(f"SELECT * FROM t {comment} /*PLINTH_PERMISSIONS {{}} PLINTH_PERMISSIONS*/").columns == ["?column?"]
    assert comments(f"SELECT 'x {comment}' /* y */ -- /* z */") == ["/* y */"] and narrowed({"a": ["b"]}, "SELECT 1") == {"a": ["b"]}
    assert engine.prepare(f"SELECT * FROM t {comment}", {"public.t": ["k"]}).execute().columns == ["k"]


def test_views_keep_their_makers_permissions(engine):
    engine.sql("CREATE MATERIALIZED VIEW v AS SELECT * FROM t", {"public.t": ["k"]})
    engine.sql("REFRESH MATERIALIZED VIEW v")
    assert engine.sql("SELECT * FROM v").columns == ["k"]


def test_concurrent_refresh_logs_errors(engine, caplog):
    with caplog.at_level(logging.ERROR, "plinth"):
        engine._refresh_later("public", "nothing")
    assert "nothing" in caplog.text
    engine.sql("CREATE MATERIALIZED VIEW v AS SELECT k FROM t WITH NO DATA; ALTER MATERIALIZED VIEW v RENAME TO w")
    engine._refresh_later("public", "w")
    assert engine.sql("SELECT * FROM w").count() == 9


def test_unknown_tables_fail(engine):
    for text in ("SELECT * FROM pg_nonsense", "SELECT * FROM information_schema.nothing", "SELECT * FROM nothing"):
        with pytest.raises(LookupError):
            engine.sql(text)
    engine.register("pg_mine", engine.spark.range(2))
    assert engine.sql("SELECT * FROM pg_mine").count() == 2 and engine.sql("SELECT * FROM pg_locks").count() == 0
    assert not [v for v in engine.spark.catalog.listTables() if v.name.startswith("plinth_")]


def test_inspect_and_unknown_settings(engine, caplog):
    with caplog.at_level(logging.WARNING, "plinth"):
        engine.sql("SELECT k FROM t --INSPECT")
        engine.sql("SET strange TO 1; SET client_encoding TO 'UTF8'")
    assert "Physical Plan" in caplog.text and "strange" in caplog.text and "client_encoding" not in caplog.text


# --- stored tables


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, str(tmp_path), Catalog())
    out.replace("public", "t", spark.range(0, 1000, 1, 4).select("id", F.concat(F.lit("v"), "id").alias("v")))
    return out


def test_manifest(store):
    files = store.files("public", "t")
    assert len(files) == 4 and sum(f["rows"] for f in files) == 1000 and all(f["bytes"] > 0 for f in files)
    assert sorted(map(int, (f["ranges"]["id"][0] for f in files))) == [0, 250, 500, 750]


def test_changes_rewrite_only_files_that_hold_keys(store, spark):
    before = {f["path"] for f in store.files("public", "t")}
    store.update("public", "t", spark.createDataFrame([(3, "new"), (5000, "none")], "id long, v string"), ["id"])
    after = {f["path"] for f in store.files("public", "t")}
    assert len(before & after) == 3 and rows(store.read("public", "t").filter("v IN ('new', 'none')")) == [(3, "new")] and store.read("public", "t").count() == 1000
    store.update("public", "t", spark.createDataFrame([(4, "new"), (5000, "added"), (None, "null")], "id long, v string"), ["id"], insert=True)
    assert store.read("public", "t").count() == 1002
    store.delete("public", "t", spark.createDataFrame([(5000,), (999,)], "id long"))
    assert store.read("public", "t").count() == 1000 and len(before & {f["path"] for f in store.files("public", "t")}) == 2
    same = store.files("public", "t")
    store.delete("public", "t", spark.createDataFrame([(77777,), (None,)], "id long"))
    store.delete("public", "t", spark.createDataFrame([], "id long"))
    assert store.files("public", "t") == same
    store.vacuum()
    assert store.read("public", "t").count() == 1000


def test_two_writers_conflict(store, spark):
    write = store._write

    def meanwhile(*args):
        store._write = write
        store.delete("public", "t", spark.createDataFrame([(1,)], "id long"))
        return write(*args)

    for change in (lambda: store.delete("public", "t", spark.createDataFrame([(900,)], "id long")), lambda: store.replace("public", "t", spark.range(1).select("id", F.lit("x").alias("v"))), lambda: store.update("public", "t", spark.createDataFrame([(800, "x")], "id long, v string"), ["id"])):
        store.append("public", "t", spark.createDataFrame([(1, "again")], "id long, v string"))
        store._write = meanwhile
        with pytest.raises(Conflict):
            change()
        assert store.read("public", "t").filter("id = 1").count() == 0 and store.read("public", "t").count() == 999


def test_cursor_override(store, spark):
    store.append("public", "t", spark.createDataFrame([(999, "again"), (1000, "more")], "id long, v string"), small=0, override=("id", "999"))
    assert rows(store.read("public", "t").filter("id >= 998").orderBy("id")) == [(998, "v998"), (999, "again"), (1000, "more")]


def test_empty_tables(store, spark):
    store.replace("public", "e", spark.createDataFrame([], "id long, v string"))
    assert store.read("public", "e").count() == 0
    store.update("public", "e", spark.createDataFrame([(1, "a")], "id long, v string"), ["id"])
    assert store.read("public", "e").count() == 0
    store.append("public", "e", spark.createDataFrame([(1, "a")], "id long, v string"))
    store.delete("public", "e", spark.createDataFrame([(1,)], "id long"))
    assert store.read("public", "e").count() == 0


# --- discovery


def test_discovery(spark):
    answers = {
        database.TABLES: [("public", "a"), ("s", "b")],
        database.COLUMNS: [("public", "a", "id", "int4", "NO", 32, 0, "pg_catalog"), ("public", "a", "n", "numeric", "YES", 20, 2, "pg_catalog"), ("public", "a", "tags", "_text", "YES", None, None, "pg_catalog"), ("s", "b", "where", "address", "YES", None, None, "public")],
        database.UNIQUE: [("public", "a", "a_two", "id", ), ("public", "a", "a_two", "n"), ("public", "a", "a_one", "id")],
    }
    ask = answers.__getitem__
    assert database.tables(ask) == [("public", "a"), ("s", "b")] and database.unique_keys(ask) == {("public", "a"): ["id"]}
    found = database.columns(ask)
    assert found["public", "a"] == [SourceColumn("id", "int4", False), SourceColumn("n", "numeric(20,2)"), SourceColumn("tags", "_text")] and found["s", "b"][0].user_defined
    raw = spark.createDataFrame([("7", "1.50", "{x,y}"), (None, None, None)], "id string, n string, tags string")
    typed = database.typed_rows(raw, found["public", "a"], {"n"})
    assert typed.dtypes == [("id", "int"), ("tags", "array<string>")] and rows(typed) == [(7, ["x", "y"]), (None, None)]


def test_json_rows(spark, tmp_path):
    columns = [SourceColumn("id", "int4"), SourceColumn("doc", "jsonb"), SourceColumn("tags", "_text")]
    (tmp_path / "a.json").write_text('{"id": 7, "doc": {"k": [1]}, "tags": "{x,y}"}\n{"tags": null, "doc": null, "id": null}\n')
    assert rows(json_rows(spark, str(tmp_path / "a.json"), columns)) == [(7, '{"k":[1]}', ["x", "y"]), (None, None, None)]
    for line in ('{"id": 7, "doc": 1}', '{"id": 7, "doc": 1, "tags": "{}", "more": 1}', "nothing"):
        (tmp_path / "b.json").write_text(line)
        with pytest.raises(Exception, match="columns of a row differ"):
            json_rows(spark, str(tmp_path / "b.json"), columns).collect()


def test_sync_options(monkeypatch):
    monkeypatch.setenv("PLINTH_PASSWORD", "p")
    c = DatabaseConfig.read("--warehouse w --catalog c --url jdbc:x --include-tables public.a,s.b".split())
    assert (c.schema, c.password, c.include_tables) == ("public", "p", "public.a,s.b") and set(COMMANDS) == {"database", "events", "crm"}
    with pytest.raises(SystemExit):
        DatabaseConfig.read([])
