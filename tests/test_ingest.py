"""Loaders, value rules, text rendering and streams on small rows."""

import gzip
import json

import pytest

from plinth.functions.render import render
from plinth.sources import ingest
from plinth.sources.store import Catalog, Store
from plinth.sources.values import SourceColumn, UnsupportedType, spark_type
from plinth.streaming import incremental

# name, type, text, rendered through doubles
VALUES = [
    ("bool_column", "bool", "t", "t"),
    ("text_column", "text", "", ""),
    ("null_column", "text", ingest.NULL, None),
    ("int2_column", "int2", "-32767", "-32767"),
    ("int8_column", "int8", "9223372036854775807", "9.223372036854776e+18"),
    ("hugeint_column", "numeric(20,0)", "10000000000000000000", "1e+19"),
    ("xid_column", "xid", "4294967295", "4294967295"),
    ("xid8_column", "xid8", "18446744073709551615", "1.8446744073709552e+19"),
    ("float4_column", "float4", "NaN", "0"),
    ("float8_column", "float8", "-3.141592653589793", "-3.141592653589793"),
    ("numeric_column", "numeric(40,2)", "-12345.00", "-12345"),
    ("numeric_free", "numeric", "12345.67", "12345.67"),
    ("date_column", "date", "20025-11-12", "20025-11-12"),
    ("time_column", "time(6)", "12:00:00.123456", "12:00:00.123456"),
    ("timetz_column", "timetz(6)", "12:00:00.12300+05", "07:00:00.123"),
    ("timetz_west", "timetz(6)", "12:00:00.123456-05", "17:00:00.123456"),
    ("timestamp_column", "timestamp(6)", "2024-01-01 12:00:00", "2024-01-01 12:00:00"),
    ("timestamptz_column", "timestamptz(6)", "2024-01-01 12:00:00.000123+05:30", "2024-01-01 06:30:00.000123"),
    ("interval_column", "interval(6)", "1 mon 2 days 01:00:01.000001", "2.806201000001e+12"),
    ("bytea_column", "bytea", "\\x48656c6c6f", "\\x48656c6c6f"),
    ("point_column", "point", "(37.3,45.0)", "(37.3,45.0)"),
    ("json_column", "jsonb", '{"b": 1, "a": {"k": "v"}}', '{"a":{"k":"v"},"b":1}'),
    ("array_text", "_text", "{one,two,three}", "{one,two,three}"),
    ("array_int", "_int4", "{}", "{}"),
    ("array_jsonb", "_jsonb", '{"{\\"key\\": \\"value1\\"}","{\\"key\\": \\"value2\\"}"}', '{"{""key"": ""value1""}","{""key"": ""value2""}"}'),
]


def test_export_values_and_rendering(spark, tmp_path):
    quote = lambda x: '"' + x.replace('"', '""') + '"' if x and x != ingest.NULL else x
    (tmp_path / "t.csv").write_text(",".join(v[0] for v in VALUES) + "\n" + ",".join(quote(v[2]) for v in VALUES) + "\n")
    columns = [SourceColumn(n, t) for n, t, _, _ in VALUES]
    row = render(ingest.export_rows(spark, str(tmp_path / "t.csv"), columns), exact=False).first().asDict()
    assert row == {n: out for n, _, _, out in VALUES}


def test_decimals_are_saturated_and_unknown_types_raise(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n123456,1.005\n-123456,nan\n")
    rows = render(ingest.export_rows(spark, str(tmp_path / "t.csv"), [SourceColumn("a", "numeric(4,1)"), SourceColumn("b", "numeric(6,2)")])).collect()
    assert [tuple(r) for r in rows] == [("999", "1.01"), ("-999", "0")]
    with pytest.raises(UnsupportedType):
        spark_type(SourceColumn("a", "money"))


def test_floats(spark):
    df = spark.sql("SELECT 100000.5D a, 1e20D b, 1e21D c, 0.0001D d, 0.00001D e, -0.5D f, 123456789D g, CAST('Infinity' AS DOUBLE) h, 0D i, CAST(NULL AS DOUBLE) j")
    assert tuple(render(df).first()) == ("100000.5", "1e+20", "1e+21", "0.0001", "1e-05", "-0.5", "1.23456789e+08", "+Inf", "0", None)


def test_choice_of_tables_and_keys():
    tables = [("public", "a"), ("s", "b")]
    assert ingest.chosen(tables, include={"s.b"}) == [("s", "b")]
    assert ingest.chosen(tables, exclude={"s.b"}) == [("public", "a")]
    with pytest.raises(ValueError):
        ingest.chosen(tables, {"s.b"}, {"s.b"})
    assert ingest.unique_key({"x": ["a", "b"], "y": ["c"], "z": ["user_id"]}) == ["user_id"]
    assert [ingest.target_name(*t) for t in tables] == ["a", "s_b"]


def _event(i, **more):
    return {"uuid": f"u{i}", "$insert_id": f"i{i}", "event_type": "click", "event_properties": {"k": i}, "amplitude_id": i, "paying": None, "server_upload_time": f"2024-01-0{i} 00:00:00.5", "user_creation_time": "", **more}


def _land(path, name, events):
    path.mkdir(exist_ok=True)
    with gzip.open(path / f"{name}.json.gz", "wt") as f:
        f.writelines(json.dumps(e) + "\n" for e in events)


def test_events_are_typed_and_appended_by_cursor(spark, tmp_path):
    _land(tmp_path / "one", "a", [_event(1), _event(2)])
    _land(tmp_path / "two", "a", [_event(2), _event(3)])
    rows = ingest.event_rows(spark, str(tmp_path / "one"))
    assert len(rows.columns) == 55
    first = rows.orderBy("uuid").first()
    assert (first.insert_id, json.loads(first.event_properties), first.amplitude_id, first.user_creation_time) == ("i1", {"k": 1}, 1, None)
    store = Store(spark, str(tmp_path / "w"), Catalog())
    for part in ("one", "two"):
        ingest.append_events(store, "public", "events", ingest.event_rows(spark, str(tmp_path / part)))
    assert sorted(r.uuid for r in store.read("public", "events").collect()) == ["u1", "u2", "u3"]


def test_stream_adds_each_event_once(spark, tmp_path):
    store, land = Store(spark, str(tmp_path / "w"), Catalog()), tmp_path / "land"
    for name, events in (("a", [_event(1), _event(1)]), ("b", [_event(1), _event(2)])):
        _land(land, name, events)
        incremental.append_stream(incremental.event_stream(spark, str(land)), store, "public", "events", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.uuid for r in store.read("public", "events").collect()) == ["u1", "u2"]


def test_windowed_counts(spark, tmp_path):
    _land(tmp_path / "land", "a", [_event(1), _event(1), _event(2)])
    counts = incremental.windowed_counts(incremental.event_stream(spark, str(tmp_path / "land")), "server_upload_time", "1 day", "1 hour", "event_type")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]


def test_crm_records_are_flattened(spark, tmp_path):
    company = {"values": {"record_id": [{"value": "c1"}], "domains": [{"domain": "a.org"}, {"domain": "b.org"}], "primary_location": [{"line_1": "", "locality": "Oslo", "country_code": "NO"}], "categories": [{"option": {"title": "B2B"}}], "funding_raised_usd": [{"currency_value": 2.5}], "first_interaction": [{"interacted_at": "2024-01-01T10:00:00.000000000Z"}], "foundation_date": [{"value": "2020-02-03"}]}}
    (tmp_path / "c.json").write_text(json.dumps(company) + "\n" + json.dumps({"values": {}}) + "\n")
    df = ingest.crm_rows(spark, str(tmp_path / "c.json"), "companies")
    assert [len(ingest.crm_rows(spark, str(tmp_path / "c.json"), k).columns) for k in ("companies", "people", "deals")] == [33, 30, 9]
    row, empty = sorted(df.collect(), key=lambda r: r.id is None)
    assert (row.id, row.domains, row.primary_location, row.categories, row.funding_raised_usd, str(row.first_interaction), str(row.foundation_date)) == ("c1", ["a.org", "b.org"], "Oslo, NO", ["B2B"], 2.5, "2024-01-01 10:00:00", "2020-02-03")
    assert (empty.id, empty.team, empty.primary_location) == (None, [], None)


def test_full_refresh_drops_tables_that_are_gone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "w"), Catalog())
    ingest.full_refresh(store, "public", {"a": spark.range(2), "b": spark.range(3)})
    ingest.full_refresh(store, "public", {"b": spark.range(1)})
    assert store.tables() == [("public", "b")] and store.read("public", "b").count() == 1
