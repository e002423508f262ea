"""HTTP sources against a small server of this process."""

import datetime as dt
import gzip
import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from plinth.sources import http
from plinth.sources.store import Catalog, Store

HOURS = {"20250101T00": 2, "20250101T01": 1, "20250101T03": 1}
PEOPLE = 1203


def event(hour: str, i: int) -> dict:
    return {"$insert_id": f"{hour}-{i}", "event_type": "click", "server_upload_time": f"{hour[:4]}-{hour[4:6]}-{hour[6:8]} {hour[9:]}:30:00.{i:06}", "event_properties": {"a": i}}


class Handler(BaseHTTPRequestHandler):
    hours, asked, failures = dict(HOURS), [], [1]

    def log_message(self, *args):
        pass

    def answer(self, code: int, body: bytes) -> None:
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        hour = parse_qs(urlparse(self.path).query)["start"][0]
        self.asked.append(hour)
        if self.headers["Authorization"] != "Basic a2V5OnNlY3JldA==":
            self.answer(403, b"who?")
        elif hour not in self.hours:
            self.answer(404, b"Raw data files were not found.")
        else:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("a.json.gz", gzip.compress("\n".join(json.dumps(event(hour, i)) for i in range(self.hours[hour])).encode()))
            self.answer(200, out.getvalue())

    def do_POST(self):
        said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.failures:
            self.failures.pop()
            self.answer(503, b"later")
            return
        n = PEOPLE if "/people/" in self.path else 0
        at = range(said["offset"], min(said["offset"] + said["limit"], n))
        self.answer(200, json.dumps({"data": [{"values": {"record_id": [{"value": f"p{i}"}], "name": [{"full_name": f"N {i}"}]}} for i in at]}).encode())


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()
    server.server_close()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path), Catalog())


def test_window():
    start, now = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2, 5, 30)
    assert http.sync_window(None, start, now) == (start, dt.datetime(2025, 1, 2, 4))
    assert http.sync_window("2025-01-01 07:59:59.999", start, now)[0] == dt.datetime(2025, 1, 1, 8)


def test_events_stop_at_a_missing_hour_and_go_on_later(store, url):
    def ids():
        return sorted(r[0] for r in store.read("public", "events").select("insert_id").collect())

    def sync():
        http.sync_events(store, "public", "events", url, "key", "secret", dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1, 5, 10))

    sync()
    assert ids() == ["20250101T00-0", "20250101T00-1", "20250101T01-0"]
    sync()
    assert len(ids()) == 3 and Handler.asked.count("20250101T00") == 1
    Handler.hours["20250101T02"] = 1
    sync()
    assert ids()[-2:] == ["20250101T02-0", "20250101T03-0"] and len(ids()) == 5
    sync()  # the last hour alone
    assert len(ids()) == 5
    assert store.read("public", "events").filter("event_properties = '{\"a\":1}'").count() == 1


def test_refused_logins_fail(spark, url):
    spark.dataSource.register(http.EventExport)
    df = spark.read.format("event_export").options(url=url, key="key", secret="no", start="2025-01-01T00:00:00", end="2025-01-01T01:00:00").load()
    with pytest.raises(Exception, match="status 403"):
        df.collect()


def test_records_of_all_pages_once(store, url):
    http.sync_crm(store, "crm", url, "token", lanes=2)
    people = store.read("crm", "people").select("id", "name")
    assert people.count() == people.distinct().count() == PEOPLE
    assert people.filter("id = 'p1202'").first()["name"] == "N 1202"
    assert store.read("crm", "deals").count() == 0


def test_small_batches_merge_and_lost_updates_fail(store, spark):
    one = spark.range(3).toDF("a")
    store.replace("public", "t", one)
    store.append("public", "t", one)
    assert store.read("public", "t").count() == 6 and len({e["batch"] for e in store.files("public", "t")}) == 1
    store.append("public", "t", one, small=0)
    assert store.read("public", "t").count() == 9 and len({e["batch"] for e in store.files("public", "t")}) == 2
    meanwhile = store._write

    def slow(*args):
        path = meanwhile(*args)
        store._write = meanwhile
        store.replace("public", "t", one)
        return path

    store._write = slow
    with pytest.raises(RuntimeError, match="changed during"):
        store.append("public", "t", one)
    assert store.read("public", "t").count() == 3
