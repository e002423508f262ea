"""Sources over HTTP as Python data sources: tasks fetch, the driver holds no data.

`event_export`: hourly exports of product events (a zip of gzipped JSON lines), one task an hour.
`crm_records`: records in pages by offset, in as many lanes as `lanes` says.
"""

import base64
import datetime as dt
import gzip
import io
import json
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plinth.sources.ingest import CRM_COLUMNS, CURSOR, append_events, crm_of, event_schema, events_of, full_refresh
from plinth.sources.store import Store

#: How hours are written, how far the export lags, records in a page, text of answers that mean "no such hour".
HOUR, DELAY, PAGE, ABSENT = "%Y%m%dT%H", dt.timedelta(hours=1), 500, "Raw data files were not found."
TRIES, TIMEOUT_S = 4, 300


class Missing(LookupError):
    """The server has nothing for what was asked."""


def fetch(request: urllib.request.Request, tries: int = TRIES, wait: float = 1.0) -> bytes:
    """The body of an answer. Refused or dropped connections, 429 and 5xx are tried again, each time later."""
    for i in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            said = e.read().decode(errors="replace")
            if e.code == 404 or ABSENT in said:
                raise Missing(said) from e
            if e.code != 429 and e.code < 500 or i == tries - 1:
                raise RuntimeError(f"status {e.code}: {said[:500]}") from e
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if i == tries - 1:
                raise
        time.sleep(wait * 2**i)
    raise ValueError("tries must be positive")


@dataclass
class Hour(InputPartition):
    start: str


class _Hours(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.first, self.end = options["url"], *(dt.datetime.fromisoformat(options[x]) for x in ("start", "end"))
        self.login = base64.b64encode(f"{options['key']}:{options['secret']}".encode()).decode()

    def partitions(self) -> list[Hour]:
        n = max(0, int((self.end - self.first) / dt.timedelta(hours=1)))
        return [Hour((self.first + dt.timedelta(hours=i)).strftime(HOUR)) for i in range(n)]

    def read(self, partition: Hour) -> Iterator[tuple[str, str | None]]:
        asked = urllib.request.Request(f"{self.url}?{urlencode({'start': partition.start, 'end': partition.start})}", headers={"Authorization": f"Basic {self.login}"})
        try:
            body = fetch(asked)
        except Missing:
            yield partition.start, None
            return
        with zipfile.ZipFile(io.BytesIO(body)) as archive:
            for name in archive.namelist():
                with archive.open(name) as packed, gzip.open(packed) as lines:
                    for line in lines:
                        if line.strip():
                            yield partition.start, line.decode()


class EventExport(DataSource):
    """Options url, key, secret, start, end (ISO hours, end exclusive). A missing hour is one row with a null line."""

    @classmethod
    def name(cls) -> str:
        return "event_export"

    def schema(self) -> str:
        return "hour string, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Hours(dict(self.options))


@dataclass
class Lane(InputPartition):
    first: int


class _Lanes(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.kind, self.token = options["url"].rstrip("/"), options["object"], options["token"]
        self.lanes, self.page = int(options.get("lanes", 1)), int(options.get("page", PAGE))

    def partitions(self) -> list[Lane]:
        return [Lane(i) for i in range(self.lanes)]

    def read(self, partition: Lane) -> Iterator[tuple[str]]:
        """Every lanes-th page from its own first on, until one is short."""
        at = partition.first * self.page
        while True:
            body = json.dumps({"limit": self.page, "offset": at}).encode()
            asked = urllib.request.Request(f"{self.url}/objects/{self.kind}/records/query", body, {"Authorization": f"Bearer {self.token}", "Content-Type": "application/json"}, method="POST")
            records = json.loads(fetch(asked))["data"]
            for r in records:
                yield (json.dumps(r),)
            if len(records) < self.page:
                return
            at += self.lanes * self.page


class CrmRecords(DataSource):
    """Options url, object, token, lanes, page."""

    @classmethod
    def name(cls) -> str:
        return "crm_records"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> DataSourceReader:
        return _Lanes(dict(self.options))


def sync_window(last: str | None, start: dt.datetime, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """Hours to fetch: from the one after the last cursor's (at first: start) to that which ended DELAY ago, exclusive."""
    first = start if last is None else dt.datetime.fromisoformat(last).replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)
    return first, (now - DELAY).replace(minute=0, second=0, microsecond=0)


def sync_events(store: Store, schema: str, name: str, url: str, key: str, secret: str, start: dt.datetime, now: dt.datetime) -> None:
    """Appends the hours since the last cursor. From the first missing hour on, nothing is taken: it is asked for again next time.

    What was fetched is written to the store's folder before it is looked at, so no hour is fetched twice.
    """
    spark = store.spark
    spark.dataSource.register(EventExport)
    last = store.last_cursor(schema, name, CURSOR) if store.exists(schema, name) else None
    first, end = sync_window(last, start, now)
    raw = spark.read.format("event_export").options(url=url, key=key, secret=secret, start=first.isoformat(), end=end.isoformat()).load() if first < end else spark.createDataFrame([], "hour string, line string")
    landed = store.landed(raw)
    missing = landed.filter("line IS NULL").agg(F.min("hour")).first()[0]
    lines = landed.filter("line IS NOT NULL" if missing is None else F.col("line").isNotNull() & (F.col("hour") < missing))
    append_events(store, schema, name, events_of(lines.select(F.from_json("line", event_schema()).alias("e")).select("e.*")))


def sync_crm(store: Store, schema: str, url: str, token: str, lanes: int = 4, kinds: tuple[str, ...] = tuple(CRM_COLUMNS)) -> None:
    """Replaces the tables of companies, people and deals."""
    spark: SparkSession = store.spark
    spark.dataSource.register(CrmRecords)

    def rows(kind: str) -> DataFrame:
        raw = spark.read.format("crm_records").options(url=url, token=token, object=kind, lanes=str(lanes)).load()
        return crm_of(raw.select(F.from_json("line", "values map<string, array<string>>").alias("r")).select("r.values"), kind)

    full_refresh(store, schema, {kind: rows(kind) for kind in kinds})
