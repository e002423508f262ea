"""Commands that bring a source's data into stored tables: python -m plinth.sources.sync database | events | crm."""

import argparse
import datetime as dt
import os
from dataclasses import dataclass, fields

from plinth.sources import database, http
from plinth.sources.store import Catalog, Store


@dataclass
class SyncConfig:
    """Each field is an option (--warehouse) and an environment variable (PLINTH_WAREHOUSE); options win."""

    warehouse: str = ""
    catalog: str = ""
    schema: str = "public"
    url: str = ""

    @classmethod
    def read(cls, args: list[str]) -> "SyncConfig":
        parser = argparse.ArgumentParser(prog="plinth.sources.sync")
        for f in fields(cls):
            parser.add_argument("--" + f.name.replace("_", "-"), default=os.environ.get(f"PLINTH_{f.name.upper()}", f.default))
        out = cls(**vars(parser.parse_args(args)))
        if not (out.warehouse and out.catalog and out.url):
            parser.error("--warehouse, --catalog and --url are needed")
        return out

    def store(self, spark) -> Store:
        return Store(spark, self.warehouse, Catalog(self.catalog))


def _names(text: str) -> set[str]:
    return {x.strip() for x in text.split(",") if x.strip()}


@dataclass
class DatabaseConfig(SyncConfig):
    """url is a JDBC URL, whose driver must be on the class path; tables and columns are given as lists with commas."""

    user: str = ""
    password: str = ""
    include_tables: str = ""
    exclude_tables: str = ""
    ignore_columns: str = ""

    def run(self, spark) -> None:
        login = {k: v for k, v in (("user", self.user), ("password", self.password)) if v}
        database.sync(self.store(spark), self.url, self.schema, _names(self.include_tables), _names(self.exclude_tables), _names(self.ignore_columns), **login)


@dataclass
class EventsConfig(SyncConfig):
    key: str = ""
    secret: str = ""
    table: str = "events"
    start_date: str = "2025-01-01"

    def run(self, spark) -> None:
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        http.sync_events(self.store(spark), self.schema, self.table, self.url, self.key, self.secret, dt.datetime.fromisoformat(self.start_date), now)


@dataclass
class CrmConfig(SyncConfig):
    token: str = ""

    def run(self, spark) -> None:
        http.sync_crm(self.store(spark), self.schema, self.url, self.token)


COMMANDS = {"database": DatabaseConfig, "events": EventsConfig, "crm": CrmConfig}


def main(args: list[str] | None = None) -> None:
    import sys

    from plinth.session import session

    args = sys.argv[1:] if args is None else args
    if not args or args[0] not in COMMANDS:
        raise SystemExit(f"one of {', '.join(COMMANDS)}")
    COMMANDS[args[0]].read(args[1:]).run(session())


if __name__ == "__main__":
    main()
