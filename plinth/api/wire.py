"""The wire protocol (version 3) over an engine: simple and extended queries, results as text.

Results are read partition by partition, so that the driver never holds a whole one. Connections share one engine: its
statements are planned one at a time and run side by side.
"""

import logging
import socketserver
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plinth.api import scram
from plinth.api.config import ServerConfig
from plinth.engine import Engine, Prepared, UnsupportedStatement
from plinth.functions.render import render
from plinth.sources.store import Catalog

#: Codes that a client may send instead of a protocol version.
SSL_REQUEST, GSS_REQUEST, CANCEL_REQUEST, VERSION_3 = 80877103, 80877104, 80877102, 196608
#: Type, its oid, the oid of its arrays, its size.
OIDS = {
    T.BooleanType: (16, 1000, 1), T.BinaryType: (17, 1001, -1), T.ByteType: (21, 1005, 2), T.ShortType: (21, 1005, 2), T.IntegerType: (23, 1007, 4), T.LongType: (20, 1016, 8),
    T.FloatType: (700, 1021, 4), T.DoubleType: (701, 1022, 8), T.DecimalType: (1700, 1231, -1), T.StringType: (25, 1009, -1), T.DateType: (1082, 1182, 4),
    T.TimestampNTZType: (1114, 1115, 8), T.TimestampType: (1184, 1185, 8), T.DayTimeIntervalType: (1186, 1187, 16), T.YearMonthIntervalType: (1186, 1187, 16),
    T.StructType: (114, 199, -1), T.MapType: (114, 199, -1), T.VariantType: (114, 199, -1),
}
#: Logical types of texts.
LOGICAL = {"json": (114, 199, -1), "time": (1083, 1183, 8), "uuid": (2950, 2951, 16)}
#: Long columns of these names hold object ids.
OID_COLUMNS = ("oid", "tableoid", "relnamespace", "relowner", "relfilenode", "did", "objoid", "classoid")
STARTUP = {"client_encoding": "UTF8", "server_version": "17.0"}
LARGEST = 1 << 30
TEXT = (25, 1009, -1)

log = logging.getLogger(__name__)


class ProtocolError(ValueError):
    pass


def type_of(field: T.StructField) -> tuple[int, int]:
    """Oid and size of a result's column."""
    kind = field.dataType
    if isinstance(kind, T.LongType) and field.name in OID_COLUMNS:
        return 26, 4
    if isinstance(kind, T.ArrayType):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        return OIDS.get(type(kind), TEXT)[1], -1
    oid, _, size = LOGICAL.get(field.metadata.get("logical_type"), OIDS.get(type(kind), TEXT))
    return oid, size


def parameter(raw: bytes | None, form: int) -> str | int | None:
    """A bound value: text, or binary of 4 (int32), 8 (int64) or 16 bytes (UUID)."""
    if raw is None:
        return None
    if form == 0:
        return raw.decode()
    if len(raw) == 16:
        return str(uuid.UUID(bytes=raw))
    if len(raw) not in (4, 8):
        raise ProtocolError(f"unsupported binary parameter of {len(raw)} bytes")
    return int.from_bytes(raw, "big", signed=True)


class Portal:
    """A bound statement. It is planned once, when it is described or executed, and read on where a row limit stopped it."""

    def __init__(self, prepared: Prepared):
        self.prepared, self.df, self.rows, self.planned = prepared, None, None, False

    def plan(self) -> DataFrame | None:
        if not self.planned:
            self.df, self.planned = self.prepared.execute(), True
        return self.df

    @property
    def returns_rows(self) -> bool:
        return self.prepared.tag in ("SELECT", "SHOW")


class Connection(socketserver.StreamRequestHandler):
    """One client."""

    # --- messages

    def _exactly(self, n: int) -> bytes:
        out = self.rfile.read(n)
        if len(out) < n:
            raise EOFError
        return out

    def _message(self) -> tuple[bytes, bytes]:
        kind, (size,) = self._exactly(1), struct.unpack("!i", self._exactly(4))
        if not 4 <= size <= LARGEST:
            raise EOFError
        return kind, self._exactly(size - 4)

    def _send(self, kind: bytes, body: bytes = b"") -> None:
        self.wfile.write(kind + struct.pack("!i", len(body) + 4) + body)

    def _error(self, e: Exception, severity: str = "ERROR") -> None:
        message = str(e).split("\n")[0] or type(e).__name__
        state = "0A000" if isinstance(e, UnsupportedStatement) else "42P01" if isinstance(e, LookupError) else "28P01" if isinstance(e, PermissionError) else "XX000"
        self._send(b"E", b"".join(k + v.encode() + b"\0" for k, v in ((b"S", severity), (b"V", severity), (b"C", state), (b"M", message))) + b"\0")

    def _ready(self) -> None:
        self._send(b"Z", b"I")
        self.wfile.flush()

    # --- login

    def _startup(self) -> bool:
        while True:
            (size,) = struct.unpack("!i", self._exactly(4))
            if not 8 <= size <= 10000:
                return False
            (code,) = struct.unpack("!i", self._exactly(4))
            body = self._exactly(size - 8)
            if code in (SSL_REQUEST, GSS_REQUEST):
                self.wfile.write(b"N")
                self.wfile.flush()
                continue
            if code != VERSION_3:
                if code != CANCEL_REQUEST:
                    self._error(ProtocolError("unsupported protocol version"), "FATAL")
                return False
            break
        parts = body.decode().split("\0")
        said, config = dict(zip(parts[::2], parts[1::2], strict=False)), self.server.config
        try:
            if said.get("user") != config.user:
                raise scram.AuthenticationFailed(f'role "{said.get("user", "")}" does not exist')
            if said.get("database", said.get("user")) != config.database:
                raise LookupError(f'database "{said.get("database", said.get("user"))}" does not exist')
            if config.password:
                self._prove()
        except (PermissionError, LookupError, ValueError) as e:
            self._error(e, "FATAL")
            return False
        self._send(b"R", struct.pack("!i", 0))
        for k, v in STARTUP.items():
            self._send(b"S", f"{k}\0{v}\0".encode())
        self._ready()
        return True

    def _prove(self) -> None:
        exchange = scram.Exchange(self.server.verifier)
        self._send(b"R", struct.pack("!i", 10) + b"SCRAM-SHA-256\0\0")
        self.wfile.flush()
        _, body = self._message()
        mechanism, rest = body.split(b"\0", 1)
        if mechanism != b"SCRAM-SHA-256":
            raise scram.AuthenticationFailed("unknown authentication mechanism")
        self._send(b"R", struct.pack("!i", 11) + exchange.first(rest[4:].decode()).encode())
        self.wfile.flush()
        self._send(b"R", struct.pack("!i", 12) + exchange.final(self._message()[1].decode()).encode())

    # --- results

    def _describe_rows(self, df: DataFrame) -> None:
        out = struct.pack("!h", len(df.schema))
        for f in df.schema:
            oid, size = type_of(f)
            out += f.name.encode() + b"\0" + struct.pack("!ihihih", 0, 0, oid, size, -1, 0)
        self._send(b"T", out)

    def _data_row(self, row: tuple) -> None:
        out = [struct.pack("!h", len(row))]
        for v in row:
            raw = None if v is None else v.encode()
            out.append(struct.pack("!i", -1) if raw is None else struct.pack("!i", len(raw)) + raw)
        self._send(b"D", b"".join(out))

    @staticmethod
    def _rows(df: DataFrame):
        """Rendered by position: names may repeat."""
        names = [f"c{i}" for i in range(len(df.columns))]
        fields = [T.StructField(n, f.dataType, True, f.metadata) for n, f in zip(names, df.schema, strict=True)]
        plain = df.toDF(*names)
        for f in fields:
            if f.metadata:
                plain = plain.withMetadata(f.name, f.metadata)
        return render(plain).toLocalIterator()

    def _complete(self, tag: str, n: int) -> None:
        self._send(b"C", (f"{tag} {n}" if tag == "SELECT" else tag).encode() + b"\0")

    # --- simple queries

    def _query(self, sql: str) -> None:
        any_statement = False
        try:
            for tag, df in self.server.engine.results(sql):
                any_statement, n = True, 0
                if df is not None:
                    self._describe_rows(df)
                    for row in self._rows(df):
                        self._data_row(row)
                        n += 1
                self._complete(tag, n)
            if not any_statement:
                self._send(b"I")
        except OSError:
            raise
        except Exception as e:  # noqa: BLE001 - whatever a statement raises is the client's to see
            log.info("query failed: %s", e)
            self._error(e)
        self._ready()

    # --- extended queries

    def _parse(self, body: bytes) -> None:
        name, sql, _ = body.split(b"\0", 2)
        self.prepared[name] = self.server.engine.prepare(sql.decode())
        self._send(b"1")

    def _bind(self, body: bytes) -> None:
        portal, name, rest = body.split(b"\0", 2)
        if name not in self.prepared:
            raise ProtocolError(f'prepared statement "{name.decode()}" does not exist')
        at = 0

        def number(form: str):
            nonlocal at
            (out,) = struct.unpack_from(form, rest, at)
            at += struct.calcsize(form)
            return out

        forms = [number("!h") for _ in range(number("!h"))]
        args = []
        for i in range(number("!h")):
            size = number("!i")
            raw = None if size < 0 else rest[at : at + size]
            at += max(size, 0)
            args.append(parameter(raw, forms[i] if len(forms) > 1 else forms[0] if forms else 0))
        if any(number("!h") for _ in range(number("!h"))):
            raise ProtocolError("binary results are not supported")
        self.portals[portal] = Portal(self.prepared[name].bind(*args))
        self._send(b"2")

    def _describe(self, body: bytes) -> None:
        kind, name = body[:1], body[1:-1]
        if kind == b"S":
            if name not in self.prepared:
                raise ProtocolError(f'prepared statement "{name.decode()}" does not exist')
            statement = self.prepared[name]
            n = statement.parameters
            self._send(b"t", struct.pack("!h", n) + struct.pack("!i", 0) * n)
            portal = Portal(statement)
            if n:  # its columns' types are known once it is bound
                self._send(b"n")
                return
        else:
            portal = self._portal(name)
        if portal.returns_rows:
            self._describe_rows(portal.plan())
        else:
            self._send(b"n")

    def _portal(self, name: bytes) -> Portal:
        if name not in self.portals:
            raise ProtocolError(f'portal "{name.decode()}" does not exist')
        return self.portals[name]

    def _execute(self, body: bytes) -> None:
        name, rest = body.split(b"\0", 1)
        (most,) = struct.unpack("!i", rest)
        portal = self._portal(name)
        df, n = portal.plan(), 0
        if not portal.prepared.tag:
            self._send(b"I")
            return
        if df is not None:
            portal.rows = portal.rows or iter(self._rows(df))
            for row in portal.rows:
                self._data_row(row)
                n += 1
                if n == most:
                    self._send(b"s")
                    return
        self._complete(portal.prepared.tag, n)

    def _close(self, body: bytes) -> None:
        (self.prepared if body[:1] == b"S" else self.portals).pop(body[1:-1], None)
        self._send(b"3")

    # --- the loop

    def handle(self) -> None:
        self.prepared: dict[bytes, Prepared] = {}
        self.portals: dict[bytes, Portal] = {}
        steps = {b"P": self._parse, b"B": self._bind, b"D": self._describe, b"E": self._execute, b"C": self._close}
        try:
            if not self._startup():
                self.wfile.flush()
                return
            skipping = False  # after an error, until Sync
            while True:
                kind, body = self._message()
                if kind == b"X":
                    return
                if kind == b"S":
                    skipping = False
                    self.portals.clear()
                    self._ready()
                elif kind == b"H":
                    self.wfile.flush()
                elif skipping:
                    continue
                elif kind == b"Q":
                    self._query(body[:-1].decode())
                elif kind in steps:
                    try:
                        steps[kind](body)
                    except OSError:
                        raise
                    except Exception as e:  # noqa: BLE001 - whatever a statement raises is the client's to see
                        log.info("message %s failed: %s", kind, e)
                        self._error(e)
                        skipping = True
                else:
                    self._error(ProtocolError(f"unknown message {kind!r}"), "FATAL")
                    self.wfile.flush()
                    return
        except (EOFError, ConnectionError):
            return


class Server(socketserver.ThreadingTCPServer):
    """serve_forever() answers clients; shutdown() ends it."""

    allow_reuse_address, daemon_threads = True, True

    def __init__(self, engine: Engine, config: ServerConfig):
        self.engine, self.config = engine, config
        self.verifier = scram.verifier(config.password) if config.password else ""
        engine.identity = (config.database, config.user, self.verifier)
        super().__init__((config.host, config.port), Connection)


Connection.wbufsize = 1 << 16


def main() -> None:
    from plinth.session import session

    config = ServerConfig.read()
    logging.basicConfig(level=config.log_level)
    spark = session()
    with Server(Engine(spark, config.warehouse or None, Catalog(config.catalog)), config) as server:
        server.serve_forever()


if __name__ == "__main__":
    main()
