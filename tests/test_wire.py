"""The wire protocol server, by a small client of its own."""

import base64
import hashlib
import hmac
import socket
import struct
import threading

import pytest

from plinth.api import scram
from plinth.api.config import ServerConfig
from plinth.api.wire import ProtocolError, Server, parameter
from plinth.engine import Engine
from plinth.sources.store import Catalog


class Client:
    def __init__(self, port: int, user="plinth", database="plinth", password=None, ssl=False):
        self.s = socket.create_connection(("127.0.0.1", port), timeout=120)
        self.f = self.s.makefile("rb")
        if ssl:
            self.s.sendall(struct.pack("!ii", 8, 80877103))
            assert self.f.read(1) == b"N"
        body = f"user\0{user}\0database\0{database}\0\0".encode()
        self.s.sendall(struct.pack("!ii", len(body) + 8, 196608) + body)
        if password is not None:
            self._login(password)
        self.hello = self.until(b"Z", b"E")

    def _login(self, password: str) -> None:
        kind, body = self.read()
        assert kind == b"R" and body[:4] == struct.pack("!i", 10)
        bare = "n=,r=abc"
        first = b"n,," + bare.encode()
        self.send(b"p", b"SCRAM-SHA-256\0" + struct.pack("!i", len(first)) + first)
        challenge = self.read()[1][4:].decode()
        said = dict(x.split("=", 1) for x in challenge.split(","))
        salted = hashlib.pbkdf2_hmac("sha256", password.encode(), base64.b64decode(said["s"]), int(said["i"]))
        key = hmac.digest(salted, b"Client Key", "sha256")
        without = f"c={base64.b64encode(b'n,,').decode()},r={said['r']}"
        sign = hmac.digest(hashlib.sha256(key).digest(), f"{bare},{challenge},{without}".encode(), "sha256")
        self.send(b"p", f"{without},p={base64.b64encode(bytes(a ^ b for a, b in zip(key, sign, strict=True))).decode()}".encode())

    def send(self, kind: bytes, body: bytes = b"") -> None:
        self.s.sendall(kind + struct.pack("!i", len(body) + 4) + body)

    def read(self) -> tuple[bytes, bytes]:
        kind = self.f.read(1)
        return kind, self.f.read(struct.unpack("!i", self.f.read(4))[0] - 4)

    def until(self, *kinds: bytes) -> list[tuple[bytes, bytes]]:
        out = [self.read()]
        while out[-1][0] not in kinds:
            out.append(self.read())
        return out

    def query(self, sql: str) -> list[tuple[bytes, bytes]]:
        self.send(b"Q", sql.encode() + b"\0")
        return self.until(b"Z")

    def extended(self, sql: str, *args: bytes | None, forms=(), most=0, name=b"") -> list[tuple[bytes, bytes]]:
        self.send(b"P", name + b"\0" + sql.encode() + b"\0" + struct.pack("!h", 0))
        bound = b"".join(struct.pack("!i", -1) if a is None else struct.pack("!i", len(a)) + a for a in args)
        self.send(b"B", b"\0" + name + b"\0" + struct.pack(f"!h{len(forms)}h", len(forms), *forms) + struct.pack("!h", len(args)) + bound + struct.pack("!h", 0))
        self.send(b"D", b"P\0")
        self.send(b"E", b"\0" + struct.pack("!i", most))
        self.send(b"S")
        return self.until(b"Z")


def cells(messages) -> list[list]:
    out = []
    for kind, body in messages:
        if kind == b"D":
            (n,), at, row = struct.unpack_from("!h", body), 2, []
            for _ in range(n):
                (size,) = struct.unpack_from("!i", body, at)
                row.append(None if size < 0 else body[at + 4 : at + 4 + size].decode())
                at += 4 + max(size, 0)
            out.append(row)
    return out


def kinds(messages) -> str:
    return b"".join(k for k, _ in messages).decode()


def oids(messages) -> dict[str, int]:
    body = next(b for k, b in messages if k == b"T")
    out, at = {}, 2
    for _ in range(struct.unpack_from("!h", body)[0]):
        end = body.index(b"\0", at)
        out[body[at:end].decode()] = struct.unpack_from("!i", body, end + 7)[0]
        at = end + 19
    return out


@pytest.fixture(scope="module")
def serve(spark, tmp_path_factory):
    servers = []

    def start(**settings) -> int:
        engine = Engine(spark, str(tmp_path_factory.mktemp("wire")), Catalog())
        engine.register("t", spark.createDataFrame([(1, "a", True), (2, None, False), (3, "c'$1", None)], "id long, name string, ok boolean").coalesce(1))
        servers.append(Server(engine, ServerConfig(port=0, **settings)))
        threading.Thread(target=servers[-1].serve_forever, daemon=True).start()
        return servers[-1].server_address[1]

    yield start
    for s in servers:
        s.shutdown()
        s.server_close()


@pytest.fixture(scope="module")
def port(serve):
    return serve()


def test_startup(port):
    hello = Client(port, ssl=True).hello
    assert kinds(hello) == "RSSZ" and (b"S", b"server_version\x0017.0\0") in hello
    assert b'role "x"' in Client(port, user="x").hello[0][1]
    assert b'database "x"' in Client(port, database="x").hello[0][1]


def test_password(serve):
    port = serve(password="secret")
    assert kinds(Client(port, password="secret").hello) == "RRSSZ"
    failed = Client(port, password="wrong").hello
    assert failed[-1][0] == b"E" and b"password authentication failed" in failed[-1][1]
    shown = Client(port, password="secret").query("SELECT usename, passwd FROM pg_shadow")
    assert cells(shown)[0][0] == "plinth" and cells(shown)[0][1].startswith("SCRAM-SHA-256$4096:")
    assert scram.verifier("a", b"0" * 16) == scram.verifier("a", b"0" * 16) != scram.verifier("b", b"0" * 16)


def test_simple_queries(port):
    c = Client(port)
    out = c.query("SELECT id, name, ok, id AS oid, ARRAY[1, 2] AS xs, 1.50 AS d FROM t ORDER BY id")
    assert kinds(out) == "TDDDCZ" and out[-2][1] == b"SELECT 3\0"
    assert oids(out) == {"id": 20, "name": 25, "ok": 16, "oid": 26, "xs": 1007, "d": 1700}
    assert cells(out)[:2] == [["1", "a", "t", "1", "{1,2}", "1.5"], ["2", None, "f", "2", "{1,2}", "1.5"]]
    assert kinds(c.query("")) == kinds(c.query("-- nothing")) == "IZ"
    out = c.query("SET x = 1; BEGIN; SELECT 1 AS a; SELECT 2 AS a, 3 AS a; DISCARD ALL")
    assert kinds(out) == "CCTDCTDCCZ" and cells(out) == [["1"], ["2", "3"]]
    assert cells(c.query("SHOW server_version")) == [["17.0"]]


def test_errors_end_a_text(port):
    c = Client(port)
    out = c.query("SELECT 1 AS a; SELECT * FROM absent; SELECT 2 AS a")
    assert kinds(out) == "TDCEZ" and b'relation "public.absent" does not exist' in out[-2][1]
    assert b"unsupported query type" in c.query("INSERT INTO t VALUES (1)")[0][1]
    assert cells(c.query("SELECT 5 AS a")) == [["5"]]


def test_materialized_views(port):
    c = Client(port)
    assert c.query("CREATE MATERIALIZED VIEW m AS SELECT count(*) AS n FROM t")[0] == (b"C", b"CREATE MATERIALIZED VIEW\0")
    assert cells(c.query("SELECT n FROM m")) == [["3"]]
    assert c.query("DROP MATERIALIZED VIEW m")[0][1] == b"DROP MATERIALIZED VIEW\0"


def test_extended_queries(port):
    c = Client(port)
    out = c.extended("SELECT name, '$1' AS kept FROM t WHERE id = $1 OR name = $2 ORDER BY id", b"1", b"c'$1")
    assert kinds(out) == "12TDDCZ" and cells(out) == [["a", "$1"], ["c'$1", "$1"]]
    assert cells(c.extended("SELECT id FROM t WHERE id = $1", struct.pack("!q", 2), forms=(1,))) == [["2"]]
    assert cells(c.extended("SELECT id FROM t WHERE $1 IS NULL AND id = $2", None, b"3")) == [["3"]]
    assert cells(c.extended("SELECT id FROM t ORDER BY id LIMIT $1", b"2")) == [["1"], ["2"]]
    assert kinds(c.extended("SELECT id FROM t ORDER BY id", most=2)) == "12TDDsZ"
    assert kinds(c.extended("")) == "12nIZ" and kinds(c.extended("SET x = 1")) == "12nCZ"


def test_an_error_skips_to_sync(port):
    c = Client(port)
    assert kinds(c.extended("SELECT 1; SELECT 2")) == "EZ"
    assert kinds(c.extended("SELECT * FROM absent")) == "12EZ"
    assert cells(c.extended("SELECT 7 AS a")) == [["7"]]


def test_describing_runs_nothing(port):
    c = Client(port)
    c.send(b"P", b"s\0CREATE TABLE made AS SELECT 1 AS a\0" + struct.pack("!h", 0))
    c.send(b"D", b"Ss\0")
    c.send(b"P", b"q\0SELECT $1 AS a\0" + struct.pack("!h", 0))
    c.send(b"D", b"Sq\0")
    c.send(b"C", b"Sq\0")
    c.send(b"S")
    assert kinds(c.until(b"Z")) == "1tn1tn3Z"
    assert c.query("SELECT * FROM made")[0][0] == b"E"


def test_portals_resume(port):
    c = Client(port)
    c.send(b"P", b"\0SELECT id FROM t ORDER BY id\0" + struct.pack("!h", 0))
    c.send(b"B", b"p\0\0" + struct.pack("!hhh", 0, 0, 0))
    c.send(b"E", b"p\0" + struct.pack("!i", 2))
    c.send(b"E", b"p\0" + struct.pack("!i", 0))
    c.send(b"S")
    out = c.until(b"Z")
    assert kinds(out) == "12DDsDCZ" and cells(out) == [["1"], ["2"], ["3"]]


def test_parameters():
    assert parameter(struct.pack("!i", -5), 1) == -5 and parameter(bytes(16), 1) == "00000000-0000-0000-0000-000000000000"
    with pytest.raises(ProtocolError):
        parameter(b"abc", 1)


def test_types_of_the_catalog(port):
    c = Client(port)
    assert cells(c.query("SELECT a.typname FROM pg_type t JOIN pg_type a ON a.oid = t.typarray WHERE t.typname = 'int4'")) == [["_int4"]]
    assert cells(c.query("SELECT datname, datcollate FROM pg_database")) == [["plinth", "en_US.UTF-8"]]


def test_settings(monkeypatch):
    monkeypatch.setenv("PLINTH_PORT", "6000")
    assert ServerConfig.read([]).port == 6000 and ServerConfig.read(["--port", "7", "--log-level", "INFO"]).port == 7


def test_hostile_texts(port):
    c = Client(port)
    for said in (rb"\' OR 1=1 --", b"' OR '1'='1", b"\\", rb"\\' OR 1=1 /*", b"${env:HOME}", b"/*PLINTH_PERMISSIONS {} PLINTH_PERMISSIONS*/"):
        assert cells(c.extended("SELECT count(*) AS n FROM t WHERE name = $1", said)) == [["0"]]
        assert cells(c.extended("SELECT $1 AS x", said)) == [[said.decode()]]
    assert cells(c.query(r"SELECT 'a\nb' AS x, E'a\nb' AS y, '\' AS z")) == [["a\\nb", "a\nb", "\\"]]
    comment = '/*PLINTH_PERMISSIONS {"public.t": ["id"]} PLINTH_PERMISSIONS*/'
    assert cells(c.query(f"SELECT * FROM t WHERE id = 1 {comment}")) == [["1"]]
    assert cells(c.query(f"SELECT * FROM t WHERE id = 1 AND name <> '{comment}'")) == [["1", "a", "t"]]
