"""The engine: Postgres-flavoured SQL over Spark tables."""

import json
import logging
import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import dialect, theta
from plinth.functions.tokens import Token, UnsupportedSyntax, close, comments, statements, text, tokens
from plinth.operators import theta as ordered
from plinth.plans import syscat
from plinth.sources.store import Catalog, Store

_PERMISSIONS = re.compile(r"/\*PLINTH_PERMISSIONS (.*) PLINTH_PERMISSIONS\*/", re.S)
_LOG = logging.getLogger("plinth")
#: Settings that clients set and that change nothing here.
KNOWN = frozenset("client_encoding client_min_messages standard_conforming_strings intervalstyle extra_float_digits application_name datestyle session timezone time".split())
#: Settings that SHOW answers; SET of others is a no-op.
SETTINGS = {"search_path": '"$user", public', "timezone": "UTC", "server_version": "17.0", "client_encoding": "UTF8", "transaction_isolation": "read committed", "standard_conforming_strings": "on", "max_identifier_length": "63", "default_null_order": "nulls_last"}


class UnsupportedStatement(ValueError):
    pass


def narrowed(permissions: dict | None, sql: str) -> dict | None:
    """The permissions of a caller as a text's comments narrow them: a column must be in each. Comments never widen them."""
    for found in map(_PERMISSIONS.fullmatch, comments(sql)):
        if found:
            asked = json.loads(found[1])
            permissions = asked if permissions is None else {t: [c for c in columns if c in asked[t]] for t, columns in permissions.items() if t in asked}
    return permissions


def _interval_text(value: Column) -> Column:
    part = lambda unit: F.extract(F.lit(unit), value)
    micros = ((part("HOUR") * 60 + part("MINUTE")) * 60 + part("SECOND")) * 1_000_000
    return F.when(value.isNotNull(), F.format_string("%d months %d days %d microseconds", part("YEAR") * 12 + part("MONTH"), part("DAY"), micros.cast("long")))


def _json_pretty(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), indent=4, ensure_ascii=False))


def command_tag(ts: list[Token]) -> str:
    """What a client is told that a statement was: SELECT for all queries."""
    words = [t.word for t in ts[:2]]
    if words[0] in ("select", "with", "values", "("):
        return "SELECT"
    if words[0] in ("create", "drop", "refresh", "alter"):
        return f"{words[0]} materialized view".upper() if "materialized" in words else f"{words[0]} {words[-1]}".upper()
    return {"start": "BEGIN", "discard": "DISCARD ALL"}.get(words[0], words[0].upper())


@dataclass
class Prepared:
    engine: "Engine"
    sql: str
    args: list = field(default_factory=list)
    permissions: dict | None = None

    def bind(self, *args) -> "Prepared":
        return Prepared(self.engine, self.sql, list(args), self.permissions)

    def _tokens(self) -> list[Token]:
        """The statement with each $n replaced by its argument, where it is a token of its own; unbound ones are NULL."""
        (ts,) = statements(self.sql) or [[]]
        out = []
        for i, t in enumerate(ts):
            if t.kind != "param":
                out.append(t)
                continue
            n = int(t.text[1:])
            v = self.args[n - 1] if 0 < n <= len(self.args) else None
            if v is None:
                out.append(Token("name", "NULL"))
            elif isinstance(v, int | float) and not isinstance(v, bool):
                out += tokens(str(v)) if v == v and abs(v) != float("inf") else [Token("string", f"'{v}'"), Token("op", "::"), Token("name", "double")]
            elif i and ts[i - 1].word in ("limit", "offset") and str(v).isdecimal():  # clients send numbers as text
                out.append(Token("number", str(v)))
            else:
                out.append(Token("string", "'" + str(v).replace("'", "''") + "'"))
        return out

    @property
    def parameters(self) -> int:
        """The highest n of its $n."""
        return max((int(t.text[1:]) for ts in statements(self.sql) for t in ts if t.kind == "param"), default=0)

    @property
    def tag(self) -> str:
        return next((command_tag(ts) for ts in statements(self.sql)), "")

    def describe(self) -> list[tuple[str, str]]:
        """Column names and types; nothing runs. Statements without a result have none."""
        return self.execute().dtypes if self.tag in ("SELECT", "SHOW") else []

    def execute(self) -> DataFrame:
        """The result; None for an empty text and statements without one."""
        ts = self._tokens()
        with self.engine.lock:
            return self.engine._statement(ts, narrowed(self.permissions, self.sql)) if ts else None


class Engine:
    """Temp views and stored tables under one name space; default schema public."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None, catalog: Catalog | None = None):
        self.spark, self.views = spark, {}
        self.store = Store(spark, warehouse, catalog or Catalog()) if warehouse else None
        self.settings = dict(SETTINGS)
        self.identity = ("plinth", "plinth", "")  # database, user and password verifier that the system catalog shows
        spark.conf.set("spark.sql.variable.substitute", "false")  # ${...} in a text is text
        self.lock = threading.RLock()  # statements are planned one at a time; results are read outside it

    def register(self, name: str, df: DataFrame, schema: str = "public") -> None:
        self.views[schema, name] = df

    # --- names

    def _table(self, schema: str, name: str, permissions: dict | None) -> DataFrame:
        system = syscat.table(self, schema, name, permissions)
        if system is not None:
            return system
        schema = schema or "public"
        df = self.views.get((schema, name))
        if df is None and self.store and self.store.exists(schema, name):
            df = self.store.read(schema, name)
        if df is None:
            raise LookupError(f'relation "{schema}.{name}" does not exist')
        if permissions is not None:
            allowed = permissions.get(f"{schema}.{name}")
            if allowed is None:
                return df.filter("false").select(F.lit(None).alias("?column?"))
            df = df.select(*[c for c in df.columns if c in allowed])
        return df

    def _resolve(self, ts: list[Token], permissions: dict | None, made: list[str]) -> list[Token]:
        """Table references become temp views, whose names go to `made`; aliases stay, CTEs shadow tables."""
        ctes, i, from_depth, aliases = set(), 0, {}, {}
        for i in range(len(ts) - 2):
            if ts[i + 1].word == "as" and ts[i + 2].text == "(" and ts[i].kind in ("name", "quoted") and (ts[i - 1].word in ("with", "recursive") or ts[i - 1].text == ","):
                ctes.add(ts[i].word)
            if i and ts[i].kind == "name" and ts[i + 1].text == "(" and ts[i - 1].word in ("with", "recursive"):
                ctes.add(ts[i].word)
        out, i, expect, depth, frames = [], 0, False, 0, []
        while i < len(ts):
            t = ts[i]
            if t.text == "(" and t.kind == "punct":
                frames.append(expect)
                expect = expect and i + 1 < len(ts) and ts[i + 1].word not in ("select", "with", "values")
                depth += 1
            elif t.text == ")" and t.kind == "punct":
                frames.pop()
                expect = False
                depth -= 1
                from_depth.pop(depth + 1, None)
            elif t.word in ("from", "join") and not (t.word == "from" and (self._in_call(ts, i) or i >= 2 and ts[i - 1].word == "distinct" and ts[i - 2].word == "is")):
                expect = True
                from_depth[depth] = True
                out.append(t)
                i += 1
                continue
            elif t.word in ("where", "group", "having", "order", "limit", "union", "intersect", "except", "select", "window", "offset"):
                from_depth.pop(depth, None)
                expect = False
            elif t.word in ("on", "using"):
                expect = False
            elif t.text == "," and from_depth.get(depth):
                out.append(t)
                expect = True
                i += 1
                continue
            elif expect and t.kind in ("name", "quoted") and t.word not in ("lateral", "only", "unnest"):
                parts = [t]
                j = i + 1
                while j + 1 < len(ts) and ts[j].text == ".":
                    parts.append(ts[j + 1])
                    j += 2
                if j < len(ts) and ts[j].text == "(":
                    expect = False
                    out += ts[i : close(ts, j) + 1]
                    i = close(ts, j) + 1
                    continue
                names = [p.text[1:-1] if p.kind == "quoted" else p.word for p in parts][-2:]
                schema, name = ("", names[0]) if len(names) == 1 else names
                if schema or name not in ctes:
                    made.append(view := f"plinth_{uuid.uuid4().hex}")
                    self._table(schema, name, permissions).createOrReplaceTempView(view)
                    alias = name if schema in ("", "public", "pg_catalog", "information_schema") else f"{schema}_{name}"
                    out.append(Token("name", view))
                    nxt = ts[j] if j < len(ts) else None
                    if nxt is None or not (nxt.word == "as" or nxt.kind in ("name", "quoted") and nxt.word not in dialect._END and nxt.word not in ("join", "tablesample")):
                        out += [Token("name", "AS"), Token("quoted", f'"{alias}"')]
                        aliases[schema or "public", name] = alias
                else:
                    out += parts
                i, expect = j, False
                continue
            elif t.word != "lateral":
                expect = False
            out.append(t)
            i += 1
        return self._columns(out, aliases)

    def _ordered(self, ts: list[Token], made: list[str]) -> list[Token]:
        """A table's joins with itself by equality and order get an equality more, by which only rows in order meet (theta.noded); the condition stays.

        Joins of two tables mostly go by a key of one of them and are left as they are.
        """
        columns = {view: self.spark.table(view).columns for view in made} if theta.TURNED.keys() & {t.text for t in ts} else {}
        for join in reversed(theta.joins(ts, columns)):  # from the end, so that places stay
            shown = tuple(columns[ts[v].text] for v in join.views)
            items = theta.starless(ts, join, shown)
            a, b = (self.spark.table(ts[v].text) for v in join.views)
            if items is None or not a.sameSemantics(b) or any(len({c.lower() for c in x}) < len(x) for x in shown):
                continue
            terms = [(f"plinth_e{i}", *x) for i, x in enumerate(join.keys)] + [(f"plinth_v{i}", a, b) for i, (a, _, b) in enumerate(join.tests)]
            sides = []
            for n, (at, name) in enumerate(zip(join.views, join.names, strict=True)):
                added = [x for term in terms for x in (Token("punct", ","), *term[1 + n], Token("name", "AS"), Token("name", term[0]))]
                query = [*tokens("SELECT *"), *added, *tokens("FROM"), ts[at], Token("name", "AS"), Token("quoted", f'"{name}"')]
                try:
                    sides.append(self.spark.sql(dialect.rewrite(query, settings=self.settings)))
                except AnalysisException:  # the query itself will tell
                    break
            if len(sides) < 2:
                continue
            kinds = {term[0]: ordered.common(*(x.schema[term[0]].dataType for x in sides)) for term in terms}
            keys, values = ([n for n, kind in kinds.items() if kind and n.startswith(p)] for p in ("plinth_e", "plinth_v"))
            if not keys or not values:
                continue
            sides = [x.select(*(f"`{c}`" for c in shown[n]), *(F.col(c).cast(kinds[c]).alias(c) for c in keys + values)) for n, x in enumerate(sides)]
            tests = [op for i, (_, op, _) in enumerate(join.tests) if f"plinth_v{i}" in values]
            views = []
            for df in ordered.noded(*sides, keys, values, tests):
                made.append(view := f"plinth_{uuid.uuid4().hex}")
                df.createOrReplaceTempView(view)
                views.append(view)
            a, b = join.names
            same = [Token("punct", ")"), Token("name", "AND"), *(x for name, column, end in ((a, ordered.LEFT, [Token("op", "=")]), (b, ordered.RIGHT, [])) for x in (Token("quoted", f'"{name}"'), Token("punct", "."), Token("name", column), *end))]
            between = ts[join.views[0] + 1 : join.views[1]]
            ts = [*ts[: join.select], *items, ts[join.views[0] - 1], Token("name", views[0]), *between, Token("name", views[1]), *ts[join.views[1] + 1 : join.start], Token("punct", "("), *ts[join.start : join.end], *same, *ts[join.end :]]
        return ts

    @staticmethod
    def _columns(ts: list[Token], aliases: dict) -> list[Token]:
        """schema.table.column, and table.column of a table with a schema, by the table's alias."""
        short = {name: alias for (_, name), alias in aliases.items() if alias != name}
        plain = lambda t: t.text[1:-1] if t.kind == "quoted" else t.word
        out, i = [], 0
        while i < len(ts):
            five = ts[i : i + 5]
            named = len(five) == 5 and five[1].text == five[3].text == "." and all(t.kind in ("name", "quoted") for t in five[::2])
            if named and (not out or out[-1].text != ".") and (alias := aliases.get((plain(five[0]), plain(five[2])))):
                out.append(Token("quoted", f'"{alias}"'))
                i += 3
            elif len(five) > 2 and five[1].text == "." and five[0].kind in ("name", "quoted") and plain(five[0]) in short and (not out or out[-1].text != "."):
                out.append(Token("quoted", f'"{short[plain(five[0])]}"'))
                i += 1
            else:
                out.append(ts[i])
                i += 1
        return out

    @staticmethod
    def _in_call(ts: list[Token], at: int) -> bool:
        """Whether this FROM belongs to extract(), substring() or trim()."""
        depth = 0
        for i in range(at - 1, -1, -1):
            if ts[i].kind == "punct":
                depth += (ts[i].text == ")") - (ts[i].text == "(")
            if depth < 0:
                return i > 0 and ts[i - 1].word in ("extract", "substring", "trim", "overlay", "position")
            if not depth and ts[i].word == "select":
                return False
        return False

    # --- statements

    def sql(self, sql: str, permissions: dict | None = None) -> DataFrame | None:
        """The last statement's result; None for empty texts and statements without one. The first error ends a text."""
        out, permissions = None, narrowed(permissions, sql)
        for ts in statements(sql):
            out = self._statement(ts, permissions)
            self._inspect(sql, out)
        return out

    @staticmethod
    def _inspect(sql: str, df: DataFrame | None) -> None:
        """A text that ends in --INSPECT has its plans logged."""
        if df is not None and sql.rstrip().endswith("--INSPECT"):
            _LOG.warning("%s", df._jdf.queryExecution().toString())

    def results(self, sql: str, permissions: dict | None = None) -> Iterator[tuple[str, DataFrame | None]]:
        """Each statement's command tag and result; one is run when the next is asked for."""
        permissions = narrowed(permissions, sql)
        for ts in statements(sql):
            with self.lock:
                out = self._statement(ts, permissions)
                self._inspect(sql, out)
            yield command_tag(ts), out

    def query(self, ts: list[Token], permissions: dict | None) -> DataFrame:
        """A query's analysed plan, after which its temp views are needed no more."""
        made: list[str] = []
        try:
            query = self.query_text(ts, permissions, made)
            if "plinth_json_pretty(" in query:
                self.spark.udf.register("plinth_json_pretty", F.pandas_udf(_json_pretty, "string"))
            return self.spark.sql(query)
        finally:
            for view in made:
                self.spark.catalog.dropTempView(view)

    def query_text(self, ts: list[Token], permissions: dict | None, made: list[str]) -> str:
        ts = self._ordered(self._resolve(ts, permissions, made), made)
        return dialect.rewrite(ts, lambda kind, parts: self._oid(kind, parts, permissions), self.settings, self.identity[1])

    def _oid(self, kind: str, parts: list[str], permissions: dict | None) -> int | None:
        """The oid of a relation or schema that is there, for casts to regclass and regnamespace."""
        if kind == "regnamespace":
            return syscat.oid(parts[-1])
        schema, name = parts[-2:] if len(parts) > 1 else ("", parts[-1])
        if syscat.known(schema, name):
            return syscat.oid("pg_catalog" if schema == "" else schema, name)
        schema = schema or "public"
        there = (schema, name) in self.views or self.store and self.store.exists(schema, name)
        return syscat.oid(schema, name) if there and (permissions is None or f"{schema}.{name}" in permissions) else None

    def prepare(self, sql: str, permissions: dict | None = None) -> Prepared:
        if len(statements(sql)) > 1:
            raise UnsupportedStatement("cannot prepare more than one statement")
        return Prepared(self, sql, permissions=permissions)

    def _name(self, ts: list[Token]) -> tuple[str, str]:
        parts = [t.text[1:-1] if t.kind == "quoted" else t.word for t in ts if t.text != "."]
        return ("public", parts[0]) if len(parts) == 1 else (parts[-2], parts[-1])

    def _statement(self, ts: list[Token], permissions: dict | None) -> DataFrame | None:
        words = [t.word for t in ts[:6]]
        head = words[0]
        if head in ("select", "with", "values") or ts[0].text == "(":
            out = self.query(ts, permissions)
            intervals = [n for n, kind in out.dtypes if kind == "interval"]  # clients can't hold them
            return out.withColumns({n: _interval_text(F.col(f"`{n}`")) for n in intervals}) if intervals else out
        if head == "set":
            if len(words) > 2 and words[1] in ("timezone", "time"):
                self.settings["timezone"] = ts[-1].text.strip("'\"")
                self.spark.conf.set("spark.sql.session.timeZone", self.settings["timezone"])
            elif len(words) > 1 and words[1] not in KNOWN:
                _LOG.warning("SET of an unknown setting: %s", words[1])
            return None
        if head in ("begin", "commit", "rollback", "start", "discard"):
            return None
        if head == "show":
            name = words[-1]
            return self.spark.createDataFrame([(self.settings.get(name, ""),)], f"`{name}` string")
        if head == "create" and (words[1:3] == ["materialized", "view"] or words[1] == "table"):
            return self._create(ts, permissions)
        if head == "refresh":
            at = 4 if words[3] == "concurrently" else 3
            name = self._name(ts[at:])
            if at == 4:
                threading.Thread(target=self._refresh_later, args=name, daemon=True).start()
            else:
                self.refresh(*name)
            return None
        if head == "drop" and words[1] in ("materialized", "table"):
            at = 3 if words[1] == "materialized" else 2
            optional = words[at : at + 2] == ["if", "exists"]
            schema, name = self._name(ts[at + 2 * optional :])
            if self.store.exists(schema, name) or self._is_view(schema, name):
                self.store.drop(schema, name)
            elif not optional:
                raise LookupError(f'relation "{schema}.{name}" does not exist')
            return None
        if head == "alter" and "rename" in [t.word for t in ts]:
            at = 3 if words[1] == "materialized" else 2
            optional = words[at : at + 2] == ["if", "exists"]
            cut = next(i for i, t in enumerate(ts) if t.word == "rename")
            schema, name = self._name(ts[at + 2 * optional : cut])
            if self.store.exists(schema, name) or self._is_view(schema, name):
                self.store.rename(schema, name, self._name(ts[cut + 2 :])[1])
            elif not optional:
                raise LookupError(f'relation "{schema}.{name}" does not exist')
            return None
        raise UnsupportedStatement(f"unsupported query type: {text(ts[:3])}")

    def _create(self, ts: list[Token], permissions: dict | None) -> None:
        words = [t.word for t in ts]
        at = 3 if words[1] == "materialized" else 2
        optional = words[at : at + 3] == ["if", "not", "exists"]
        at += 3 * optional
        cut = words.index("as", at) if "as" in words[at:] else None
        if cut is None:
            raise UnsupportedStatement("unsupported query type: create table")
        schema, name = self._name(ts[at:cut])
        no_data = words[-3:] == ["with", "no", "data"]
        body = ts[cut + 1 : len(ts) - 3 * no_data]
        if self._is_view(schema, name) or self.store.exists(schema, name):
            if optional:
                return
            raise ValueError(f'relation "{schema}.{name}" already exists')
        self.query(body, permissions)  # fails before anything is stored
        self.store.catalog.transaction(("INSERT INTO matviews VALUES (?, ?, ?, ?)", (schema, name, text(body), None if permissions is None else json.dumps(permissions))))
        if not no_data:
            try:
                self.refresh(schema, name)
            except BaseException:
                self.store.drop(schema, name)
                raise

    def _is_view(self, schema: str, name: str) -> bool:
        return bool(self.store.catalog.all("SELECT 1 FROM matviews WHERE schema = ? AND name = ?", schema, name))

    def refresh(self, schema: str, name: str) -> None:
        """Runs a materialized view's definition again, under the permissions of who made it, and swaps the result in."""
        rows = self.store.catalog.all("SELECT definition, permissions FROM matviews WHERE schema = ? AND name = ?", schema, name)
        if not rows:
            raise LookupError(f'materialized view "{schema}.{name}" does not exist')
        with self.lock:
            (ts,) = statements(rows[0][0])
            df = self.query(ts, json.loads(rows[0][1]) if rows[0][1] else None)
        self.store.replace(schema, name, df)

    def _refresh_later(self, schema: str, name: str) -> None:
        try:
            self.refresh(schema, name)
        except Exception:
            _LOG.exception("concurrent refresh of %s.%s failed", schema, name)


__all__ = ["Engine", "Prepared", "UnsupportedStatement", "UnsupportedSyntax"]
