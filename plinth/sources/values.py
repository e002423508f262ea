"""Column expressions from source text to typed values: one rule per source type, all JVM-side."""

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnsupportedType(ValueError):
    pass


@dataclass(frozen=True)
class SourceColumn:
    """A column of a source table: name, source type (`numeric(20,2)`, `_text`), and whether its type is user-defined."""

    name: str
    type: str
    nullable: bool = True
    user_defined: bool = False

    @property
    def stored_name(self) -> str:
        return self.name.replace(",", "_")


# Source types that are kept as text.
TEXT = set("varchar char text uuid line lseg box path polygon circle cidr inet macaddr macaddr8 ltree tsvector xml pg_snapshot bpchar point".split())
_SIMPLE = {"bool": T.BooleanType(), "bit": T.IntegerType(), "int2": T.IntegerType(), "int4": T.IntegerType(), "xid": T.LongType(), "float4": T.FloatType(), "float8": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampNTZType(), "bytea": T.BinaryType()}
_DECIMALS = {"int8": (38, 0), "xid8": (38, 6), "interval": (38, 6)}
#: Types whose Spark type alone doesn't tell what they are.
_LOGICAL = {"json": "json", "jsonb": "json", "interval": "interval", "time": "time", "timetz": "time"}


def _parts(type_: str) -> tuple[str, list[int]]:
    m = re.fullmatch(r"(\w+)(?:\(([\d, ]+)\))?", type_)
    if not m:
        raise UnsupportedType(type_)
    return m[1], [int(x) for x in (m[2] or "").split(",") if x.strip()]


def spark_type(column: SourceColumn) -> T.DataType:
    """The stored type: integers of 64 bits and numerics without a precision are decimals, times are text."""
    if column.type.startswith("_"):
        return T.ArrayType(spark_type(SourceColumn(column.name, column.type[1:], True, column.user_defined)))
    base, sizes = _parts(column.type)
    if column.user_defined or base in TEXT or base in ("json", "jsonb", "time", "timetz"):
        return T.StringType()
    if base in _SIMPLE:
        return _SIMPLE[base]
    if base in _DECIMALS:
        return T.DecimalType(*_DECIMALS[base])
    if base == "numeric":
        return T.DecimalType(min(sizes[0], 38), sizes[1] if len(sizes) > 1 else 0) if sizes else T.DecimalType(38, 6)
    raise UnsupportedType(column.type)


def field(column: SourceColumn) -> T.StructField:
    logical = _LOGICAL.get(_parts(column.type.lstrip("_"))[0])
    return T.StructField(column.stored_name, spark_type(column), column.nullable, {"logical_type": logical} if logical else {})


def interval_micros(text: Column) -> Column:
    """`1 mon 2 days 01:00:01.000001` in microseconds; a month is 30.4375 days, a year twelve months."""

    def part(unit: str) -> Column:
        return F.coalesce(F.regexp_extract(text, rf"(-?\d+) {unit}", 1).try_cast("decimal(20,0)"), F.lit(0))

    clock = r"([+-]?)(\d+):(\d\d):(\d\d)(?:\.(\d{1,6}))?"
    number = lambda i: F.coalesce(F.regexp_extract(text, clock, i).try_cast("long"), F.lit(0))
    micros = F.rpad(F.regexp_extract(text, clock, 5), 6, "0").try_cast("long")
    time = ((number(2) * 60 + number(3)) * 60 + number(4)) * 1_000_000 + micros
    signed = F.when(F.regexp_extract(text, clock, 1) == "-", -time).otherwise(time)
    return (part("year") * 12 + part("mon")) * F.lit(2_629_800_000_000) + part("day") * F.lit(86_400_000_000) + signed


def decimal(text: Column, precision: int, scale: int) -> Column:
    """Rounded to the scale; an integer part too long for the type is saturated with nines; NaN is 0."""
    most = "9" * (precision - scale) or "0"
    digits = F.length(F.regexp_extract(text, r"^[+-]?0*(\d*)", 1))
    value = text.try_cast(f"decimal({precision},{scale})")
    full = F.when(text.startswith("-"), F.lit(f"-{most}")).otherwise(F.lit(most)).cast(f"decimal({precision},{scale})")
    return F.when(F.lower(text) == "nan", F.lit(0).cast(f"decimal({precision},{scale})")).when(digits > precision - scale, full).otherwise(value)


def elements(text: Column) -> Column:
    """`{one,"t,wo",NULL}` as an array of strings; `{}` is empty."""
    found = F.regexp_extract_all(F.substring(text, 2, 1 << 30), F.lit(r'("(?:[^"\\]|\\.)*"|[^,{}"]+)'), 1)
    inner = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
    return F.transform(found, lambda x: F.when(x.startswith('"'), inner(x)).when(F.upper(x) != "NULL", x))


def _utc(text: Column) -> Column:
    """A time stamp's text, its zone applied if it has one, as a time stamp of UTC without zone."""
    zone = F.regexp_extract(text, r"([+-]\d\d(?::\d\d){0,2})$", 1)
    zoned = zone != ""
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    piece = lambda i: F.coalesce(F.get(F.split(F.substring(zone, 2, 10), ":"), F.lit(i)).try_cast("int"), F.lit(0))
    plain = F.when(zoned, F.substring(text, F.lit(1), F.length(text) - F.length(zone))).otherwise(text).try_cast("timestamp_ntz")
    shift = F.make_dt_interval(F.lit(0), sign * piece(0), sign * piece(1), (sign * piece(2)).cast("decimal(18,6)"))
    return F.when(zoned, plain - shift).otherwise(plain)


def typed(text: Column, column: SourceColumn) -> Column:
    """The typed value of a column's source text (null stays null)."""
    if column.type.startswith("_"):
        inner = SourceColumn(column.name, column.type[1:], True, column.user_defined)
        return F.when(text.isNotNull(), F.transform(elements(text), lambda x: typed(x, inner)))
    base = _parts(column.type)[0]
    out = spark_type(column)
    if column.user_defined:
        return text
    if base == "bool":
        return F.when(text.isNotNull(), text.isin("t", "true", "1"))
    if base in ("float4", "float8"):
        value = text.try_cast(out)
        return F.when(F.isnan(value), F.lit(0).cast(out)).otherwise(value)
    if base == "interval":
        return interval_micros(text).cast(out)
    if base in ("timestamp", "timestamptz"):
        return _utc(text)
    if base in ("time", "timetz"):
        clock = F.date_format(_utc(F.concat(F.lit("1970-01-02 "), text)), "HH:mm:ss.SSSSSS")
        return F.regexp_replace(clock, r"(\.\d*?)0+$", "$1") if base == "timetz" else text
    if base == "date":
        # years beyond four digits need a sign
        return F.when(text.rlike(r"^\d{5,}-"), F.concat(F.lit("+"), text)).otherwise(text).cast("date")
    if base == "bytea":
        return F.encode(text, "UTF-8")
    if isinstance(out, T.DecimalType):
        return decimal(text, out.precision, out.scale)
    return text if isinstance(out, T.StringType) else text.cast(out)
