"""Results as text in the form that clients of the wire protocol get: one projection, no UDF."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def float_text(value: Column) -> Column:
    """Shortest digits; an exponent of two digits at least, where it is below -4 or above 5."""
    s = F.upper(value.cast("string"))
    shift = F.coalesce(F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.regexp_extract(s, r"^-?(\d+)", 1), F.regexp_extract(s, r"\.(\d+)", 1)
    raw = F.concat(whole, part)
    lead = F.length(raw) - F.length(F.regexp_replace(raw, "^0+", ""))
    digits = F.regexp_replace(F.regexp_replace(raw, "^0+", ""), "0+$", "")
    exponent = F.length(whole) + shift - lead - 1
    size = F.length(digits)
    point = F.concat(F.substring(digits, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(""))
    scientific = F.concat(point, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    large = F.when(size <= exponent + 1, F.rpad(digits, exponent + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(400))))
    body = F.when(size == 0, "0").when((exponent < -4) | (exponent > 5), scientific).when(exponent < 0, small).otherwise(large)
    out = F.concat(F.when(s.startswith("-"), "-").otherwise(""), body)
    return F.when(value.isNull(), None).when(s.startswith("NAN"), "NaN").when(s == "INFINITY", "+Inf").when(s == "-INFINITY", "-Inf").otherwise(out)


def _trimmed(text: Column) -> Column:
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def text_of(value: Column, kind: T.DataType, logical: str | None = None, exact: bool = True) -> Column:
    """The text of a column; null stays null. exact=False sends decimals through doubles, as clients of old saw them."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "t").when(~value, "f")
    if isinstance(kind, T.FloatType | T.DoubleType):
        return float_text(value)
    if isinstance(kind, T.DecimalType):
        return _trimmed(value.cast("string")) if exact else float_text(value.cast("double"))
    if isinstance(kind, T.DateType):
        return F.regexp_replace(value.cast("string"), r"^\+", "")
    if isinstance(kind, T.TimestampNTZType):
        return F.regexp_replace(value.cast("string"), r"^\+", "")
    if isinstance(kind, T.TimestampType):
        return F.concat(F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz")).cast("string"), F.lit("+00:00"))
    if isinstance(kind, T.YearMonthIntervalType):
        return F.format_string("%d months 0 days 0 microseconds", F.extract(F.lit("YEAR"), value) * 12 + F.extract(F.lit("MONTH"), value))
    if isinstance(kind, T.ArrayType):
        item = kind.elementType
        texts = F.transform(value, lambda x: F.coalesce(x.cast("string") if isinstance(item, T.BooleanType) else text_of(x, item, None, exact), F.lit("NULL")))
        quoted = F.transform(texts, lambda x: F.when(x.rlike(r'[,"\r\n]|^\s|^\\\.$'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}")))
    if isinstance(kind, T.StructType | T.MapType):
        return F.to_json(value)
    if logical == "json":
        return F.coalesce(F.to_json(F.try_parse_json(value)), value)  # keys in order
    return value.cast("string")


def render(df: DataFrame, exact: bool = True) -> DataFrame:
    """All columns as text."""
    return df.select(*[text_of(F.col(f"`{f.name}`"), f.dataType, f.metadata.get("logical_type"), exact).alias(f.name) for f in df.schema])
