"""As-of join, sessions and windows as compositions of built-in operators."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, span: str = "day") -> DataFrame:
    """left with `value` of the latest right row of the same key at or before left's time.

    Null keys match nothing. At equal times right rows come first; of several right rows at one time the greatest value counts. Rows are sorted within a key and
    a span of time (a unit of date_trunc), so a hot key is many groups; what earlier spans hold last is carried from span to span by a row for each.
    """
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_span", F.date_trunc(span, at))
    within = Window.partitionBy(key, "_span").orderBy(at, "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ends = both.filter("_v IS NOT NULL").groupBy(key, "_span").agg(F.max(F.struct(at, "_v")).alias("_last"))
    spans = both.select(key, "_span").distinct().join(ends, [key, "_span"], "left")
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(key, "_span", F.last("_last._v", ignorenulls=True).over(before).alias("_carried"))
    found = both.withColumn(value, F.last("_v", ignorenulls=True).over(within)).filter("_side = 1").join(carried, [key, "_span"], "left")
    return found.withColumn(value, F.when(F.col(key).isNotNull(), F.coalesce(value, "_carried"))).select(*left.columns, *([value] if value not in left.columns else []))


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, events) of each session: rows at most `gap` apart."""
    grouped = events.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("events"))
    return grouped.select(key, F.col("s.start").alias("start"), "events")


def tumbling(events: DataFrame, at: str, width: str, *by: str) -> DataFrame:
    grouped = events.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), *by, "n")
