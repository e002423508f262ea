"""Structured Streaming jobs: landed event files into a stored table, and windowed counts with a watermark."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.sources.ingest import event_schema, events_of
from plinth.sources.store import Store


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Typed events from files of JSON lines as they land in a folder."""
    return events_of(spark.readStream.schema(event_schema()).option("maxFilesPerTrigger", files_per_batch).json(path))


def append_stream(events: DataFrame, store: Store, schema: str, name: str, checkpoint: str, key: str = "uuid"):
    """Starts a query that adds what is available to a stored table, then ends.

    A batch that is run again after a failure adds nothing twice: rows whose key the table has are left out. Rows without a
    key can't be told apart and are added each time.
    """

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(batch.filter(F.col(key).isNull()))
        if not store.exists(schema, name):
            store.replace(schema, name, fresh)
            return
        store.append(schema, name, fresh.join(store.read(schema, name).select(key), key, "left_anti").select(*batch.columns))

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """(start, keys, n) of each tumbling window; rows later than `late` behind the newest are dropped, state stays bounded."""
    return events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late).groupBy(F.window("_time", width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
