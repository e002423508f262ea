"""What the operators share: reading tables, cutting lineage, generational caches."""

import itertools
import re
import uuid

import regex
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.session import shared_dir

#: A batch between the JVM and Python: rows hold whole texts, so Spark's defaults (10,000 rows, 64 MB) would be much on each side.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def short_batches(spark: SparkSession) -> None:
    """BATCH for the session: a plan takes these when it runs, so they are set where the operators' tables are read and written."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)


def row_name(*columns: Column) -> Column:
    """A 128-bit name (binary) of a row's values: two hashes, chained from either end. Equal rows have equal names; no value is copied for it."""
    half = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.unhex(F.concat(half(F.xxhash64(*columns)), half(F.xxhash64(F.lit("other end"), *reversed(columns)))))


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    return next(x for i in itertools.count() if (x := f"_{name}_{i}") not in taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark's own reader (any Hadoop path)."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors cost nothing.

    What earlier tables were shuffled through is garbage by now; Spark deletes such files when the driver collects it.
    """
    spark = df.sparkSession
    short_batches(spark)
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/plinth/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# PATTERN for texts of plain Latin-1, where letters and numbers are these ranges; alternatives that can't start alike are reordered.
_LATIN = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
_BEYOND = re.compile("[^\t-\r -\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")


def splitter(pattern: str):
    """A function from a text to the matches of pattern; quicker for PATTERN and Latin-1 texts."""
    find = regex.compile(pattern).findall
    if pattern != PATTERN:
        return find
    return lambda text: (find if _BEYOND.search(text) else _LATIN.findall)(text)


class Generations(dict):
    """A cache of at most 2 * cap entries: when full, the older generation goes.

    make(key) gives the value of a key in neither generation.
    """

    def __init__(self, make, cap: int):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
