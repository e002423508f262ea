"""Spark sessions with the settings that the engine's semantics need."""

import tempfile

from pyspark.sql import SparkSession

#: Semantics only; sizes and parallelism belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none and runs on this machine alone (tests) is one made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="plinth-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; without a master, what spark-submit gives. Local ones get as many shuffle partitions as threads."""
    builder = SparkSession.builder.appName("plinth")
    local = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"} if master else {}
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **local, **settings}.items():
        builder = builder.config(k, v)
    out = builder.getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out
