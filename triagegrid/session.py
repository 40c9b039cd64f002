"""Session settings the operators expect, and tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "triagegrid", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and last-wins maps; conf adds to these."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    return SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new place in the folder of spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and Spark runs on one machine (as in tests) a
    folder of our own is made; on a cluster a local folder would be each machine's
    own, so there its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="triagegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def persisted(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads survive lost executors."""
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that persisted() wrote, when nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Within, rows that both sides of a join have dealt alike by some of its keys meet where they are; Spark's default deals them anew by all keys.

    Holds for what is planned within, so results are to be written there.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver's memory is collected."""
    for _ in range(2):  # the first lets go of the driver's handles, the second finds what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
