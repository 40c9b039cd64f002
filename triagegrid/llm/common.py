"""Helpers that several operators share: shared storage, worker paths, words, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])


def ensure_workers(spark: SparkSession) -> None:
    """Put this repository on the Python workers' path, wherever the driver was started."""
    env = spark.sparkContext.environment
    here = env.get("PYTHONPATH", "")
    if REPO not in here.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, here) if x)


def frugal(run: Callable) -> Callable:
    """run for mapInArrow, after which the worker gives back what its allocators keep.

    Workers live on between stages; what they keep of a stage's arrays would stand
    beside the memory of stages that need no Python.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset and Spark runs on one machine (as in tests) a folder
    of our own is made; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's memory is collected, which may not happen for
    long while executors' disks fill up. Called between the steps of long jobs,
    after a step's result was written.
    """
    for _ in range(2):  # the first lets go of the driver's handles, the second finds what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing needs any more."""
    delete(spark, df._shared_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Numbers that tell the texts of repeated ids apart: (hi, digest, uid), or None where no id repeats.

    Every distinct text of every id has a uid, which rises with (id, digest).
    Null ids have none.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias("hi"), text_digest(text_col).alias("digest")).where("hi is not null")
    if ids.groupBy("hi").count().where("count > 1").isEmpty():
        return None
    ordered = ids.distinct().repartitionByRange("hi", "digest").sortWithinPartitions("hi", "digest")
    return materialize(spark, ordered.withColumn("uid", F.monotonically_increasing_id()), "text-numbers")


def text_digest(text_col: str = "text"):
    """What number_texts() knows a text by; null text has one too."""
    return F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of edges(a, b): rows (node, component).

    Contraction: every node points at its smallest neighbour, chains of
    pointers are followed once, edges are redrawn between what is pointed at,
    until no edge is left. A round at least halves the nodes that still have edges.
    Only nodes with an edge come back. Self-loops and repeated edges are harmless.
    """
    edges = materialize(spark, edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    found = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to"))
        low = materialize(spark, low, "cc-low")
        hop = low.select(F.col("node").alias("to"), F.col("to").alias("next"))
        low = materialize(spark, low.join(hop, "to").select("node", F.col("next").alias("to")), "cc-hop")
        if found is None:
            found = low.select("node", F.col("to").alias("component"))
        else:
            step = low.select(F.col("node").alias("component"), F.col("to"))
            found = found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        found = materialize(spark, found, "cc-found")
        a = low.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        b = low.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        drawn = edges.join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        edges = materialize(spark, drawn.where("a <> b").distinct(), "cc-edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
