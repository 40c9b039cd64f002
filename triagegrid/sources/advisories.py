"""Advisories in ZIP archives: the directory of each archive is read once, its members are dealt over tasks by their place."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.functions.versions import affected_version
from triagegrid.sources.ranges import _open

AFFECTED = "struct<package:struct<ecosystem:string,name:string>,versions:array<string>,ranges:array<struct<events:array<struct<introduced:string>>>>>"
ADVISORY = f"struct<id:string,aliases:array<string>,published:string,affected:array<{AFFECTED}>>"
LOCAL_HEADER = 30
GROUP = 256


def members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(path, member, place, packed, method) of the archives' members with the suffix, from their central directories."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where in b.column(0).to_pylist():
                store, name = _open(where)
                with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                    some = [i for i in z.infolist() if i.filename.endswith(suffix)]
                    for lo in range(0, len(some), 10_000):
                        part = some[lo : lo + 10_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([where] * len(part)), pa.array([i.filename for i in part]), pa.array([i.header_offset for i in part], pa.int64()), pa.array([i.compress_size for i in part], pa.int64()), pa.array([i.compress_type for i in part], pa.int32())],
                            names=["path", "member", "place", "packed", "method"],
                        )

    return found.mapInArrow(run, "path string, member string, place bigint, packed bigint, method int")


def read_members(spark: SparkSession, path: str, suffix: str = ".json", group: int = GROUP) -> DataFrame:
    """(path, member, body): the members' texts. Those that do not unpack are left out.

    Members go to tasks in groups of about `group` that lie together in their archive.
    """
    dealt = members(spark, path, suffix).withColumn("__g", F.floor(F.col("place") / F.lit(group * 2048)))
    dealt = dealt.repartition("path", "__g").sortWithinPartitions("path", "place").drop("__g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_at = None, None
        try:
            for b in batches:
                rows = []
                for where, member, place, packed, method in zip(*(b.column(i).to_pylist() for i in range(5))):
                    if where != open_at:
                        if held is not None:
                            held.close()
                        store, name = _open(where)
                        held, open_at = store.open_input_file(name), where
                    # The member's own header says how long its name and extra field are.
                    held.seek(place)
                    name_size, extra = struct.unpack("<26xHH", held.read(LOCAL_HEADER))
                    held.seek(place + LOCAL_HEADER + name_size + extra)
                    data = held.read(packed)
                    try:
                        text = (data if method == zipfile.ZIP_STORED else zlib.decompress(data, -15)).decode("utf-8-sig")
                    except (zlib.error, UnicodeDecodeError):
                        continue
                    rows.append((where, member, text))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "member", "body"])
        finally:
            if held is not None:
                held.close()

    return dealt.mapInArrow(run, "path string, member string, body string")


def scan(bodies: DataFrame, targets: DataFrame, ecosystem: str, freeze: str | None = None, published: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((ecosystem, package, version, cve), (late)): the target CVEs that advisories name, at the first affected package of the ecosystem that has a version.

    bodies(path, member, body). targets(cve). With freeze (yyyy-MM-dd) a CVE published on
    that day or later is left out and counted as late; its date is that of published(cve, day), else the advisory's;
    without any it stays. Texts that are no advisory are left out.
    """
    read = bodies.select("path", "member", F.from_json("body", ADVISORY).alias("a")).where("a is not null")
    named = read.withColumn("cve", F.explode(F.array_distinct(F.concat(F.array(F.coalesce("a.id", F.lit(""))), F.coalesce("a.aliases", F.array().cast("array<string>"))))))
    hits = named.join(targets.select("cve").distinct(), "cve", "left_semi")
    if freeze is None:
        kept, late = hits, hits.agg(F.lit(0).cast("bigint").alias("late"))
    else:
        if published is not None:
            hits = hits.join(published.select("cve", F.col("day").alias("__day")), "cve", "left")
        else:
            hits = hits.withColumn("__day", F.lit(None).cast("string"))
        # An empty date says as little as none.
        day = F.coalesce(*[F.when(F.length(d) > 0, d) for d in (F.col("__day"), F.substring("a.published", 1, 10))])
        after = F.coalesce(day >= freeze, F.lit(False))
        kept, late = hits.where(~after), hits.agg(F.count(F.when(after, 1)).alias("late"))
    own = lambda x: (F.split_part(F.coalesce(x["package"]["ecosystem"], F.lit("")), F.lit(":"), F.lit(1)) == ecosystem) & (F.length(x["package"]["name"]) > 0)
    fit = F.transform(F.filter("a.affected", own), lambda x: F.struct(x["package"]["name"].alias("package"), affected_version(x).alias("version")))
    first = F.get(F.filter(fit, lambda x: F.length(x["version"]) > 0), F.lit(0))
    rows = kept.withColumn("f", first).where("f is not null")
    return rows.select(F.lit(ecosystem).alias("ecosystem"), "f.package", "f.version", "cve"), late


def top_packages(found: DataFrame, k: int = 60) -> DataFrame:
    """The k packages of scan() that cover most CVEs: (ecosystem, package, version, cves), of equal ones by name."""
    counts = found.groupBy("ecosystem", "package", "version").agg(F.countDistinct("cve").alias("cves"))
    return counts.orderBy(F.desc("cves"), "ecosystem", "package", "version").limit(k)
