"""Tables and their description published together: all of a new state or the last one whole."""

from __future__ import annotations

import datetime as dt
import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def plain(value: object) -> object:
    """A value as JSON has it: dates in ISO form, NaN and infinities null, columns of numbers as lists."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def iso(column: Column) -> Column:
    """A timestamp as text in ISO form with seconds, a date's midnight as the date alone."""
    day = F.date_format(column, "yyyy-MM-dd")
    return F.when(column == F.date_trunc("day", column), day).otherwise(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], about: dict | None = None, release: str | None = None) -> dict:
    """Write tables as Parquet under folder/release with a manifest, then point at the release. Gives the manifest back.

    Everything is written aside first; the pointer is renamed into place last, so a run
    that dies leaves what was there before. The manifest has every table's rows and columns, and `about`.
    """
    release = release or f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    fs, target = _fs(spark, f"{folder}/{release}")
    if fs.exists(target):
        raise OSError(f"{folder}/{release} is there already")
    aside = f"{folder}/_staged-{uuid.uuid4().hex}"
    told: dict = {"release": release, "tables": {}, **(about or {})}
    for name, df in tables.items():
        df.write.parquet(f"{aside}/{name}")
        told["tables"][name] = {"rows": spark.read.schema(df.schema).parquet(f"{aside}/{name}").count(), "columns": df.columns}
    told = plain(told)  # type: ignore[assignment]
    _write_text(spark, f"{aside}/manifest.json", json.dumps(told, indent=2))
    if not fs.rename(_fs(spark, aside)[1], target):
        raise OSError(f"{aside} could not be renamed")
    point = f"{folder}/_{uuid.uuid4().hex}"
    _write_text(spark, point, release)
    current = _fs(spark, f"{folder}/{POINTER}")[1]
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(_fs(spark, point)[1], current, over)
    return told


def manifest(spark: SparkSession, folder: str, release: str | None = None) -> dict | None:
    """The manifest of a release, of the current one by default; null where nothing was published."""
    release = release or _read_text(spark, f"{folder}/{POINTER}")
    text = _read_text(spark, f"{folder}/{release}/manifest.json") if release else None
    return json.loads(text) if text else None


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the current release. None there: ValueError."""
    told = manifest(spark, folder)
    if told is None or name not in told["tables"]:
        raise ValueError(f"nothing called {name} is published in {folder}")
    return spark.read.parquet(f"{folder}/{told['release']}/{name}")


def feature_facts(table: DataFrame) -> dict:
    """What a feature table is described by: rows, years, and how many are listed, public or without a score."""
    n = lambda c: F.count(F.when(c, 1))
    r = table.agg(F.count(F.lit(1)).alias("n_cves"), F.min("id_year").alias("a"), F.max("id_year").alias("b"), n(F.col("kev_date_added").isNotNull()).alias("kev"), n(F.col("poc_github_first").isNotNull()).alias("gh"), n(F.col("poc_exploitdb_first").isNotNull()).alias("edb"), n(F.col("cvss_missing") == 1).alias("missing")).first()
    return {"n_cves": r["n_cves"], "years": [r["a"], r["b"]], "kev_cves_in_nvd": r["kev"], "poc_github_cves": r["gh"], "exploitdb_cves": r["edb"], "cvss_missing": r["missing"]}


def exploited_snapshot(table: DataFrame) -> DataFrame:
    """(cve, date_added): the listed CVEs of a feature table with their dates as text."""
    return table.where("kev_date_added is not null").select("cve", iso(F.col("kev_date_added")).alias("date_added"))
