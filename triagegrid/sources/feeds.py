"""Public feeds: vulnerability records, exploited and scored ones, public exploits. Every schema is explicit."""

from __future__ import annotations

import lzma
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from triagegrid import constants as K
from triagegrid.functions import cvss, text
from triagegrid.operators.rows import keep_first, keep_last
from triagegrid.sources import ranges

_METRIC = "array<struct<source:string,type:string,cvssData:struct<version:string,vectorString:string,baseScore:double>,exploitabilityScore:double,impactScore:double>>"
ITEM = (
    "struct<id:string,published:string,vulnStatus:string,descriptions:array<struct<lang:string,value:string>>,"
    f"metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:array<struct<type:string,cvssData:struct<baseScore:double>>>>,"
    "weaknesses:array<struct<type:string,description:array<struct<lang:string,value:string>>>>,references:array<struct<url:string,source:string,tags:array<string>>>,"
    "configurations:array<struct<nodes:array<struct<operator:string,negate:boolean,cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>,"
    "affected:array<struct<affectedData:array<struct<vendor:string,product:string,cpes:array<string>>>>>>"
)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, body): whole text files, plain, .gz or .xz. Spark has no codec for the last; tasks unpack it."""
    plain = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for b in batches:
            body = [lzma.decompress(c) if p.endswith(".xz") else gzip.decompress(c) if p.endswith(".gz") else c for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame({"path": b["path"], "body": [x.decode("utf-8-sig") for x in body]})

    return plain.mapInPandas(unpack, "path string, body string")


def spark_type(ddl: str) -> StructType:
    """The type that a struct<...> names."""
    return StructType.fromDDL(f"x {ddl}")["x"].dataType  # type: ignore[return-value]


def records(found: DataFrame) -> DataFrame:
    """(path, item_ord, item) of ranges.read_records(): a record stands for itself or under cve; what has no id is none."""
    item = spark_type(ITEM)
    both = StructType([*item.fields, StructField("cve", item)])
    names = item.fieldNames()
    parsed = found.select("path", "item_ord", F.from_json("body", both).alias("w"))
    own = F.struct(*[F.col(f"w.{n}").alias(n) for n in names])
    return parsed.select("path", "item_ord", F.when(F.col("w.cve").isNotNull() & F.col("w.id").isNull(), F.col("w.cve")).otherwise(own).alias("item")).where("length(item.id) > 0")


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _primary_first(values: Column) -> Column:
    return F.concat(F.filter(values, lambda m: m["type"] == "Primary"), F.filter(values, lambda m: F.coalesce(m["type"] != "Primary", F.lit(True))))


def flat_records(items: DataFrame) -> DataFrame:
    """One row per record: cve, description, published, scores, weakness, vendor, product and reference counts.

    Rejected records are left out, and with them those whose date does not parse.
    A v3.1 score goes before a v3.0 one, in each the primary source first. A
    vector that does not parse takes its scores along.
    """
    i = F.col("item")
    english = F.coalesce(_first(F.filter(i["descriptions"], lambda d: d["lang"] == "en"))["value"], F.lit(""))
    rejected = (F.lower(F.coalesce(i["vulnStatus"], F.lit(""))) == "rejected") | english.startswith("** REJECT **")
    some = lambda c: F.when(F.size(c) > 0, c)
    metric = _first(_primary_first(F.coalesce(some(i["metrics"]["cvssMetricV31"]), some(i["metrics"]["cvssMetricV30"]))))
    vector = metric["cvssData"]["vectorString"]
    weak = F.flatten(F.transform(_primary_first(F.coalesce(i["weaknesses"], F.array().cast("array<struct<type:string,description:array<struct<lang:string,value:string>>>>"))), lambda w: F.transform(w["description"], lambda d: d["value"])))
    cwe = F.coalesce(_first(F.filter(weak, lambda w: w.startswith("CWE-"))), F.lit("noinfo"))
    nodes = F.flatten(F.transform(i["configurations"], lambda c: F.coalesce(c["nodes"], F.array().cast("array<struct<operator:string,negate:boolean,cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>"))))
    match = F.filter(F.flatten(F.transform(nodes, lambda n: n["cpeMatch"])), lambda m: m["vulnerable"])
    data = F.flatten(F.transform(i["affected"], lambda a: a["affectedData"]))
    cpes = F.concat(F.coalesce(F.transform(match, lambda m: m["criteria"]), F.array().cast("array<string>")), F.coalesce(F.flatten(F.transform(data, lambda a: a["cpes"])), F.array().cast("array<string>")))
    parts = _first(F.filter(F.transform(cpes, lambda c: F.split(c, ":")), lambda p: (F.get(p, F.lit(3)) != "") & (F.get(p, F.lit(4)) != "")))
    vendor, product = F.coalesce(F.lower(F.get(parts, F.lit(3))), F.lit("unknown")), F.coalesce(F.lower(F.get(parts, F.lit(4))), F.lit("unknown"))
    # References by lower-cased address, without those that give the label away; tags of one address are put together.
    refs = F.filter(F.transform(F.coalesce(i["references"], F.array().cast("array<struct<url:string,source:string,tags:array<string>>>")), lambda r: F.struct(F.lower(r["url"]).alias("url"), F.coalesce(r["tags"], F.array().cast("array<string>")).alias("tags"))), lambda r: r["url"].isNotNull() & ~text.leaky(r["url"]))
    out = items.where(~rejected).select(
        "path", "item_ord", i["id"].alias("cve"), english.alias("description"), F.try_to_timestamp(F.substring(i["published"], 1, 10), F.lit("yyyy-MM-dd")).alias("published"),
        F.when(vector.isNotNull(), vector).alias("__vector"), metric["cvssData"]["baseScore"].alias("__base"), _first(i["metrics"]["cvssMetricV2"])["cvssData"]["baseScore"].alias("cvss2_base"),
        cwe.alias("cwe"), vendor.alias("vendor"), F.concat(vendor, F.lit(":"), product).alias("product"), refs.alias("__refs"),
    )
    out = out.withColumn("__m", cvss.parsed(F.col("__vector"))).withColumn("__urls", F.array_distinct(F.transform("__refs", lambda r: r["url"])))
    tagged = lambda tag: F.size(F.array_distinct(F.transform(F.filter("__refs", lambda r: F.array_contains(r["tags"], tag)), lambda r: r["url"])))
    ok = F.col("__m").isNotNull()
    return out.where("published is not null").select(
        "path", "item_ord", "cve", "description", "published", F.when(ok, F.col("__vector")).alias("cvss_vector"), F.when(ok, F.col("__base")).alias("cvss_base"), cvss.impact(F.col("__m")).alias("cvss_impact"), "cvss2_base", "cwe", "vendor", "product",
        F.size("__urls").alias("ref_total"), *[tagged(t).alias(n) for n, t in K.REFERENCE_TAGS.items()], *text.domain_flags(F.col("__urls")),
    )


def read_records(spark: SparkSession, path: str, of_years: Sequence[int] | None = None, split: int = ranges.SPLIT) -> DataFrame:
    """All records of the files at path, flat; of a CVE in several files the last counts, by file name and place.

    Large plain files are read in ranges of split bytes.

    With of_years path is a folder of which each year's file CVE-<year>.json is
    read, packed as .xz rather than .gz rather than plain; years without one are
    passed over, and ValueError if there is none at all. Then the last year's record counts.
    """
    if of_years is None:
        return keep_last(flat_records(records(ranges.read_records(spark, path, split))), ["cve"], ["path", "item_ord"]).drop("path", "item_ord")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "CVE-*.json*").load(path).select("path")
    name = F.regexp_extract("path", r"CVE-(\d{4})\.json(\.xz|\.gz|)$", 1)
    packed = F.regexp_extract("path", r"CVE-\d{4}\.json(\.xz|\.gz|)$", 1)
    order = F.when(packed == ".xz", 0).when(packed == ".gz", 1).otherwise(2)
    chosen = listed.where(name.isin([str(y) for y in of_years])).groupBy(name.alias("year")).agg(F.min_by("path", order).alias("path")).collect()
    if not chosen:
        raise ValueError(f"no records of {list(of_years)} at {path}")
    found = ranges.read_records(spark, [r["path"] for r in chosen], split)
    year = F.regexp_extract("path", r"CVE-(\d{4})\.json", 1)
    return keep_last(flat_records(records(found)).withColumn("__y", year), ["cve"], ["__y", "item_ord"]).drop("path", "item_ord", "__y")


def read_exploited(spark: SparkSession, path: str) -> DataFrame:
    """(cve, kev_date_added): earliest listing of each CVE; dates that do not parse are null."""
    doc = spark.read.schema("catalogVersion string, dateReleased string, vulnerabilities array<struct<cveID:string,dateAdded:string>>").json(path, multiLine=True)
    rows = doc.select(F.explode("vulnerabilities").alias("v")).select(F.trim("v.cveID").alias("cve"), F.try_to_timestamp(F.trim("v.dateAdded"), F.lit("yyyy-MM-dd")).alias("d"))
    return rows.where("cve <> ''").groupBy("cve").agg(F.min("d").alias("kev_date_added"))


def exploited_catalogue(spark: SparkSession, path: str) -> dict[str, object]:
    """The list's version, release and number of entries; of several files those of the latest release."""
    doc = spark.read.schema("catalogVersion string, dateReleased string, vulnerabilities array<struct<cveID:string,dateAdded:string>>").json(path, multiLine=True)
    r = doc.select("catalogVersion", "dateReleased", F.size("vulnerabilities").alias("count")).orderBy(F.desc_nulls_last("dateReleased"), F.desc_nulls_last("catalogVersion")).first()
    return {} if r is None else r.asDict()


def read_scores(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """((cve, epss, percentile), metadata) of a CSV file whose first line may hold #key:value pairs; of repeated CVEs the first row counts."""
    first = spark.read.text(path).first()
    meta = dict(p.split(":", 1) for p in first["value"][1:].split(",") if ":" in p) if first and first["value"].startswith("#") else {}
    rows = spark.read.schema("cve string, epss string, percentile string").csv(path, header=True, comment="#")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    rows = rows.withColumn("__n", F.monotonically_increasing_id()).where("cve is not null")
    return keep_first(rows, ["cve"], ["__n"]).select("cve", number("epss"), number("percentile")), meta


def read_poc_repositories(spark: SparkSession, path: str) -> DataFrame:
    """(cve, first_ts): earliest repository of each file CVE-*.json; files that do not parse are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "CVE-*.json").option("recursiveFileLookup", "true").load(path)
    made = F.transform(F.from_json(F.col("content").cast("string"), "array<struct<created_at:string>>"), lambda r: F.try_to_timestamp(r["created_at"]))
    cve = F.regexp_extract("path", r"(CVE-[^/]*)\.json$", 1)
    return rows.select(cve.alias("cve"), F.array_min(made).alias("t")).where("t is not null").groupBy("cve").agg(F.min("t").alias("first_ts"))


def read_exploit_archive(spark: SparkSession, path: str) -> DataFrame:
    """(cve, first_ts): earliest publication, else listing, of the CVEs that an exploit's codes name."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd"))
    return rows.select(F.explode(text.cve_ids(F.col("codes"))).alias("cve"), F.coalesce(day("date_published"), day("date_added")).alias("t")).where("t is not null").groupBy("cve").agg(F.min("t").alias("first_ts"))


def listed_after(exploited: DataFrame, at: Column) -> DataFrame:
    return exploited.where(F.col("kev_date_added") > at).select("cve")


def years(spec: str) -> Sequence[int]:
    """'2019-2021' or '2020' as a range of years."""
    low, _, high = spec.partition("-")
    return range(int(low), int(high or low) + 1)
