"""The feature table: label-free columns, joins to the feeds, point-in-time columns and the model matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid import constants as K
from triagegrid.functions import cvss, text
from triagegrid.operators import asof, rates, rows

REFERENCES = ("ref_total", *K.REFERENCE_TAGS, *K.DOMAINS)
ONE_HOT = tuple(f"{m.lower()}_{v}" for m, vs in K.CVSS_METRICS.items() for v in vs)


def base_features(records: DataFrame, poc_github: DataFrame | None = None, poc_exploitdb: DataFrame | None = None) -> DataFrame:
    """records with one-hot CVSS, text and year columns, and the dates of first public exploits where given."""
    out = records.withColumn("__m", cvss.parsed(F.col("cvss_vector"))).withColumn("__d", F.lower(F.coalesce("description", F.lit(""))))
    out = out.select(
        "*", F.col("__m").isNull().cast("int").alias("cvss_missing"), *cvss.one_hot(F.col("__m")), cvss.scope_changed(F.col("__m")).alias("cvss_scope_changed"),
        F.length("__d").alias("desc_len"), *text.keyword_flags(F.col("__d")), F.year("published").alias("published_year"), text.cve_year(F.col("cve")).alias("id_year"),
    ).drop("__m", "__d")
    for name, first in (("poc_github_first", poc_github), ("poc_exploitdb_first", poc_exploitdb)):
        if first is None:
            out = out.withColumn(name, F.lit(None).cast("timestamp"))
        else:
            out = out.join(first.select("cve", F.col("first_ts").alias(name)), "cve", "left")
    return out


def feature_table(base: DataFrame, exploited: DataFrame, scores_now: DataFrame, scores_then: DataFrame) -> DataFrame:
    """base with listing dates and both score snapshots. Current scores are 0 where absent; a null score at the date says that there was none."""
    now = scores_now.select("cve", F.col("epss").alias("epss_now"), F.col("percentile").alias("epss_now_pct"))
    then = scores_then.select("cve", F.col("epss").alias("epss_t"), F.col("percentile").alias("epss_t_pct"))
    out = base.join(exploited, "cve", "left").join(now, "cve", "left").join(then, "cve", "left")
    return out.fillna(0.0, ["epss_now", "epss_now_pct"])


def poc_flags(df: DataFrame, at: Column | None = None) -> DataFrame:
    flag = lambda c: asof.poc_in_window(F.col(c), F.col("published"), at)
    return df.withColumn("poc_github", flag("poc_github_first")).withColumn("poc_exploitdb", flag("poc_exploitdb_first"))


class Encoder:
    """Columns that depend on the label, learned from training rows: frequent weaknesses and smoothed rates by vendor and product."""

    def __init__(self, train: DataFrame, label: str, top: int = K.TOP_CWES, smoothing: float = K.SMOOTHING):
        self._spark = train.sparkSession
        real = train.where(F.col("cwe").startswith("CWE-"))
        self.cwes = [r["cwe"] for r in rows.top_k(real, "cwe", top).collect()]
        self.prior = float(train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)
        self.label, self.smoothing = label, smoothing
        self.tables = {c: rates.rate_table(train, c, label, smoothing) for c in ("vendor", "product")}

    def names(self, include: Sequence[str] = ()) -> list[str]:
        cwes = ["cwe_" + c.split("-", 1)[1] for c in self.cwes]
        return ["cvss_base", "cvss_missing", *ONE_HOT, *cwes, "cwe_other", "vendor_kev_rate", "product_kev_rate", *REFERENCES, "desc_len", *K.KEYWORDS, "poc_github", "poc_exploitdb", *include]

    def transform(self, df: DataFrame, include: Sequence[str] = (), out_of_fold: bool = False) -> DataFrame:
        """df with the model's columns, in a fixed order behind its own. out_of_fold: for the training rows themselves.

        A column of include that df does not have: ValueError.
        """
        absent = [c for c in ("poc_github", "poc_exploitdb", *include) if c not in df.columns]
        if absent:
            raise ValueError(f"missing column(s): {', '.join(absent)}")
        out = df.withColumn("cvss_base", F.coalesce("cvss_base", F.lit(-1.0))).fillna(0, list(REFERENCES))
        for c in self.cwes:
            out = out.withColumn("cwe_" + c.split("-", 1)[1], F.coalesce((F.col("cwe") == c).cast("int"), F.lit(0)))
        out = out.withColumn("cwe_other", F.coalesce((~F.col("cwe").isin(self.cwes)).cast("int"), F.lit(1)))
        if out_of_fold:
            out = out.withColumn("__fold", rates.fold_of(F.col("cve")))
        for key in ("vendor", "product"):
            name = f"{key}_kev_rate"
            if out_of_fold:
                table = rates.out_of_fold_rates(out, key, self.label, "__fold", self.smoothing).withColumnRenamed("rate", name)
                out = out.join(table, [key, "__fold"], "left")
            else:
                out = out.join(self.tables[key].withColumnRenamed("rate", name), key, "left")
            out = out.withColumn(name, F.coalesce(name, F.lit(self.prior)))
        return out.drop("__fold")

    def save(self, path: str) -> None:
        """What was learned, as tables under path: the settings and the rates by vendor and product."""
        settings = (self.cwes, self.prior, self.label, self.smoothing)
        self._spark.createDataFrame([settings], "cwes array<string>, prior double, label string, smoothing double").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        for key, rates_ in self.tables.items():
            rates_.write.mode("overwrite").parquet(f"{path}/{key}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoder:
        """The encoder that save() wrote; its rates are read, not learned again."""
        out = cls.__new__(cls)
        told = spark.read.parquet(f"{path}/settings").first()
        out._spark, out.cwes, out.prior, out.label, out.smoothing = spark, list(told["cwes"]), told["prior"], told["label"], told["smoothing"]
        out.tables = {key: spark.read.parquet(f"{path}/{key}") for key in ("vendor", "product")}
        return out
