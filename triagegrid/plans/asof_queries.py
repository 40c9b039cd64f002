"""What was known at a date, and what the training run and the backtest are built of, over orders as records, each with the SQL that says the same.

Stand-ins: an order is a record, published 24 years after its date; its number says when it was listed and when an exploit was public.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid import constants as K
from triagegrid.functions.numbers import half_up
from triagegrid.operators import asof, features, ml, ranking
from triagegrid.plans import backtest, sinks
from triagegrid.plans.queries import AUC, R, _effort
from triagegrid.session import shared_path, table
from triagegrid.sources import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AT = "2024-01-01"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


RECORDS = """r AS (SELECT 'CVE-' || k AS cve, p AS published, CASE WHEN k % 7 = 0 THEN p + to_days(CAST(k % 900 AS INT)) END AS kev, CASE WHEN k % 3 = 0 THEN p + to_days(CAST(k % 60 - 10 AS INT)) END AS gh, CASE WHEN k % 5 = 0 THEN p + to_days(CAST(k % 100 AS INT)) END AS edb,
    CASE WHEN k % 4 <> 0 THEN (k % 100) / 100.0::DOUBLE END AS epss_t, (k % 90) / 100.0::DOUBLE AS p_model, k FROM (SELECT o_orderkey AS k, o_orderdate + INTERVAL 24 YEAR AS p FROM orders))"""
T = f"TIMESTAMP '{AT}'"


def _table(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    published = F.add_months("o_orderdate", 24 * 12).cast("timestamp")
    after = lambda n: F.timestamp_add("DAY", n.cast("int"), published)
    return table(spark, sf, "orders").select(
        F.concat(F.lit("CVE-"), k.cast("string")).alias("cve"), published.alias("published"), F.when(k % 7 == 0, after(k % 900)).alias("kev_date_added"), F.when(k % 3 == 0, after(k % 60 - 10)).alias("poc_github_first"), F.when(k % 5 == 0, after(k % 100)).alias("poc_exploitdb_first"),
        F.when(k % 4 != 0, (k % 100) / 100.0).alias("epss_t"), F.lit(0.1).alias("epss_now"), F.lit(5.0).alias("cvss_base"), F.when(k % 10 != 0, 3.6).alias("cvss_impact"), (k % 2 == 0).alias("cvss_scope_changed"), (k % 10 == 0).cast("int").alias("cvss_missing"),
        F.year(published).alias("id_year"), ((k % 90) / 100.0).alias("p_model"),
    )


def _at():
    return F.lit(AT).cast("timestamp")


@query(f"WITH {RECORDS} SELECT cve, CASE WHEN published >= {T} THEN NULL WHEN year(published) BETWEEN 2019 AND 2022 THEN 'train' WHEN year(published) = 2023 THEN 'validation' END AS split, CASE WHEN kev <= {T} THEN 1 ELSE 0 END AS y FROM r")
def frozen_split(spark, sf):
    """Split and label of each record as of the date."""
    return _table(spark, sf).select("cve", asof.frozen_split_of(F.col("published"), _at()).alias("split"), asof.known(F.col("kev_date_added"), _at()).cast("int").alias("y"))


INTEL = f"""{RECORDS}, i AS (SELECT cve, k, published, p_model, coalesce(epss_t, 0.0) AS epss, epss_t IS NOT NULL AS scored, coalesce(kev <= {T}, false) AS kev, coalesce(kev > {T}, false) AS exploited_later, coalesce(gh <= {T}, false) AS poc_github, coalesce(edb <= {T}, false) AS poc_exploitdb FROM r)"""


@query(f"WITH {INTEL} SELECT cve, p_model, epss, scored AS epss_scored, kev, exploited_later, poc_github, poc_exploitdb FROM i")
def frozen_intel(spark, sf):
    """What was known of each record at the date, and what became known later."""
    t = _table(spark, sf)
    out = backtest.frozen_intel(t.drop("p_model"), t.select("cve", "p_model"), _at())
    return out.select("cve", "p_model", "epss", "epss_scored", "kev", "exploited_later", "poc_github", "poc_exploitdb")


@query(f"WITH {INTEL} SELECT cve, epss, exploited_later FROM i WHERE scored AND published < {T}")
def frozen_population(spark, sf):
    t = _table(spark, sf)
    rows = backtest.population(backtest.frozen_intel(t.drop("p_model"), t.select("cve", "p_model"), _at()), _at())
    return rows.where("not has_context and fanin = 0 and size(services) = 0").select("cve", "epss", "exploited_later")


@query(f"WITH {RECORDS} SELECT cve, CASE WHEN gh <= least(published + INTERVAL 30 DAY, {T}) THEN 1 ELSE 0 END AS poc_github, CASE WHEN edb <= least(published + INTERVAL 30 DAY, {T}) THEN 1 ELSE 0 END AS poc_exploitdb FROM r")
def poc_flags_at(spark, sf):
    return features.poc_flags(_table(spark, sf), _at()).select("cve", "poc_github", "poc_exploitdb")


@query(f"WITH {RECORDS} SELECT cve FROM r WHERE kev > {T}")
def listed_after(spark, sf):
    return feeds.listed_after(_table(spark, sf).select("cve", "kev_date_added"), _at())


@query(f"WITH {RECORDS} SELECT cve, strftime(kev, '%Y-%m-%d') AS date_added FROM r WHERE kev IS NOT NULL")
def exploited_snapshot(spark, sf):
    """The listed records with their dates as text, published with a manifest and read back."""
    folder = shared_path(spark, "published")
    sinks.publish(spark, folder, {"exploited": sinks.exploited_snapshot(_table(spark, sf))}, {"catalog": "1"})
    return sinks.published(spark, folder, "exploited")


@query(f"WITH {RECORDS} SELECT count(*) AS n_cves, min(year(published)) AS first_year, max(year(published)) AS last_year, count(kev) AS kev, count(gh) AS github, count(edb) AS exploitdb, count(CASE WHEN k % 10 = 0 THEN 1 END) AS missing FROM r")
def feature_facts(spark, sf):
    """What the manifest of a feature table says."""
    f = sinks.feature_facts(_table(spark, sf))
    row = (f["n_cves"], *f["years"], f["kev_cves_in_nvd"], f["poc_github_cves"], f["exploitdb_cves"], f["cvss_missing"])
    return spark.createDataFrame([row], "n_cves bigint, first_year bigint, last_year bigint, kev bigint, github bigint, exploitdb bigint, missing bigint")


@query(f"WITH {INTEL}, n AS (SELECT count(*) AS n FROM i) SELECT exploited_later AS y, count(*) AS rows, {R('any_value(n) / (2.0 * count(*))')} AS weight FROM i, n GROUP BY 1")
def class_weights(spark, sf):
    """How much a row of each class weighs, so that both weigh alike."""
    t = _table(spark, sf).withColumn("y", asof.later(F.col("kev_date_added"), _at()))
    return ml.class_weight(t, "y").groupBy("y").agg(F.count(F.lit(1)).alias("rows"), half_up(F.first("weight"), 6).alias("weight"))


RANKED = f"""{INTEL}, long AS (SELECT 'epss' AS ranker, epss AS score, exploited_later AS y FROM i WHERE published < {T} UNION ALL SELECT 'model', p_model, exploited_later FROM i WHERE published < {T}),
    b AS (SELECT ranker, score, count(*) AS g, count(CASE WHEN y THEN 1 END) AS h FROM long GROUP BY 1, 2),
    k AS (SELECT ranker, CAST(g AS DOUBLE) AS g, CAST(h AS DOUBLE) AS h, CAST(coalesce(sum(g) OVER w, 0) AS DOUBLE) AS before, CAST(coalesce(sum(h) OVER w, 0) AS DOUBLE) AS hb FROM b WINDOW w AS (PARTITION BY ranker ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT ranker, sum(g) AS n, sum(h) AS p FROM k GROUP BY 1)"""


def _blocks(spark, sf) -> DataFrame:
    t = _table(spark, sf)
    rows = backtest.frozen_intel(t.drop("p_model"), t.select("cve", "p_model"), _at()).where(F.col("published") < _at())
    two = F.array(*[F.struct(F.lit(n).alias("ranker"), F.col(c).alias("score")) for n, c in (("epss", "epss"), ("model", "p_model"))])
    long = rows.select(F.col("exploited_later").cast("int").alias("y"), F.explode(two).alias("r")).select("y", "r.*")
    return ranking.tied_blocks(long, "score", "y", by=["ranker"])


@query(f"WITH {RANKED} SELECT k.ranker, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(p) AS BIGINT) AS positives, {R(AUC)} AS roc_auc, {R(_effort(0.9))} AS effort_90 FROM k JOIN t USING (ranker) GROUP BY 1")
def frozen_rankers(spark, sf):
    """Rankers measured on what was exploited after the date."""
    out = ranking.report(_blocks(spark, sf), by=["ranker"], at=(), recall=())
    return out.select("ranker", "n", "positives", half_up(F.col("roc_auc"), 6).alias("roc_auc"), half_up(F.col("effort_90"), 6).alias("effort_90"))


@query(f"WITH {RANKED}, e AS (SELECT ranker, {_effort(0.9)} AS effort FROM k JOIN t USING (ranker) GROUP BY 1) SELECT 'all' AS \"case\", printf('%.4f', a.effort) AS model, printf('%.4f', b.effort) AS epss, {R('b.effort - a.effort', 4)} AS saved FROM e a, e b WHERE a.ranker = 'model' AND b.ranker = 'epss'")
def effort_saved(spark, sf):
    """The headline: how much less of the list one ranker needs than another, and the same figures as the CSV has them."""
    out = ranking.report(_blocks(spark, sf), by=["ranker"], at=(), recall=()).withColumn("case", F.lit("all"))
    named = out.withColumn("ranker", F.when(F.col("ranker") == "model", "ml").otherwise("cvss"))
    head = backtest.headline(named)
    path = shared_path(spark, "ablation")
    backtest.write_ablation(out.withColumn("delta", F.lit(None).cast("double")), path)
    told = spark.read.csv(path, header=True)
    by = lambda r: told.where(F.col("variant") == r).select("case", F.col("effort_90").alias(r))
    return by("model").join(by("epss"), "case").join(head.select("case", "saved"), "case")


@query(f"WITH {RECORDS} SELECT k, CASE WHEN year(published) BETWEEN {K.TRAIN_YEARS[0]} AND {K.TRAIN_YEARS[1]} THEN 'train' WHEN year(published) = {K.VALIDATION_YEAR} THEN 'validation' WHEN year(published) = {K.TEST_YEAR} THEN 'test' END AS split FROM r WHERE year(published) IN (2019, 2021, 2024, 2025)")
def split_of_years(spark, sf):
    """Splits of the records of chosen years, given as ranges."""
    chosen = [y for spec in ("2019", "2021", "2024-2025") for y in feeds.years(spec)]
    t = _table(spark, sf).where(F.year("published").isin(chosen))
    return t.select(F.substring("cve", 5, 12).cast("bigint").alias("k"), asof.split_of(F.year("published")).alias("split"))
