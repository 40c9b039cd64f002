"""The training run: six ways to rank a test year, compared on all rows and on those with a score, and what the model looks at."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid import constants as K
from triagegrid.operators import asof, boosting, ml, ranking
from triagegrid.operators.features import Encoder, poc_flags
from triagegrid.session import discard, persisted

# What each model sees besides the features that all share.
VARIANTS = {"model_no_epss": (), "model_with_epss": ("epss",), "model_time_features": ("days_since_publish", "published_year")}


class TrainingRun(NamedTuple):
    """Ranking metrics by ranker, on all test rows and on those with a CVSS score; importances; mean size of contributions; what was fitted, with its calibration, by name."""

    table: DataFrame
    scored: DataFrame
    importance: list[tuple[str, float]]
    contributions: DataFrame
    encoder: Encoder
    models: dict
    lines: dict[str, tuple[float, float]]


def train(spark: SparkSession, table: DataFrame, today: Column, years: tuple[int, int] = K.TRAIN_YEARS, validation_year: int = K.VALIDATION_YEAR, test_year: int = K.TEST_YEAR, trees: bool = True, settings: boosting.Settings = boosting.Settings()) -> TrainingRun:
    """Fit every variant and a linear model on the training years, rank the test year by each and by the two given scores.

    The label is being listed as exploited. A split without rows or without
    positives: ValueError. Models are calibrated on the validation year; ranks do
    not depend on that. The encoded matrix is written once, and the variants, which
    take other columns of it, are fitted together. With trees=False all models are linear.
    """
    rows = poc_flags(table).withColumn("__y", F.col("kev_date_added").isNotNull().cast("int"))
    rows = rows.withColumn("__split", asof.split_of(F.year("published"), years, validation_year, test_year)).where("__split is not null")
    rows = rows.withColumn("epss", F.coalesce("epss_now", F.lit(0.0))).withColumn("days_since_publish", asof.days_since(F.col("published"), today))
    rows = persisted(spark, rows, "training-rows")
    seen = {r["__split"]: r["p"] for r in rows.groupBy("__split").agg(F.sum("__y").alias("p")).collect()}
    for name in ("train", "validation", "test"):
        if not seen.get(name):
            raise ValueError(f"the {name} split has no rows or none that is positive")
    encoder = Encoder(rows.where("__split = 'train'"), "__y")
    extra = tuple(dict.fromkeys(c for include in VARIANTS.values() for c in include))
    # Training rows are encoded out of fold, all others by what all training rows say.
    own = encoder.transform(rows.where("__split = 'train'"), extra, out_of_fold=True).unionByName(encoder.transform(rows.where("__split <> 'train'"), extra))
    cvss = F.when(F.col("cvss_missing") == 1, F.lit(-1.0)).otherwise(F.col("cvss_base"))
    wide = own.select("cve", "__y", "__split", "cvss_missing", cvss.alias("cvss"), *[F.col(c).cast("double").alias(c) for c in encoder.names(extra) if c != "cvss_missing"])
    wide = persisted(spark, wide, "training-matrix")
    part = lambda n: wide.where(F.col("__split") == n)
    names = encoder.names()
    models: dict = {}
    lines: dict[str, tuple[float, float]] = {}
    linear = ["logreg_no_epss"] if trees else [*VARIANTS, "logreg_no_epss"]
    scores = part("test").select("cve", "__y", "cvss_missing", "cvss", "epss")
    for key in linear:
        models[key] = ml.fit_logistic(part("train"), encoder.names(VARIANTS.get(key, ())), "__y")
        tried = models[key].transform(part("validation"))
        lines[key] = ml.calibrate(tried.select(ml.margin(tried, models[key]).alias("__margin"), "__y"), "__margin", "__y")
        predicted = models[key].transform(part("test"))
        scores = scores.join(predicted.select("cve", ml.margin(predicted, models[key]).alias(key)), "cve")
    if trees:
        told = F.array(*[F.struct(F.lit(i).alias("model"), F.array(*[F.col(n).cast("double") for n in encoder.names(include)]).alias("x")) for i, include in enumerate(VARIANTS.values())])
        m = wide.select("cve", F.col("__split").alias("role"), F.xxhash64("cve").alias("key"), F.col("__y").alias("y"), F.explode(told).alias("__v")).select("cve", "role", "key", "y", "__v.model", "__v.x")
        fitted = boosting.fit(spark, m.where("role in ('train', 'validation')"), settings)
        done = persisted(spark, boosting.score(m.where("role <> 'train'"), fitted, contributions=True).drop("x"), "training-margins")
        found = boosting.platt(done.where("role = 'validation'"))
        test = done.where("role = 'test'")
        for i, key in enumerate(VARIANTS):
            models[key], lines[key] = fitted[i], found[i]
            scores = scores.join(test.where(F.col("model") == i).select("cve", F.col("margin").alias(key)), "cve")
        values, of = test.where("model = 0").select("contributions"), F.col("contributions")
        gains = dict(zip(names, models["model_no_epss"].gains().tolist()))
        importance = sorted(gains.items(), key=lambda x: (-x[1], x[0]))[:15]
    else:
        values, of = models["model_no_epss"].transform(part("test")), ml.linear_contributions(models["model_no_epss"])
        importance = ml.importance(models["model_no_epss"], names)
    scores = persisted(spark, scores, "training-scores")
    each = values.select(F.posexplode(of).alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("mean_abs"))
    said = F.array(*map(F.lit, names))
    contributions = each.select(F.get(said, F.col("i")).alias("feature"), "mean_abs").orderBy(F.desc("mean_abs"), "feature").limit(15)
    discard(spark, rows)
    return TrainingRun(compare(scores), compare(scores.where("cvss_missing = 0")), importance, contributions, encoder, models, lines)


def compare(scores: DataFrame) -> DataFrame:
    """Ranking metrics of the six rankers over rows (cve, __y, a column for each ranker)."""
    rankers = [c for c in ("cvss", "epss", *VARIANTS, "logreg_no_epss") if c in scores.columns]
    long = scores.select("__y", F.explode(F.array(*[F.struct(F.lit(r).alias("ranker"), F.col(r).cast("double").alias("score")) for r in rankers])).alias("r")).select("r.*", "__y")
    return ranking.report(ranking.tied_blocks(long, "score", "__y", by=["ranker"]), by=["ranker"], at=(100, 500), recall=(1000,), efforts=(0.9,))
