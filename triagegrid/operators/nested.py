"""Cross-fitting in one pass: the encoders and matrices of all folds' models, and of the model of all rows, from one set of sums.

Model k below `folds` knows the training rows of the other folds, model `folds` all of
them. What a model knows by key is taken from counts by (key, fold, inner fold), which
are made once; rows are met by (model, key), not scanned again for each model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagegrid import constants as K
from triagegrid.operators.features import ONE_HOT, REFERENCES


def models_of(fold: Column, folds: int) -> Column:
    """The models that know a training row of this fold."""
    return F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda m: m != fold)


def known_sums(train: DataFrame, keys: Sequence[str], label: str, fold: str, inner: str, folds: int) -> DataFrame:
    """(model, keys, inner, s, n): sums of the label and rows that each model knows, from one pass over the rows."""
    cell = train.groupBy(*keys, fold, inner).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    return cell.withColumn("model", F.explode(models_of(F.col(fold), folds))).groupBy("model", *keys, inner).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def nested_rates(train: DataFrame, key: str, label: str, fold: str, inner: str, folds: int = K.FOLDS, smoothing: float = K.SMOOTHING) -> tuple[DataFrame, DataFrame]:
    """Smoothed rates of every model: (model, key, rate) for rows it does not know; (model, key, inner, rate) for those it does.

    The second leaves out the rows of the same inner fold, with the prior of the
    rest; where nothing is left the model's own prior stands.
    """
    sums = known_sums(train, [key], label, fold, inner, folds)
    by_key = sums.groupBy("model", key).agg(F.sum("s").alias("ks"), F.sum("n").alias("kn"))
    by_inner = sums.groupBy("model", inner).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    total = by_inner.groupBy("model").agg(F.sum("fs").alias("ts"), F.sum("fn").alias("tn"))
    a = F.lit(smoothing)
    prior = F.col("ts") / F.col("tn")
    all_ = by_key.join(F.broadcast(total), "model").select("model", key, ((F.col("ks") + a * prior) / (F.col("kn") + a)).alias("rate"))
    met = sums.join(by_key, ["model", key]).join(F.broadcast(by_inner), ["model", inner]).join(F.broadcast(total), "model")
    others = (F.col("ts") - F.col("fs")) / (F.col("tn") - F.col("fn"))
    rate = (F.col("ks") - F.col("s") + a * others) / (F.col("kn") - F.col("n") + a)
    return all_, met.select("model", key, inner, F.when(F.col("kn") > F.col("n"), rate).otherwise(prior).alias("rate"))


def frequent(train: DataFrame, key: str, fold: str, folds: int = K.FOLDS, top: int = K.TOP_CWES) -> DataFrame:
    """(model, key, place): each model's most frequent values, place from 0; of equal counts the smaller value."""
    cell = train.where(F.col(key).isNotNull()).groupBy(key, fold).agg(F.count(F.lit(1)).alias("n"))
    n = cell.withColumn("model", F.explode(models_of(F.col(fold), folds))).groupBy("model", key).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("model").orderBy(F.desc("n"), key)
    return n.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < top).select("model", key, "place")


def feature_names(top: int = K.TOP_CWES) -> list[str]:
    """Names of matrix()'s columns; which weakness stands at a place is the model's own."""
    return ["cvss_base", "cvss_missing", *ONE_HOT, *[f"cwe_place_{i}" for i in range(top)], "cwe_other", "vendor_kev_rate", "product_kev_rate", *REFERENCES, "desc_len", *K.KEYWORDS, "poc_github", "poc_exploitdb"]


def matrix(rows: DataFrame, label: str, split: str, fold: str, inner: str, folds: int = K.FOLDS, top: int = K.TOP_CWES, smoothing: float = K.SMOOTHING) -> DataFrame:
    """(model, role, cve, y, x): what each model trains on (train), is measured on (validation) and has to score (score).

    A training row is scored by the one model that does not know it, every other row by
    the model of all. Nothing in x knows the label of the row itself.
    """
    train = rows.where(F.col(split) == "train")
    roles = lambda ms, role: F.transform(ms, lambda m: F.struct(m.alias("model"), F.lit(role).alias("role")))
    every, last = F.sequence(F.lit(0), F.lit(folds)), F.array(F.lit(folds))
    mine = F.when(F.col(split) == "train", F.concat(roles(models_of(F.col(fold), folds), "train"), roles(F.array(F.col(fold)), "score"))).when(F.col(split) == "validation", F.concat(roles(every, "validation"), roles(last, "score"))).otherwise(roles(last, "score"))
    out = rows.withColumn("__m", F.explode(mine)).withColumn("model", F.col("__m.model")).withColumn("role", F.col("__m.role"))
    prior = known_sums(train, [], label, fold, inner, folds).groupBy("model").agg((F.sum("s") / F.sum("n")).alias("__prior"))
    out = out.join(F.broadcast(prior), "model")
    for key in ("vendor", "product"):
        all_, held = nested_rates(train, key, label, fold, inner, folds, smoothing)
        # A known row meets its inner fold's rate, any other the rate of all, as inner fold -1.
        both = all_.select("model", key, F.lit(-1).alias("__in"), F.col("rate").alias(f"{key}_kev_rate")).unionByName(held.select("model", key, F.col(inner).alias("__in"), F.col("rate").alias(f"{key}_kev_rate")))
        out = out.withColumn("__in", F.when(F.col("role") == "train", F.col(inner)).otherwise(-1)).join(both, ["model", key, "__in"], "left").drop("__in")
    real = train.where(F.col("cwe").startswith("CWE-"))
    out = out.join(F.broadcast(frequent(real, "cwe", fold, folds, top)), ["model", "cwe"], "left")
    own = {"cvss_base": F.coalesce("cvss_base", F.lit(-1.0)), "cwe_other": F.col("place").isNull(), "vendor_kev_rate": F.coalesce("vendor_kev_rate", "__prior"), "product_kev_rate": F.coalesce("product_kev_rate", "__prior")}
    own |= {f"cwe_place_{i}": F.coalesce(F.col("place") == i, F.lit(False)) for i in range(top)} | {c: F.coalesce(F.col(c), F.lit(0)) for c in REFERENCES}
    x = F.array(*[own.get(n, F.col(n)).cast("double") for n in feature_names(top)])
    return out.select("model", "role", "cve", F.col(label).cast("int").alias("y"), x.alias("x"))
