"""Smoothed rates of a label by key, also out of fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid import constants as K


def rate_table(df: DataFrame, key: str, label: str, smoothing: float = K.SMOOTHING) -> DataFrame:
    """(key, rate): (sum of labels + smoothing * prior) / (rows + smoothing), the prior being the mean label."""
    prior = df.agg(F.avg(F.col(label).cast("double")).alias("prior"))
    sums = df.groupBy(key).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    rate = (F.col("s") + F.lit(smoothing) * F.col("prior")) / (F.col("n") + F.lit(smoothing))
    return sums.crossJoin(F.broadcast(prior)).select(key, rate.alias("rate"))


def fold_of(key: Column, folds: int = K.FOLDS, seed: int = 42) -> Column:
    """A row's fold from a hash of its key, alike wherever the row lies."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def out_of_fold_rates(df: DataFrame, key: str, label: str, fold: str, smoothing: float = K.SMOOTHING) -> DataFrame:
    """(key, fold, rate): the smoothed rate of the other folds' rows, with their prior; the prior of all where they have none.

    One pass: sums by key and fold, taken from the sums by key.
    """
    y = F.col(label).cast("double")
    cell = df.groupBy(key, fold).agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n"))
    by_key = cell.groupBy(key).agg(F.sum("s").alias("ks"), F.sum("n").alias("kn"))
    by_fold = cell.groupBy(fold).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    total = cell.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    all_ = cell.join(by_key, key).join(F.broadcast(by_fold), fold).crossJoin(F.broadcast(total))
    others = (F.col("ts") - F.col("fs")) / (F.col("tn") - F.col("fn"))
    rate = (F.col("ks") - F.col("s") + F.lit(smoothing) * others) / (F.col("kn") - F.col("n") + F.lit(smoothing))
    return all_.select(key, fold, F.when(F.col("kn") > F.col("n"), rate).otherwise(F.col("ts") / F.col("tn")).alias("rate"))
