"""What a model loses when a feature tells nothing: permutation importance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.operators import ranking, rows
from triagegrid.operators.boosting import Ensemble, _values


def shuffled(spark: SparkSession, df: DataFrame, key: str, values: str, turn: int) -> DataFrame:
    """df with `other`: the values of another row, every row's given once. Who meets whom is a hash's choice.

    Rows are numbered in two orders by hash and met by number, so no task holds all of them.
    """
    order = lambda salt: [F.xxhash64(key, F.lit(turn), F.lit(salt)), F.asc(key)]
    left = rows.ranked(spark, df, order("a"), name="__n")
    right = rows.ranked(spark, df.select(key, F.col(values).alias("other")), order("b"), name="__n").select("__n", "other")
    return left.join(right, "__n").drop("__n")


def permutation_importance(spark: SparkSession, df: DataFrame, model: Ensemble, features: Sequence[str], repeats: int = 3, key: str = "key") -> DataFrame:
    """(feature, importance): average precision on df(key, x, y) less its mean over repeats with the feature's values in another order.

    key must be unique. All features of all repeats are measured in one plan. A table
    of one class has no precision, so importance is null.
    """
    width = model.width

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, other = _values(b.column(1), width), _values(b.column(2), width)
            turn = b.column(3)
            margin = model.margin(x)
            for j in range(-1, width):
                y = margin
                if j >= 0:
                    changed = x.copy()
                    changed[:, j] = other[:, j]
                    y = model.margin(changed)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), j, np.int32)), turn, pa.array(y)], names=["y", "feature", "turn", "score"])

    parts = [shuffled(spark, df.select(key, "x", "y"), key, "x", t).select(F.col("y").cast("int").alias("y"), "x", "other", F.lit(t).alias("turn")) for t in range(repeats)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    blocks = ranking.tied_blocks(every.mapInArrow(scores, "y int, feature int, turn int, score double"), "score", "y", by=["feature", "turn"])
    each = blocks.groupBy("feature", "turn").agg(ranking.average_precision().alias("ap")).groupBy("feature").agg(F.avg("ap").alias("ap"))
    whole = each.where("feature < 0").select(F.col("ap").alias("whole"))
    name: Column = F.get(F.array(*map(F.lit, features)), F.col("feature"))
    return each.where("feature >= 0").join(whole, F.lit(True)).select(name.alias("feature"), (F.col("whole") - F.col("ap")).alias("importance"))
