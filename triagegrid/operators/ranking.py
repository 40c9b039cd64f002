"""Ranking metrics as expected values under random tie-breaking, over blocks of equal scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagegrid.session import persisted


def _cut(blocks: DataFrame, by: Sequence[str], score: str, parts: int, number: str) -> DataFrame:
    """blocks with the number of the range that the score falls into, from the highest down; ranges are each ranker's own.

    Their bounds are about `parts` of the ranker's distinct scores, drawn by a
    hash, so that every run cuts alike and the ranges are of like size whatever
    the scores' distribution.
    """
    drawn = blocks.where(F.col(score) > float("-inf")).groupBy(*by, F.pmod(F.xxhash64(score), F.lit(parts)).alias("__h")).agg(F.min_by(score, F.xxhash64(score, F.lit(7))).alias("__b"))
    bounds = drawn.groupBy(*by).agg(F.collect_list("__b").alias("__bounds"))
    met = _beside(blocks, bounds, by)
    return met.withColumn(number, F.coalesce(F.size(F.filter("__bounds", lambda x: x > F.col(score))), F.lit(0))).drop("__bounds")


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with the columns of the one row of right that has its keys, null keys included; Spark chooses how to join."""
    if not keys:
        return left.join(right, F.lit(True), "left")
    named = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same &= left[k].eqNullSafe(F.col(f"__r_{k}"))
    return left.join(named, same, "left").drop(*[f"__r_{k}" for k in keys])


def running(blocks: DataFrame, by: Sequence[str], score: str, sums: dict[str, str], parts: int = 64) -> DataFrame:
    """blocks with sums over all higher scores of the same ranker: sums names the summed column of each new one.

    In two steps, so that no task sums the whole list of one ranker: within ranges
    of scores, then over the ranges' totals, which are `parts` rows and a few more.
    parts = 0 sums each ranker in one task.
    """
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    above = lambda w: w.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    if not parts:
        return blocks.select("*", *[total(c, above(Window.partitionBy(*by))).alias(n) for n, c in sums.items()])
    cut = _cut(blocks, by, score, parts, "__part")
    ranges = cut.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "__part", *[total(f"__s_{n}", w).alias(f"__b_{n}") for n in sums])
    met = _beside(cut, ranges, [*by, "__part"])
    w = above(Window.partitionBy(*by, "__part"))
    return met.select(*blocks.columns, *[(total(c, w) + F.col(f"__b_{n}")).alias(n) for n, c in sums.items()])


def tied_blocks(df: DataFrame, score: str, label: str, by: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """(by, score, g, h, before, hits_before): a row per distinct score, best first.

    g rows of which h are positive share the score; before rows, of which
    hits_before are positive, stand above it. Null and NaN scores come last, as
    minus infinity. The rows shrink to distinct scores before anything is
    ordered, and the running sums go in two steps (see running).
    """
    s = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")), F.lit(float("-inf")))
    blocks = df.groupBy(*by, s.alias("score")).agg(F.count(F.lit(1)).alias("g"), F.sum(F.coalesce(F.col(label).cast("long"), F.lit(0))).alias("h"))
    # Ranges, their sums and what comes after read the blocks; the scores behind them are computed once.
    if parts:
        blocks = persisted(df.sparkSession, blocks, "blocks")
    return running(blocks, by, "score", {"before": "g", "hits_before": "h"}, parts)


def cume_dist(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "percentile", parts: int = 64) -> DataFrame:
    """df with the share of its group's rows whose value is the same or lower; nulls stand first. Groups may be large: values are counted, then summed in two steps."""
    low = F.coalesce(-F.col(value).cast("double"), F.lit(float("inf")))
    counts = df.groupBy(*by, low.alias("__low")).agg(F.count(F.lit(1)).alias("__g"))
    # Higher is lower here: what stands above the negated value is what is lower.
    sums = running(counts, by, "__low", {"__before": "__g"}, parts)
    totals = counts.groupBy(*by).agg(F.sum("__g").alias("__n"))
    shares = _beside(sums, totals, by).select(*by, "__low", ((F.col("__before") + F.col("__g")) / F.col("__n")).alias(name))
    return _beside(df.withColumn("__low", low), shares, [*by, "__low"]).drop("__low")


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def expected_hits(k: int) -> Column:
    """Aggregate: positives expected among the first k."""
    whole = _d("before") + _d("g") <= k
    return F.sum(F.when(whole, _d("h")).when(_d("before") < k, (F.lit(float(k)) - _d("before")) * _d("h") / _d("g")).otherwise(0.0))


def rows() -> Column:
    return F.sum(_d("g"))


def positives() -> Column:
    return F.sum(_d("h"))


def precision_at(k: int) -> Column:
    return F.when(rows() > 0, expected_hits(k) / F.least(F.lit(float(k)), rows()))


def recall_at(k: int) -> Column:
    return F.when(positives() > 0, expected_hits(k) / positives())


def effort_to_cover(share: float, total: Column, hits: Column) -> Column:
    """Aggregate: part of the list to work through for a share of the positives. total and hits: columns with both sums."""
    need = F.ceil(F.lit(float(share)) * hits - 1e-12).cast("double")
    here = (_d("hits_before") < need) & (_d("hits_before") + _d("h") >= need)
    return F.min(F.when(here, (_d("before") + (need - _d("hits_before")) * (_d("g") + 1.0) / (_d("h") + 1.0)) / total))


def mean_rank() -> Column:
    return F.when(positives() > 0, F.sum(_d("h") * (_d("before") + (_d("g") + 1.0) / 2.0)) / positives())


def roc_auc() -> Column:
    p, n = positives(), rows()
    return F.when((p > 0) & (p < n), F.sum((_d("g") - _d("h")) * (_d("hits_before") + _d("h") / 2.0)) / (p * (n - p)))


def average_precision() -> Column:
    p, n = positives(), rows()
    return F.when((p > 0) & (p < n), F.sum(_d("h") * (_d("hits_before") + _d("h")) / (_d("before") + _d("g"))) / p)


def report(blocks: DataFrame, by: Sequence[str] = (), at: Sequence[int] = (100, 500), recall: Sequence[int] = (1000,), efforts: Sequence[float] = (0.9,)) -> DataFrame:
    """One row per ranker with every metric; empty rankers have no row."""
    sums = blocks.groupBy(*by).agg(rows().alias("__n"), positives().alias("__p"))
    joined = _beside(blocks, sums, by)
    aggs = [rows().cast("long").alias("n"), positives().cast("long").alias("positives"), roc_auc().alias("roc_auc"), average_precision().alias("avg_precision"), mean_rank().alias("mean_rank")]
    aggs += [effort_to_cover(f, F.col("__n"), F.col("__p")).alias(f"effort_{round(100 * f)}") for f in efforts]
    aggs += [precision_at(k).alias(f"precision_{k}") for k in at] + [recall_at(k).alias(f"recall_{k}") for k in recall]
    return joined.groupBy(*by).agg(*aggs)


def coverage_curve(blocks: DataFrame, points: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """(by, point, worked, covered): the share of positives covered by a share of the list, at points even places from 0 to 1.

    Between the ends of blocks the curve is a straight line. A grid place meets
    the one block that it falls into by the block's range of grid numbers. Lists without positives have no curve.
    """
    sums = blocks.groupBy(*by).agg(rows().alias("n"), positives().alias("p"))
    b = _beside(blocks, sums, by).where("p > 0")
    last = float(points - 1)
    x0, x1 = _d("before") / F.col("n"), (_d("before") + _d("g")) / F.col("n")
    y0, y1 = _d("hits_before") / F.col("p"), (_d("hits_before") + _d("h")) / F.col("p")
    first = F.when(F.col("before") == 0, F.lit(0)).otherwise(F.floor(x0 * last).cast("int") + 1)
    upto = F.when(_d("before") + _d("g") >= F.col("n"), F.lit(points - 1)).otherwise(F.floor(x1 * last).cast("int"))
    hit = b.select(*by, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), F.explode(F.when(first <= upto, F.sequence(first, upto)).otherwise(F.array().cast("array<int>"))).alias("i"))
    worked = F.col("i").cast("double") / last
    return hit.select(*by, F.col("i").cast("long").alias("point"), worked.alias("worked"), (F.col("y0") + (F.col("y1") - F.col("y0")) * (worked - F.col("x0")) / (F.col("x1") - F.col("x0"))).alias("covered"))


def floor_block(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, share, positives) of the rows that share the lowest score."""
    low = df.groupBy(*by).agg(F.min(score).alias("value"), F.count(F.lit(1)).alias("total"))
    at = _beside(df, low, by).where(F.col(score) <= F.col("value") + 1e-12)
    return at.groupBy(*by, "value", "total").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives")).select(*by, "value", "n", (_d("n") / _d("total")).alias("share"), "positives")
