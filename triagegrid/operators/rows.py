"""Deduplication, set comparison, enrichment and summaries of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagegrid.session import discard, persisted

STEPS = 64


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of a key the last in the given order, which must be total for a fixed result."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ranked(spark: SparkSession, df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """df with each row's place from 1 in the given order, within its group of by; order must be total for a fixed result.

    Rows are sorted by ranges of (by, order), so a large group is many tasks' work;
    counts per range and group, a row each, say where a range's numbers begin.
    """
    sorted_ = df.repartitionByRange(*[F.asc(b) for b in by], *order).sortWithinPartitions(*[F.asc(b) for b in by], *order)
    placed = persisted(spark, sorted_.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__first") + 1)
    told = base.select(F.col("__part").alias("__p"), *[F.col(b).alias(f"__b_{b}") for b in by], "__base")
    same = F.col("__part") == F.col("__p")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    return placed.join(told, same).select(*df.columns, (F.col("__at") + F.col("__base")).cast("long").alias(name))


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values; of equal counts the smaller value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def with_fallback(df: DataFrame, other: DataFrame, key: str, values: dict[str, Column | float]) -> DataFrame:
    """Left join on key; where there is no row or no value, the given default."""
    joined = df.join(other.select(key, *values), key, "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in values.items()])


def set_difference(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, side): both, missing (wanted only) or extra (found only)."""
    a, b = found.select(key).distinct().withColumn("f", F.lit(True)), wanted.select(key).distinct().withColumn("w", F.lit(True))
    side = F.when(F.col("f") & F.col("w"), "both").when(F.col("w"), "missing").otherwise("extra")
    return a.join(b, key, "full").select(key, side.alias("side"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n, density): bins of equal width from 0 on; the upper end belongs to the last."""
    width = (high - low) / bins
    number = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counts = df.where(F.col(value).between(low, high)).groupBy(*by, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("density", F.col("n") / (total * F.lit(width)))


def _value_counts(df: DataFrame, value: str, weight: str | None) -> DataFrame:
    """(v, n): how often each value occurs, without nulls, written once so that no later pass makes df again."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.withColumn("v", F.col(value).cast("double")).where("v is not null").groupBy("v").agg(n.cast("long").alias("n"))
    return persisted(df.sparkSession, counts, "values")


def _kth(counts: DataFrame, place: int, enough: int) -> float | None:
    """The value at a place of the order in which each v stands n times."""
    left, target = counts, place
    distinct, total = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not 0 <= target < total:
        return None
    while distinct > enough:
        bounds = sorted(set(left.approxQuantile("v", [i / STEPS for i in range(1, STEPS)], 0.1 / STEPS)))
        # Each value stands in one row, so every turn leaves out all but about a STEPS-th of them.
        under = lambda b: F.col("v") <= F.lit(b)
        number = F.lit(len(bounds))
        for i in range(len(bounds) - 1, -1, -1):
            number = F.when(under(bounds[i]), F.lit(i)).otherwise(number)
        for i, rows, n in sorted(tuple(r) for r in left.groupBy(number.alias("i")).agg(F.count(F.lit(1)), F.sum("n")).collect()):
            if target < n:
                low, high = (~under(bounds[i - 1]) if i else F.lit(True)), (under(bounds[i]) if i < len(bounds) else F.lit(True))
                left, distinct = left.where(low & high), rows
                break
            target -= n
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return left.withColumn("__upto", upto).where(F.col("__upto") > target).agg(F.min("v")).first()[0]


def kth_smallest(df: DataFrame, value: str, places: Sequence[int], enough: int = 200_000) -> list[float | None]:
    """The values at the given places (from 0) of the column's order without nulls; null where there is none.

    One pass over df counts each value. In these counts the range that holds a place
    is narrowed by approximate quantiles, which sends a few numbers back, until at most `enough` values are left in it.
    """
    counts = _value_counts(df, value, None)
    out = [_kth(counts, place, enough) for place in places]
    discard(df.sparkSession, counts)
    return out


def exact_median(df: DataFrame, value: str, weight: str | None = None, enough: int = 200_000) -> float | None:
    """The middle value, or the mean of the two, without nulls; null of nothing. weight: how often a row's value counts. See kth_smallest."""
    counts = _value_counts(df, value, weight)
    n = counts.agg(F.sum("n")).first()[0] or 0
    found = [_kth(counts, place, enough) for place in sorted({(n - 1) // 2, n // 2})]
    discard(df.sparkSession, counts)
    return None if not n else sum(found) / len(found)  # type: ignore[arg-type]
