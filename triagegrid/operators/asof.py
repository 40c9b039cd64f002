"""What was known at a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagegrid import constants as K


def known(first: Column, at: Column) -> Column:
    return F.coalesce(first <= at, F.lit(False))


def later(first: Column, at: Column) -> Column:
    return F.coalesce(first > at, F.lit(False))


def poc_in_window(first: Column, published: Column, at: Column | None = None, days: int = K.POC_WINDOW_DAYS) -> Column:
    """1 where an exploit was public within days of publication, and by the date at if given; earlier ones count."""
    limit = published + F.expr(f"INTERVAL {days} DAYS")
    return known(first, limit if at is None else F.least(limit, at)).cast("int")


def poc_exists(first: Column, at: Column) -> Column:
    return known(first, at).cast("int")


def days_since(published: Column, at: Column) -> Column:
    return F.greatest(F.datediff(at, published), F.lit(0))


def split_of(year: Column, train: tuple[int, int] = K.TRAIN_YEARS, validation: int = K.VALIDATION_YEAR, test: int = K.TEST_YEAR) -> Column:
    """train, validation or test by year of publication; null elsewhere."""
    return F.when(year.between(*train), "train").when(year == validation, "validation").when(year == test, "test")


def frozen_split_of(published: Column, at: Column) -> Column:
    """Training rows from 2019 to two years before the date, validation the year before it."""
    y, t = F.year(published), F.year(at)
    return F.when(published >= at, None).when((y >= K.TRAIN_YEARS[0]) & (y <= t - 2), "train").when(y == t - 1, "validation")
