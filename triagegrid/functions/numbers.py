"""Rounding, ceilings and tiers as Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagegrid import constants as K


def half_up(x: Column, digits: int) -> Column:
    """Halves rounded up on the binary value: floor(x * 10**digits + 0.5) / 10**digits."""
    f = float(10**digits)
    return F.floor(x * F.lit(f) + F.lit(0.5)).cast("double") / F.lit(f)


def soft_ceiling(raw: Column) -> Column:
    """Values above CEILING_START bend so that they stay under 100."""
    span = 100.0 - K.CEILING_START
    return F.when(raw <= K.CEILING_START, raw).otherwise(F.lit(100.0) - F.lit(span) * F.exp(-(raw - K.CEILING_START) / F.lit(span)))


def risk_tier(score: Column) -> Column:
    out = F.lit("Low")
    for name, least in reversed(K.RISK_TIERS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0))))


def or_zero(x: Column) -> Column:
    """Null and NaN as 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def half_even(value: Column, digits: int) -> Column:
    """Rounding to digits places, ties to even, by what the double is exactly and not by its shortest spelling: 2.675 is below the tie.

    A product of doubles and its error are two doubles, so up to 2**51 the place of
    size * 10**digits between two whole numbers is known exactly. Larger ones go by decimals: a double is
    m / 2**s with whole m and s, m * 10**digits and 2**s fit a decimal of 38 digits
    for up to 5 places, so quotient and rest are exact; smaller values are 0, the largest ones whole.
    """
    if not 0 <= digits <= 5:
        raise ValueError("0 to 5 places")
    x = value.cast("double")
    size = F.abs(x)
    f = F.lit(float(10**digits))
    product = size * f
    # Dekker's product: both factors in halves, whose products are exact. The power of ten is its own upper half.
    upper = size * F.lit(134217729.0) - (size * F.lit(134217729.0) - size)
    error = (upper * f - product) + (size - upper) * f
    below = F.floor(product).cast("double")
    over = (product - below) - F.lit(0.5)
    more = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (F.pmod(below, F.lit(2.0)) == 1))))
    near = (below + more.cast("double")) / f
    # 2**52 <= m < 2**53, whatever the logarithm rounds to.
    e = F.floor(F.log2(size)).cast("int")
    e = F.when(F.pow(F.lit(2.0), e) > size, e - 1).when(F.pow(F.lit(2.0), e + 1) <= size, e + 1).otherwise(e)
    s = F.lit(52) - e
    m = (size * F.pow(F.lit(2.0), s)).cast("bigint").cast("decimal(16,0)")
    powers = F.array(*[F.lit(Decimal(2**i)).cast("decimal(38,0)") for i in range(91)])
    whole = F.get(powers, s)
    top = (m * F.lit(Decimal(10**digits)).cast("decimal(6,0)")).cast("decimal(38,0)")
    rest = top % whole
    low = ((top - rest) / whole).cast("decimal(22,0)")
    twice = rest + rest
    up = (twice > whole) | ((twice == whole) & (low % 2 == 1))
    far = ((low + up.cast("int")).cast("decimal(23,0)") * F.lit(Decimal(10) ** -digits)).cast("double")
    number = F.when(product < F.lit(float(1 << 51)), near).otherwise(far)
    signed = F.when(x < 0, -number).otherwise(number)
    return F.when(x.isNull() | F.isnan(x) | (size >= F.lit(float(1 << 52))), x).when(size < F.lit(10.0**-digits / 4), x * 0.0).otherwise(signed)
