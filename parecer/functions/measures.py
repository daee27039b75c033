"""Column expressions for days, rates and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS_PER_DAY))


def days_truncated(later: Column, earlier: Column) -> Column:
    """Day difference cut toward zero: anything within one day is 0."""
    return _days(later, earlier).cast("int")


def days_floored(later: Column, earlier: Column) -> Column:
    """Day difference in whole days, rounded down."""
    return F.floor(_days(later, earlier)).cast("int")


NOISE_DIGITS = 12


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero. The last bits of a sum of doubles depend on the order in which
    tasks finish; they are rounded off first, so that they never decide a half."""
    return F.round(F.round(x, NOISE_DIGITS), digits)


def rounded_even(x: Column, digits: int) -> Column:
    """Half to even, without the last bits, as in ``rounded``."""
    return F.bround(F.round(x, NOISE_DIGITS), digits)


def flag(condition: Column) -> Column:
    """1 where true, else 0; null counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """part × scale / whole as double, null when whole is 0."""
    whole = whole.cast("double")
    return part.cast("double") * F.lit(scale) / F.when(whole != 0, whole)


def rate_of(condition: Column, scale: float = 100.0) -> Column:
    """Aggregate: share of all rows that meet the condition, nulls in the denominator."""
    return share(F.sum(flag(condition)), F.count(F.lit(1)), scale)


def rate_among(condition: Column, among: Column, scale: float = 100.0) -> Column:
    """Aggregate: share of the rows in ``among`` that meet the condition; null if none."""
    return share(F.sum(flag(among & condition)), F.sum(flag(among)), scale)


def cents(amount: Column) -> Column:
    """A money amount with two decimals as whole cents.

    Decimals as wide as a sum of money are objects to Spark; longs sum in generated code, at
    about three times the speed, and just as exactly. A sum over 92 quadrillion stops the job.
    """
    return F.rint(amount.cast("double") * 100).cast("long")


def from_cents(whole: Column) -> Column:
    return (whole.cast("decimal(20,0)") / 100).cast("decimal(22,2)")


def money_sum(amount: Column) -> Column:
    """Aggregate: exact sum of a money amount."""
    return from_cents(F.sum(cents(amount)))


def money_mean(amount: Column) -> Column:
    """Aggregate: mean of a money amount as double, from the exact sum."""
    return share(money_sum(amount), F.count(amount), 1.0)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null."""
    bounded = x
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(x.isNotNull(), bounded)


def delay_phrase(days: Column) -> Column:
    """Days as a phrase: early, on time, or a signed number."""
    return (
        F.when(days < 0, F.concat(F.lit("提前"), F.abs(days).cast("string"), F.lit("天")))
        .when(days == 0, F.lit("0天(准时)"))
        .otherwise(F.concat(F.lit("+"), days.cast("string"), F.lit("天")))
    )
