"""Arithmetic helpers with the library's null, zero and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def safe_div(numerator, denominator, default=0.0) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``default``."""
    return F.when(_col(denominator) > 0, F.try_divide(_col(numerator), _col(denominator))).otherwise(
        F.lit(default)
    )


def percent(part, whole, default=0.0) -> Column:
    """Share in percent: the ratio first, then times 100."""
    return F.when(_col(whole) > 0, F.try_divide(_col(part), _col(whole)) * 100).otherwise(F.lit(default))


def clip(value: Column, low=None, high=None) -> Column:
    """Clamp to the bounds; NULL stays NULL (``greatest``/``least`` would skip it)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def at_least(value: Column, low) -> Column:
    return clip(value, low=low)


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding of the decimal reading of a double, as a double.

    The value is first read with four spare digits, so sums that differ only in their last binary
    digits (another order of addition) round to the same result on every run.
    """
    return F.round(value.cast(T.DecimalType(38, digits + 4)), digits).cast("double")


def round_exact(value: Column, digits: int) -> Column:
    """Rounding that judges ties on the exact binary value, ties to even (2.675 -> 2.67, 2.25 -> 2.2).

    The fraction is scaled by a power of two, which is exact, and split into a whole number and a rest, so
    the comparison with one half is exact too. Up to four digits. For row-level formulas; sums and means use
    ``round_to``, which absorbs the noise of their order.
    """
    bits = 52 if digits <= 3 else 48
    size = F.abs(value.cast("double"))
    whole = F.floor(size)
    fraction = (size - whole) * float(2**bits)
    steps = F.floor(fraction) * 10**digits
    rest = (fraction - F.floor(fraction)) * float(10**digits)
    low = whole * 10**digits + F.shiftright(steps, bits)
    gap = F.lit(2 ** (bits - 1)) - steps.bitwiseAND(F.lit(2**bits - 1))
    up = (rest > gap) | ((rest == gap) & (low.bitwiseAND(F.lit(1)) == 1))
    return F.signum(value) * (low + F.when(up, 1).otherwise(0)).cast("double") / float(10**digits)


def round_even(value: Column) -> Column:
    """Whole number, ties to even."""
    return F.bround(value.cast("double"), 0)


def truncate(value: Column) -> Column:
    """Toward zero, as a long."""
    return value.cast("bigint")
