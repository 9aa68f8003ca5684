"""Rounding that does not depend on the order in which a sum was taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUDGE = 1e-9


def rounded(value: Column | str, digits: int) -> Column:
    """Round half up; values within NUDGE below a half count as the half."""
    return F.round((F.col(value) if isinstance(value, str) else value) + NUDGE, digits)


def exact_mean(value: Column | str, places: int) -> Column:
    """Mean of values of at most ``places`` decimal places (below 10 million), summed as decimals: a mean
    that lies on a half is rounded up whatever the order of the rows. Round it before it is cast."""
    exact = (F.col(value) if isinstance(value, str) else value).cast(f"decimal({7 + places},{places})")
    return F.sum(exact) / F.count(exact)


def mean_rounded(value: Column | str, places: int, digits: int) -> Column:
    return F.round(exact_mean(value, places), digits).cast("double")


def _split(x: Column) -> tuple[Column, Column]:
    """Upper and lower half of a double's bits, whose sum it is."""
    scaled = x * 134_217_729.0
    high = scaled - (scaled - x)
    return high, x - high


def binary_rounded(value: Column, digits: int) -> Column:
    """Round the exact binary value, as printing with ``digits`` places does: 0.0435 lies
    below the half and goes to 0.043, whatever its shortest decimal form says."""
    scale, size = 10.0**digits, F.abs(value)
    product = size * scale
    (a, b), (c, d) = _split(size), _split(F.lit(scale))
    error = ((a * c - product) + a * d + b * c) + b * d  # what the product lost to rounding
    low = F.floor(product)
    up = F.when(product - low != 0.5, product - low > 0.5).when(error != 0, error > 0).otherwise(low % 2 != 0)
    out = (low + F.when(up, 1).otherwise(0)) / scale
    return F.when(value < 0, -out).otherwise(out)
