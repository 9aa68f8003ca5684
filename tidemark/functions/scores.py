"""Scores as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WATER_DENSITY, GRAVITY = 1025.0, 9.81
MOST = (35.0, 40.0, 25.0)


def wave_power(height: Column, period: Column) -> Column:
    """Energy flux of a wave; a period of null or 0 counts as 8 s."""
    t = F.coalesce(F.when(period != 0, period), F.lit(8.0))
    return WATER_DENSITY * GRAVITY**2 * height * height * t / (64 * math.pi)


def ndwi(green: Column, nir: Column) -> Column:
    return F.try_divide(green - nir, green + nir)


def foam_score(peak: Column, mean_in_swell: Column, consistency: Column, spread: Column) -> Column:
    one = F.lit(1.0)
    raw = 0.35 * F.least(peak / 0.5, one) + 0.30 * F.least(mean_in_swell / 0.3, one) + 0.20 * consistency + 0.15 * F.least(spread / 0.4, one)
    return raw * MOST[1]


def profile_score(has_turn_on: Column, has_optimal: Column, directions: Column, observations: Column) -> Column:
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    focus = F.when(directions > 0, F.greatest(F.lit(0.0), 1 - directions / 8)).otherwise(0.0)
    return (0.25 * flag(has_turn_on) + 0.25 * flag(has_optimal) + 0.25 * focus + 0.25 * F.least(observations / 30, F.lit(1.0))) * MOST[2]


def composite(geometry_total: Column, foam: Column, profile: Column, weights: tuple[float, float, float] = (0.35, 0.40, 0.25), penalty: Column | None = None) -> Column:
    """Weighted share of what the available components could reach, 0 to 100.

    ``foam`` and ``profile`` are null where not available."""
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    parts = (geometry_total * (MOST[0] / 100), foam, profile)
    got = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in zip(parts, weights, strict=True)), F.lit(0.0))
    most = sum((F.when(c.isNotNull(), w * m).otherwise(0.0) for c, w, m in zip(parts, weights, MOST, strict=True)), F.lit(0.0))
    score = 100 * got / F.when(most > 0, most)
    if penalty is not None:
        score = F.when(penalty > 0, F.greatest(F.lit(0.0), score - penalty)).otherwise(score)
    return F.coalesce(score, F.lit(0.0))


def scene_quality(cloud: Column, valid: Column, snow: Column, shadow: Column) -> Column:
    one = F.lit(1.0)
    return 40 * (1 - F.least(cloud, one)) + 30 * F.least(valid, one) + 20 * (1 - F.least(snow, one)) + 10 * (1 - F.least(shadow, one))
