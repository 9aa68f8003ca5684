"""Time series: as-of and nearest joins, hourly lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_in_day(readings: DataFrame, keys: list[str], ts: str, value: str, hour: int = 15, reach_s: int = 3600, tie: str | None = None) -> DataFrame:
    """Per key and day: the reading nearest to ``hour`` within ``reach_s``, the earliest of those
    as many whole seconds away, and the range of the day's readings in reach, which ends at
    the microsecond."""
    centre = F.date_trunc("day", ts).cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS")
    off = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(centre))
    rows = readings.withColumns({"day": F.to_date(ts), "off_s": F.floor(off / 1_000_000)}).where(off <= reach_s * 1_000_000)
    order = F.struct("off_s", ts, *([tie] if tie else []))
    return rows.groupBy(*keys, "day").agg(
        F.count("*").alias("n"),
        F.min_by(value, order).alias(value),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )


def tide_state(value: Column, low: Column, high: Column, n: Column, margin: float = 0.3) -> Column:
    """High or low if further than ``margin`` of the half range from the middle; unknown below two readings."""
    middle = (low + high) / 2
    return F.when(n < 2, "unknown").when(value > middle + (high - middle) * margin, "high").when(value < middle - (middle - low) * margin, "low").otherwise("mid")


def asof_best(targets: DataFrame, candidates: DataFrame, target_day: str, ts: str, days: int, order: list[str], keep: list[str]) -> DataFrame:
    """For each target day, the best candidate with ts in [day - days, day + days).

    Candidates are dealt into the days they can serve, so the join is on equality
    and spreads over days, never a comparison of all pairs."""
    day = F.to_date(ts)
    served = candidates.withColumn("__day", F.explode(F.sequence(F.date_add(day, 1 - days), F.date_add(day, days))))
    served = served.groupBy("__day").agg(F.min(F.struct(*order, *keep)).alias("best"))
    return targets.join(served, F.col(target_day) == F.col("__day")).select(*targets.columns, *(F.col(f"best.{c}") for c in dict.fromkeys([*order, *keep])))


def at_hour(values: Column, hour: int) -> Column:
    """Element ``hour`` of a daily series, the last one if it is shorter, null if empty."""
    return F.get(values, F.least(F.lit(hour), F.size(values) - 1))


def monthly_ranges(dates: DataFrame, keys: list[str], day: str) -> DataFrame:
    """First and last date of each month: what one request has to fetch."""
    return dates.groupBy(*keys, F.date_format(day, "yyyy-MM").alias("month")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(day).alias("n_days"))


def request_batches(days: DataFrame, place: str, day: str, today: Column, lag: int = 5) -> DataFrame:
    """(place, source, month, first_day, last_day, n_days): one request for each place, source and
    month. Days before ``today`` less ``lag`` days come from the archive, others from the forecast."""
    source = F.when(F.col(day) < F.date_sub(today, lag), "archive").otherwise("forecast")
    rows = days.where(F.col(day).isNotNull()).select(place, source.alias("source"), F.date_format(day, "yyyy-MM").alias("month"), day)
    return rows.groupBy(place, "source", "month").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(day).alias("n_days"))
