"""Response profiles by condition bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.rounding import rounded

TURN_ON, BLOW_OUT, OPTIMAL, RESPONSIVE = 0.05, 0.80, 0.15, 0.05
MIN_OBSERVATIONS = 3


def valid(detections: DataFrame) -> DataFrame:
    """Rows with both swell and foam."""
    return detections.where("swell_height_m is not null and foam_fraction is not null")


def response(detections: DataFrame, keys: list[str], min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """Turn-on, blow-out and foam statistics of each key: one hash aggregate."""
    swell, foam = F.col("swell_height_m"), F.col("foam_fraction")
    out = valid(detections).groupBy(*keys).agg(
        F.count("*").alias("observation_count"),
        F.round(F.min(F.when(foam > TURN_ON, swell)), 2).alias("turn_on_threshold_m"),
        F.round(F.min(F.when(foam > BLOW_OUT, swell)), 2).alias("blow_out_point_m"),
        rounded(F.avg(foam), 4).alias("mean_foam"),
        F.round(F.max(foam), 4).alias("max_foam"),
        F.round(F.stddev_pop(foam), 4).alias("std_foam"),
    )
    enough = F.col("observation_count") >= min_observations
    return out.withColumn("status", F.when(enough, "complete").otherwise("insufficient_data"))


def bins(detections: DataFrame, keys: list[str], label: Column, position: Column, name: str = "bin") -> DataFrame:
    """Mean foam and count of each key and bin; ``position`` orders the bins."""
    rows = valid(detections).select(*keys, "foam_fraction", label.alias(name), position.alias("position"))
    return rows.groupBy(*keys, name, "position").agg(F.avg("foam_fraction").alias("mean_foam"), F.count("*").alias("n"))


def swell_bins(detections: DataFrame, keys: list[str]) -> DataFrame:
    height = F.col("swell_height_m")
    edges = labels.SWELL_EDGES
    position = sum((F.when(height >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0))
    return bins(detections, keys, labels.swell_bin(height), position)


def direction_bins(detections: DataFrame, keys: list[str]) -> DataFrame:
    direction = F.col("swell_direction_deg")
    known = detections.where("swell_direction_deg is not null")
    return bins(known, keys, labels.sector(direction), F.floor(F.pmod(direction, F.lit(360.0)) / 45).cast("int"), "sector")


def best_bin(binned: DataFrame, keys: list[str], name: str = "bin", digits: int | None = 4, min_n: int = 2) -> DataFrame:
    """Bin of the largest mean (rounded, if ``digits``) above 0; the first bin on ties, null if there is none."""
    mean = rounded("mean_foam", digits) if digits is not None else F.col("mean_foam")
    good = (F.col("n") >= min_n) & (mean > 0)
    return binned.groupBy(*keys).agg(
        F.max_by(name, F.when(good, F.struct(mean, -F.col("position")))).alias(f"best_{name}"),
        F.max(F.when(good, rounded("mean_foam", 4))).alias("best_mean"),
    )


def optimal_range(binned: DataFrame, keys: list[str], threshold: float = OPTIMAL, min_n: int = 2) -> DataFrame:
    """Lowest and highest edge of the bins whose rounded mean is above the threshold."""
    edges = labels.SWELL_EDGES
    edge = lambda shift: F.element_at(F.array(*map(F.lit, (*edges, None))), F.col("position") + 1 + shift)
    good = (F.col("n") >= min_n) & (rounded("mean_foam", 4) > threshold)
    return binned.groupBy(*keys).agg(F.min(F.when(good, edge(0))).alias("optimal_min_m"), F.max(F.when(good, edge(1))).alias("optimal_max_m"))


def responsive_sectors(binned: DataFrame, keys: list[str], threshold: float = RESPONSIVE, min_n: int = 2) -> DataFrame:
    """Number of sectors whose rounded mean is above the threshold, and their list in order."""
    good = (F.col("n") >= min_n) & (rounded("mean_foam", 4) > threshold)
    chosen = F.collect_list(F.when(good, F.struct("position", "sector")))
    return binned.groupBy(*keys).agg(F.count(F.when(good, 1)).alias("n_responsive"), F.array_join(F.transform(F.array_sort(chosen), lambda x: x["sector"]), ",").alias("responsive"))


def spot_profile(binned_segments: DataFrame, spot: str, name: str = "bin") -> DataFrame:
    """Unweighted mean, over the segments of a spot, of their bin means."""
    return binned_segments.groupBy(spot, name).agg(rounded(F.avg(rounded("mean_foam", 4)), 4).alias("mean_of_means"), F.sum("n").alias("n"))


def component(detections: DataFrame, keys: list[str], extra: list[Column] = ()) -> DataFrame:
    """Everything a profile score needs, in one aggregate and so one shuffle.

    Bins and sectors are few and fixed, so their sums and counts are columns of
    the aggregate and are combined before the shuffle, instead of two further
    aggregates by (key, bin) and (key, sector). ``extra`` aggregates ride along.
    Adds observation_count, has_turn_on, has_optimal and n_responsive."""
    swell, foam, direction = F.col("swell_height_m"), F.col("foam_fraction"), F.col("swell_direction_deg")
    known = swell.isNotNull() & foam.isNotNull()
    edges = labels.SWELL_EDGES
    in_bin = [known & (swell >= lo) & ((swell < hi) if hi is not None else F.lit(True)) for lo, hi in zip(edges, (*edges[1:], None), strict=True)]
    turn = F.floor(F.pmod(direction, F.lit(360.0)) / 45)
    in_sector = [known & (turn == k) for k in range(len(labels.SECTORS))]
    sums = {f"__{kind}{i}": c for kind, cs in (("b", in_bin), ("s", in_sector)) for i, c in enumerate(cs)}
    agg = detections.groupBy(*keys).agg(
        *extra,
        F.count(F.when(known, 1)).alias("observation_count"),
        F.coalesce(F.bool_or(known & (foam > TURN_ON)), F.lit(False)).alias("has_turn_on"),
        *(F.sum(F.when(c, foam)).alias(f"{n}_sum") for n, c in sums.items()),
        *(F.count(F.when(c, 1)).alias(f"{n}_n") for n, c in sums.items()),
    )

    def above(names: list[str], threshold: float) -> Column:
        good = lambda n: (F.col(f"{n}_n") >= 2) & (rounded(F.col(f"{n}_sum") / F.col(f"{n}_n"), 4) > threshold)
        return sum((F.when(good(n), 1).otherwise(0) for n in names), F.lit(0))

    bins_above = above([n for n in sums if n.startswith("__b")], OPTIMAL)
    sectors_above = above([n for n in sums if n.startswith("__s")], RESPONSIVE)
    out = agg.withColumns({"has_optimal": bins_above > 0, "n_responsive": sectors_above})
    return out.drop(*(c for c in agg.columns if c.startswith("__")))
