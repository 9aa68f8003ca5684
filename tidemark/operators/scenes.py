"""Scenes: aggregation, representative choice, comparison by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rounding import rounded

MIN_WATER, LONG_PERIOD = 50, 8.0


def scene_foam(detections: DataFrame, keys: list[str], order: Column | str, min_water: int = MIN_WATER) -> DataFrame:
    """Foam of each scene over reliable rows; swell, period, direction and quality of its first row of all.

    ``order`` is unique and of a numeric type, so that all aggregates are hash aggregates. Rows
    are counted by scene and foam first; the median is found on these counts: foam
    fractions have four places, so that a scene has 10,001 of them at most, however many rows."""
    reliable = F.coalesce("water_pixel_count", F.lit(0)) >= min_water
    firsts = ("swell_height_m", "swell_period_s", "swell_direction_deg", "quality_score")
    rows = detections.withColumns({"__foam": F.when(reliable, F.col("foam_fraction")), "__order": F.col(order) if isinstance(order, str) else order})
    counts = rows.groupBy(*keys, "__foam").agg(F.count("*").alias("__n"), *(F.min_by(c, "__order").alias(c) for c in firsts), F.min("__order").alias("__order"))
    counts = counts.withColumn("__valid", F.when(F.col("__foam").isNotNull(), F.col("__n")).otherwise(F.lit(0)))
    scene = Window.partitionBy(*keys)
    upto = scene.orderBy("__foam").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({"__upto": F.sum("__valid").over(upto), "__middle": F.floor(F.sum("__valid").over(scene) / 2)})
    at_middle = (F.col("__upto") > F.col("__middle")) & (F.col("__upto") - F.col("__valid") <= F.col("__middle"))
    first = {c: F.min_by(c, "__order") for c in firsts}
    agg = placed.groupBy(*keys).agg(
        F.sum("__n").alias("segment_count"),
        F.sum("__valid").alias("valid_segments"),
        F.round(F.max("__foam"), 4).alias("max_foam"),
        rounded(F.sum(F.col("__foam") * F.col("__valid")) / F.sum("__valid"), 4).alias("mean_foam"),
        F.max(F.when(at_middle, F.col("__foam"))).alias("median_foam"),
        first["swell_height_m"].alias("swell_height_m"),
        F.coalesce(F.nullif(first["swell_period_s"], F.lit(0.0)), F.lit(8.0)).alias("swell_period_s"),
        first["swell_direction_deg"].alias("swell_direction_deg"),
        F.coalesce(first["quality_score"], F.lit(0.0)).alias("quality_score"),
    )
    return agg.where("valid_segments > 0 and swell_height_m is not null")


def top_in_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps n rows a task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def long_first() -> Column:
    """Orders scenes of long period before all others: a fallback pool without a second pass."""
    return F.when(F.coalesce("swell_period_s", F.lit(0.0)) >= LONG_PERIOD, 0).otherwise(1)


def compare_dates(scenes: DataFrame, spot: str, date: str) -> DataFrame:
    """One row a date: number of spots, upper median swell, and period and direction of the first spot that has a period."""
    values = F.array_sort(F.collect_list("swell_height_m"))  # at most one scene a spot
    return scenes.groupBy(date).agg(
        F.count("*").alias("n_spots"),
        F.get(values, F.floor(F.size(values) / 2).cast("int")).alias("median_swell_m"),
        F.min_by("swell_period_s", F.when(F.col("swell_period_s").isNotNull(), F.col(spot))).alias("period_s"),
        F.min_by("swell_direction_deg", F.when(F.col("swell_period_s").isNotNull(), F.col(spot))).alias("direction_deg"),
        F.array_join(F.array_sort(F.collect_list(F.col(spot).cast("string"))), ",").alias("spots"),
    )


def in_reading_order(name: str, locale: str = "UNICODE") -> Column:
    """Names of a group joined by commas, in the order of a locale's collation: accents and case
    come after the letters, unlike their bytes. A group is the spots of one date."""
    ordered = F.array_sort(F.transform(F.collect_list(name), lambda n: F.collate(n, locale)))
    return F.array_join(F.transform(ordered, lambda n: F.collate(n, "UTF8_BINARY")), ", ")
