"""Zonal statistics over pixel tables.

A zone is rasterised into runs (zone, row, low, high) of pixels whose centres it holds;
pixels (row, col) meet runs in strips of a row. The raster starts at (0, 0); pixel
(row, col) has its centre at ((col + 0.5) pixel, (row + 0.5) pixel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geometry, scores

# Scene classes.
NO_DATA, SHADOW, WATER, CLOUDS, SNOW = 0, 3, 6, (8, 9, 10), 11
BRIGHT = 800


def water(scl: str = "scl"):
    return F.col(scl).isin(WATER, SHADOW)


def scene_quality(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Cloud, shadow, valid and snow shares and the composite quality: one pass."""
    scl = F.col("scl")
    n = F.count("*")
    land = F.count(F.when(~scl.isin(NO_DATA, WATER), 1))
    out = pixels.groupBy(*keys).agg(
        n.alias("n_pixels"),
        (F.count(F.when(scl.isin(*CLOUDS), 1)) / n).alias("cloud"),
        (F.count(F.when(scl == SHADOW, 1)) / n).alias("shadow"),
        (F.count(F.when(scl != NO_DATA, 1)) / n).alias("valid"),
        F.coalesce(F.count(F.when(scl == SNOW, 1)) / F.when(land > 0, land), F.lit(0.0)).alias("snow_land"),
    )
    return out.withColumn("quality_score", scores.scene_quality(F.col("cloud"), F.col("valid"), F.col("snow_land"), F.col("shadow")))


def class_histogram(pixels: DataFrame, keys: list[str], classes: tuple[int, ...]) -> DataFrame:
    """One column for each class with its number of pixels."""
    return pixels.groupBy(*keys).agg(*(F.count(F.when(F.col("scl") == c, 1)).alias(f"scl_{c}") for c in classes))


def zonal_foam(pixels: DataFrame, keys: list[str], bright: int = BRIGHT) -> DataFrame:
    """Brightness and foam over the water pixels of each zone; zones without water go."""
    b8 = F.when(water(), F.col("b8"))
    out = pixels.groupBy(*keys).agg(
        F.count("*").alias("total_buffer_pixels"),
        F.count(b8).alias("water_pixel_count"),
        F.count(F.when(b8 > bright, 1)).alias("foam_pixel_count"),
        F.avg(b8).alias("mean_nir"),
        F.max(b8).alias("max_nir"),
    ).where("water_pixel_count > 0")
    foam = F.col("foam_pixel_count")
    return out.withColumns({"foam_fraction": foam / F.col("water_pixel_count"), "foam_extent_m": foam * 100 / F.lit(200)})


def buffer_runs(edge_table: DataFrame, zone: str, facing: str, reach: float, pixel: float, inner: float = 0.5) -> DataFrame:
    """(zone, row, low, high): the seaward buffer of each line as runs of pixels: within ``reach`` of
    the line and further than ``inner`` of it from the line moved landward by ``reach``.

    ``facing`` is the line's bearing towards the sea, in ``edge_table``. An edge covers one
    interval of a row; where intervals of the line are open and none of the moved
    line is, a run goes on. The largest group is one row of one line."""
    dx, dy = (f(F.radians(F.col(facing) + 180)) * reach for f in (F.sin, F.cos))
    ends = list(map(F.col, ("ax", "ay", "bx", "by")))
    sides = F.array(
        F.struct(*(c.alias(n) for c, n in zip(ends, "pqrs", strict=True)), F.lit(reach).alias("reach"), F.lit(1).alias("full"), F.lit(0).alias("land")),
        F.struct(*(c.alias(n) for c, n in zip((ends[0] + dx, ends[1] + dy, ends[2] + dx, ends[3] + dy), "pqrs", strict=True)), F.lit(reach * inner).alias("reach"), F.lit(0).alias("full"), F.lit(1).alias("land")),
    )
    both = edge_table.select(zone, F.explode(sides).alias("e")).select(zone, "e.*")
    first = F.ceil((F.least("q", "s") - F.col("reach")) / pixel - 0.5)
    last = F.floor((F.greatest("q", "s") + F.col("reach")) / pixel - 0.5)
    rows = both.withColumns({"first": first, "last": last}).where("first <= last").withColumn("row", F.explode(F.sequence("first", "last")))
    low, high = geometry.capsule_span((F.col("row") + 0.5) * pixel, *map(F.col, "pqrs"), F.col("reach"))
    spans = rows.select(zone, "row", F.ceil(low / pixel - 0.5).alias("low"), F.floor(high / pixel - 0.5).alias("high"), "full", "land").where("low <= high")
    turns = F.array(F.struct(F.col("low").alias("at"), F.col("full"), F.col("land")), F.struct((F.col("high") + 1).alias("at"), (-F.col("full")).alias("full"), (-F.col("land")).alias("land")))
    turned = spans.select(zone, "row", F.explode(turns).alias("t")).groupBy(zone, "row", "t.at").agg(F.sum("t.full").alias("full"), F.sum("t.land").alias("land"))
    along = Window.partitionBy(zone, "row").orderBy("at")
    open_ = turned.select(zone, "row", "at", F.sum("full").over(along).alias("full"), F.sum("land").over(along).alias("land"), F.lead("at").over(along).alias("next"))
    return open_.where("full > 0 and land = 0").select(zone, "row", F.col("at").alias("low"), (F.col("next") - 1).alias("high"))


def polygon_runs(edge_table: DataFrame, zone: str, pixel: float) -> DataFrame:
    """(zone, row, low, high) of the polygons whose rings' edges are given, by the even-odd rule:
    holes are rings of their own. Each pair of crossings of a row bounds a run."""
    first = F.ceil(F.least("ay", "by") / pixel - 0.5)
    last = F.ceil(F.greatest("ay", "by") / pixel - 0.5) - 1  # a vertex belongs to the edge above it
    rows = edge_table.select(zone, "ax", "ay", "bx", "by", first.alias("first"), last.alias("last")).where("first <= last").withColumn("row", F.explode(F.sequence("first", "last")))
    y = (F.col("row") + 0.5) * pixel
    cut = rows.select(zone, "row", (F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))).alias("x"))
    along = Window.partitionBy(zone, "row").orderBy("x")
    paired = cut.select(zone, "row", "x", F.lead("x").over(along).alias("next"), F.row_number().over(along).alias("k")).where("k % 2 = 1")
    return paired.select(zone, "row", F.ceil(F.col("x") / pixel - 0.5).alias("low"), (F.ceil(F.col("next") / pixel - 0.5) - 1).alias("high")).where("low <= high")


def in_runs(pixels: DataFrame, runs: DataFrame, strip: int = 64) -> DataFrame:
    """Each pixel (row, col) with each run that holds it, met on strips of ``strip`` columns."""
    span = F.sequence(F.floor(F.col("low") / strip), F.floor(F.col("high") / strip))
    dealt = runs.withColumn("__strip", F.explode(span))
    met = pixels.withColumn("__strip", F.floor(F.col("col") / strip)).join(dealt, ["row", "__strip"])
    return met.where("col between low and high").drop("__strip", "low", "high")


def zonal_join(pixels: DataFrame, runs: DataFrame, scene: str, zone: str, bright: int = BRIGHT) -> DataFrame:
    """Brightness and foam over the water pixels (row, col, scl, b8) of each pair of a scene and
    a zone that have any; all zones of all scenes at once, combined before the shuffle."""
    found = in_runs(pixels.where(water()).select(scene, "row", "col", "b8"), runs)
    out = found.groupBy(scene, zone).agg(
        F.count("*").alias("water_pixel_count"),
        F.count(F.when(F.col("b8") > bright, 1)).alias("foam_pixel_count"),
        F.avg("b8").alias("mean_nir"),
        F.max("b8").alias("max_nir"),
    )
    foam = F.col("foam_pixel_count")
    return out.withColumns({"foam_fraction": foam / F.col("water_pixel_count"), "foam_extent_m": foam * 100 / F.lit(200), "total_buffer_pixels": F.col("water_pixel_count")})
