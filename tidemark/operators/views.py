"""Serving views and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it does not have."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def best_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    from tidemark.operators.scenes import top_in_group

    return top_in_group(df, [key], order)


def dates_in(text: Column) -> Column:
    """ISO dates written in a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))


def is_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text).isNotNull(), F.lit(False))


def web_path(path: Column) -> Column:
    """Path below the site's root; null stays null."""
    return F.regexp_replace(path, r"^data/", "/")


def annotated_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(\w+)$", "_annotated.$1")


def run_summary(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a run; a missing quality counts as 0 in the tiers and not at all in the mean."""
    quality = F.coalesce("quality_score", F.lit(0.0))
    out = detections.groupBy(*keys) if keys else detections
    return out.agg(
        F.count("*").alias("total_detections"),
        F.countDistinct("scene_date").alias("scenes"),
        F.countDistinct(F.when(F.col("foam_fraction") > 0.05, F.col("scene_date"))).alias("scenes_with_foam"),
        F.count(F.when(quality >= 80, 1)).alias("high_quality"),
        F.count(F.when(quality >= 60, 1)).alias("usable"),
        F.count(F.when(quality < 40, 1)).alias("discarded"),
        F.round(F.avg("quality_score"), 3).alias("mean_quality"),
    )


def section_config(sections: DataFrame) -> DataFrame:
    """Flat section rows as nested configurations."""
    return sections.select(
        F.concat(F.lit("Section "), F.col("section_id")).alias("name"),
        F.col("section_id").alias("slug"),
        F.array("west", "south", "east", "north").alias("bbox"),
        F.struct(F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon")).alias("point"),
        F.struct("mean_score", "max_score", "segment_count", F.split("segment_ids", ",").alias("segment_ids")).alias("atlas_metadata"),
    )


def breaks_or_point(configs: DataFrame) -> DataFrame:
    """One row for each break; a place without breaks is its own point."""
    own = F.array(F.struct(F.col("name"), F.col("point.lat").alias("lat"), F.col("point.lon").alias("lon")))
    listed = F.transform("breaks", lambda b: F.struct(b["name"].alias("name"), b["lat"].alias("lat"), b["lon"].alias("lon")))
    return configs.select("slug", F.explode(F.when(F.size(F.coalesce("breaks", F.array())) > 0, listed).otherwise(own)).alias("b")).select("slug", "b.*")


def preferred_slugs(configs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted slug the exact configuration, else the first that contains it; null if none.
    Names meet wanted ones on their substrings, by equality."""
    n = F.length("slug")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda size: F.substring(F.col("slug"), i, size))))
    held = configs.where(n > 0).select(F.col("slug").alias("found"), F.explode(F.array_distinct(parts)).alias("slug"))
    best = held.withColumn("of", F.struct((F.col("found") != F.col("slug")).alias("partial"), F.col("found")))
    pairs = wanted.distinct().join(best, "slug", "left")
    return pairs.groupBy("slug").agg(F.min(F.when(F.col("found").isNotNull(), F.col("of"))).alias("best")).select("slug", F.col("best.found").alias("found"))


def discovered(manifests: DataFrame, configs: DataFrame, slug: str) -> DataFrame:
    """``manifests`` with ``has_config``; several configs of one name count once."""
    known = configs.select(slug).where(F.col(slug).isNotNull()).distinct().withColumn("has_config", F.lit(True))
    return manifests.join(known, slug, "left").withColumn("has_config", F.coalesce("has_config", F.lit(False)))
