"""Writers of documents, feature collections, sheets and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header of the review sheet.
REVIEW = ("spot", "slug", "date", "wave_height_m", "wave_direction_deg", "wave_period_s", "swell_height_m", "swell_direction_deg", "swell_period_s", "wind_speed_kmh", "wind_direction_deg", "wind_gusts_kmh", "observation_label", "notes")


def as_json(*columns: Column | str) -> Column:
    """JSON text that keeps nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a row, nulls kept; as many files as partitions."""
    df.select(as_json(*df.columns).alias("value")).write.mode("overwrite").text(path)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """A folder of documents for each key; rows of a key are dealt together first."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).option("ignoreNullFields", False).json(path)


def feature(properties: list[str], x: str, y: str) -> Column:
    """A point feature of a row."""
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"),
    )


def write_features(df: DataFrame, path: str, properties: list[str], x: str, y: str) -> None:
    """Newline-delimited features: a collection of any size, written in parallel."""
    df.select(as_json(feature(properties, x, y).alias("f")).alias("v")).select(F.get_json_object("v", "$.f").alias("value")).write.mode("overwrite").text(path)


def write_review(df: DataFrame, path: str) -> None:
    """Review sheet with the fixed header; columns that are missing are empty."""
    have = set(df.columns)
    df.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in REVIEW)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def run_row(spark: SparkSession, run_id: str, script: str, parameters: dict[str, str], summary: dict[str, str], code_version: str | None = None) -> DataFrame:
    """One row of provenance; times are the caller's, so that reruns can agree."""
    schema = "run_id string, script string, code_version string, parameters map<string,string>, summary map<string,string>"
    return spark.createDataFrame([(run_id, script, code_version, parameters, summary)], schema)


def empty_view(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def empty_summary(detections: DataFrame, quality: float = 0.0) -> DataFrame:
    """The run summary of the given rows, all zeros when there are none."""
    from tidemark.operators.views import run_summary

    return run_summary(detections, []).na.fill(quality)


def publishable(galleries: DataFrame, left_out: tuple[str, ...] = ()) -> DataFrame:
    """Galleries for the site: some places left out, paths below the site's root."""
    from tidemark.operators.views import web_path

    shown = galleries.where(~F.col("slug").isin(*left_out))
    return shown.withColumn("scenes", F.transform("scenes", lambda s: s.withField("rgb_path", web_path(s["rgb_path"]))))


def with_annotation_counts(galleries: DataFrame) -> DataFrame:
    """Galleries with the number of scenes that have an annotated picture."""
    has = F.filter("scenes", lambda s: s["annotated_rgb_path"].isNotNull())
    return galleries.withColumns({"annotated_count": F.size(has), "has_annotations": F.exists("scenes", lambda s: s["annotated_rgb_path"].isNotNull())})
