"""Readers of JSON documents, feature collections, manifests and hourly series.

Schemas are declared, never inferred: readers do not pass over the data twice,
and a missing field is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields of the stored documents.
SPOT = "name string, slug string, region string, bbox array<double>, point struct<lat:double,lon:double>, breaks array<struct<name:string,lat:double,lon:double,type:string>>, date_range struct<start:string>, export struct<drive_folder:string>"
ATLAS = SPOT + ", atlas_metadata struct<mean_score:double,max_score:double,segment_count:int,segment_ids:array<string>,coastline_length_m:double>"
SEGMENT = "segment_id:string,centroid_lat:double,centroid_lon:double,orientation_deg:double,shore_bearing_deg:double,exposure_arc_deg:double,length_m:double,total_score:double"
DETECTION = "segment_id string, date string, swell_height_m double, swell_period_s double, swell_direction_deg double, wave_height_m double, cloud_pct double, shadow_pct double, snow_land_pct double, valid_pct double, quality_score double, foam_fraction double, foam_extent_m double, mean_nir double, max_nir double, water_pixel_count long, foam_pixel_count long, total_buffer_pixels long"
PROFILE = "status:string,observation_count:long,turn_on_threshold_m:double,blow_out_point_m:double,primary_direction:string,responsive_directions:array<string>,optimal_range:struct<min_m:double,max_m:double,best_bin:string>"
FLAG = "id string, section_id string, lat double, lon double, note string, break_type string, confidence string, flagged_at string"
MARINE = ("wave_height", "wave_direction", "wave_period", "swell_wave_height", "swell_wave_direction", "swell_wave_period", "wind_wave_height")


def configs(spark: SparkSession, paths: str | Sequence[str], atlas: bool = False) -> DataFrame:
    """Place configurations, one document a file, with the file they came from."""
    df = spark.read.schema(ATLAS if atlas else SPOT).option("multiLine", True).json(list(paths) if not isinstance(paths, str) else paths)
    return df.withColumn("_config_path", F.input_file_name())


def features(spark: SparkSession, path: str, properties: str = SEGMENT) -> DataFrame:
    """Features of a collection: their properties, and geometry as type and coordinates text."""
    schema = f"type string, features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def lines(feature_rows: DataFrame) -> DataFrame:
    """Each part of a line or multi-line of two points or more: array of [x, y]."""
    point = "array<double>"
    one = F.array(F.from_json("coordinates", f"array<{point}>"))
    many = F.from_json("coordinates", f"array<array<{point}>>")
    parts = F.when(F.col("geometry_type") == "LineString", one).when(F.col("geometry_type") == "MultiLineString", many)
    return feature_rows.withColumn("line", F.explode(parts)).where(F.size("line") >= 2)


def feature_lines(spark: SparkSession, path: str, properties: str = SEGMENT) -> DataFrame:
    """As ``features`` from files of one feature a line, which Spark splits."""
    raw = spark.read.schema(f"type string, properties struct<{properties}>, geometry struct<type:string,coordinates:string>").json(path)
    return raw.where("type = 'Feature'").select("properties.*", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"))


def review(spark: SparkSession, path: str) -> DataFrame:
    """Rows of review sheets as texts; empty cells are null."""
    from tidemark.sources.sinks import REVIEW

    return spark.read.schema(", ".join(f"{c} string" for c in REVIEW)).option("header", True).option("escape", '"').csv(path)


def foam_detections(spark: SparkSession, path: str, a_line: bool = False) -> DataFrame:
    """Detections of all manifests, one a file or ``a_line``; broken ones and rows without a segment are left out."""
    raw = spark.read.schema(f"spot string, detections array<struct<{_nested(DETECTION)}>>, _corrupt_record string").option("multiLine", not a_line).option("mode", "PERMISSIVE").json(path)
    rows = raw.where("_corrupt_record is null").select(F.input_file_name().alias("file"), F.explode("detections").alias("d")).select("file", "d.*")
    return rows.where("segment_id is not null and segment_id <> ''")


def swell_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Complete profiles, for each segment the one with most observations; the first file wins ties."""
    raw = spark.read.schema(f"profiles map<string,struct<{PROFILE}>>").option("multiLine", True).json(path)
    rows = raw.select(F.input_file_name().alias("file"), F.explode("profiles").alias("segment_id", "p")).select("file", "segment_id", "p.*").where("status = 'complete'")
    first = rows.groupBy("segment_id").agg(F.max("observation_count").alias("most"))
    top = rows.join(first, "segment_id").where("observation_count <=> most").groupBy("segment_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "segment_id")), "file").alias("p"))
    return top.select("segment_id", "p.*")


def _nested(ddl: str) -> str:
    return ",".join(f"{n}:{k}" for n, k in (x.split() for x in ddl.split(", ")))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON at a path that may be missing: then no rows of the same schema."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return spark.read.schema(schema).option("multiLine", True).json(path)


def hourly(spark: SparkSession, path: str, metrics: Sequence[str] = MARINE, a_line: bool = False) -> DataFrame:
    """Parallel hourly arrays as rows; a metric that is missing or short is null."""
    arrays = ",".join(f"{m}:array<double>" for m in metrics)
    raw = spark.read.schema(f"latitude double, longitude double, hourly struct<time:array<string>,{arrays}>").option("multiLine", not a_line).json(path)
    none = F.array().cast("array<double>")  # a null array would make the whole zip null
    whole = raw.select("latitude", "longitude", F.col("hourly.time").alias("time"), *(F.coalesce(F.col(f"hourly.{m}"), none).alias(m) for m in metrics))
    rows = whole.select("latitude", "longitude", F.explode(F.arrays_zip("time", *metrics)).alias("h"))
    return rows.select("latitude", "longitude", F.to_timestamp("h.time").alias("ts"), *(F.col(f"h.{m}").alias(m) for m in metrics)).where("ts is not null")


def tide_stations(spark: SparkSession, path: str) -> DataFrame:
    """Map of slug to station as rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,struct<station_id:string,station_name:string,distance_km:double>>")).alias("slug", "s")).select("slug", "s.*")


def flags(rows: DataFrame, body: str) -> DataFrame:
    """Flags from stored JSON; entries that lack a required field are left out."""
    parsed = rows.select(F.explode(F.from_json(body, f"array<struct<{_nested(FLAG)}>>")).alias("f")).select("f.*")
    return parsed.dropna(subset=["id", "section_id", "lat", "lon", "break_type", "confidence"])


def slug_of(path: Column, suffix: str) -> Column:
    """Name of the file without its suffix."""
    return F.regexp_extract(path, rf"([^/]+){suffix}\.json$", 1)


def dates_in_text(spark: SparkSession, path: str) -> DataFrame:
    """Distinct dates of text files with the position of their first line."""
    found = spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), F.explode(F.regexp_extract_all("value", F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))).alias("date"))
    return found.groupBy("date").agg(F.min("position").alias("position"))


def latest_ways(ways: DataFrame, id_col: str = "osm_id", tile: str = "tile", points: str = "coords") -> DataFrame:
    """Ways of overlapping tiles, once each: the last tile's; two points at least."""
    usable = ways.where(F.size(points) >= 2)
    others = [c for c in ways.columns if c != id_col]
    return usable.groupBy(id_col).agg(F.max_by(F.struct(*others), tile).alias("w")).select(id_col, *(F.col(f"w.{c}").alias(c) for c in others))
