"""Round trips: what a sink writes, a source reads back, from a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import resume
from tidemark.plans.registry import query
from tidemark.sources import adapters, documents, sinks
from tidemark.sources.adapters import table, with_views
from tidemark.sources.scratch import new_path


@query(
    """SELECT CAST(l_partkey AS VARCHAR) AS segment_id, count(*) AS n, count(quality) AS n_quality, sum(pixels) AS pixels, max(foam) AS max_foam
        FROM (SELECT l_partkey, CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_tax END AS quality, CAST(floor(l_extendedprice) AS BIGINT) % 200 AS pixels, l_discount AS foam FROM lineitem WHERE l_partkey % 1000 <> 0) GROUP BY l_partkey"""
)
def manifest_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as one manifest an order, read back as rows; those without a segment are left out, nulls stay null."""
    rows = table(spark, sf_dir, "lineitem")
    found = F.struct(
        F.when(F.col("l_partkey") % 1000 != 0, F.col("l_partkey").cast("string")).alias("segment_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.col("l_discount").alias("foam_fraction"),
        F.when(F.col("l_orderkey") % 50 != 0, F.col("l_tax")).alias("quality_score"),
        (F.floor("l_extendedprice") % 200).alias("water_pixel_count"),
    )
    # An order has a few lines.
    manifests = rows.groupBy("l_orderkey").agg(F.collect_list(found).alias("detections")).select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("spot"), "detections")
    path = new_path(spark, "manifests")
    sinks.write_documents(manifests, path)
    back = documents.foam_detections(spark, path, a_line=True)
    return back.groupBy("segment_id").agg(F.count("*").alias("n"), F.count("quality_score").alias("n_quality"), F.sum("water_pixel_count").alias("pixels"), F.max("foam_fraction").alias("max_foam"))


@query(with_views("seg", " SELECT CAST(segment_id AS VARCHAR) AS segment_id, orientation_deg, exposure_arc_deg, total_score, 'Point' AS geometry_type, lon, lat FROM seg"))
def feature_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as point features, a line each, and read back with their coordinates."""
    rows = adapters.segments(spark, sf_dir).withColumn("segment_id", F.col("segment_id").cast("string"))
    path = new_path(spark, "features")
    sinks.write_features(rows, path, ["segment_id", "orientation_deg", "exposure_arc_deg", "total_score"], "lon", "lat")
    back = documents.feature_lines(spark, path)
    at = F.from_json("coordinates", "array<double>")
    return back.select("segment_id", "orientation_deg", "exposure_arc_deg", "total_score", "geometry_type", F.get(at, 0).alias("lon"), F.get(at, 1).alias("lat"))


@query(
    """SELECT s_name AS spot, 'spot-' || s_suppkey AS slug, CAST(DATE '2024-01-01' + CAST(s_suppkey % 365 AS INT) AS VARCHAR) AS date, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS wave_height_m,
        CASE WHEN s_suppkey % 3 = 0 THEN 'a, "b"' END AS observation_label FROM supplier"""
)
def review_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows written as sheets with the fixed header and read back: quotes and commas survive, missing values are empty."""
    rows = table(spark, sf_dir, "supplier")
    sheet = rows.select(
        F.col("s_name").alias("spot"),
        F.concat(F.lit("spot-"), F.col("s_suppkey").cast("string")).alias("slug"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 365).cast("int")), "yyyy-MM-dd").alias("date"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("wave_height_m"),
        F.when(F.col("s_suppkey") % 3 == 0, 'a, "b"').alias("observation_label"),
    )
    path = new_path(spark, "review")
    sinks.write_review(sheet, path)
    return documents.review(spark, path).select("spot", "slug", "date", F.col("wave_height_m").cast("double").alias("wave_height_m"), "observation_label")


@query("SELECT p_brand AS brand, count(*) AS n, count(price) AS n_priced, round(max(price), 2) AS dearest FROM (SELECT p_brand, CASE WHEN p_size > 5 THEN p_retailprice END AS price FROM part) GROUP BY p_brand")
def keyed_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a folder of documents for each brand and read back, the brand from the folder's name."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("price"))
    path = new_path(spark, "keyed")
    sinks.write_by_key(rows, path, "brand")
    back = spark.read.schema("id long, price double, brand string").json(path)
    return back.groupBy("brand").agg(F.count("*").alias("n"), F.count("price").alias("n_priced"), F.round(F.max("price"), 2).alias("dearest"))


@query("SELECT user_id AS station, date_trunc('hour', ts) AS ts, max(value) AS wave_height FROM events WHERE value IS NOT NULL GROUP BY ALL")
def hourly_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings written as parallel arrays, one document for each station and day, and read back as hours;
    arrays that the documents do not have are null."""
    rows = adapters.hourly(spark, sf_dir).where("value is not null").groupBy("station", F.date_trunc("hour", "ts").alias("at")).agg(F.max("value").alias("v"))
    days = rows.groupBy("station", F.to_date("at").alias("day")).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("h"))  # at most 24
    hourly = F.struct(F.transform("h", lambda x: F.date_format(x["at"], "yyyy-MM-dd'T'HH:mm")).alias("time"), F.transform("h", lambda x: x["v"]).alias("wave_height"))
    path = new_path(spark, "hourly")
    sinks.write_documents(days.select(F.col("station").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"), hourly.alias("hourly")), path)
    back = documents.hourly(spark, path, a_line=True).where("wave_direction is null")
    return back.select(F.col("latitude").cast("long").alias("station"), "ts", "wave_height")


@query(with_views("det", " SELECT spot_id, CASE WHEN spot_id < 12 THEN 'first' ELSE 'second' END AS run, count(*) AS n, round(max(foam_fraction), 3) AS max_foam FROM det GROUP BY spot_id"))
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over some spots, then one over all: the second makes only the spots that are missing."""
    detections = adapters.detections(spark, sf_dir)
    spots = detections.select("spot_id").distinct()
    # Spots are few beside their rows, and one has a large part of these.
    make = lambda todo: detections.join(F.broadcast(todo), "spot_id").select("spot_id", "segment_id", "foam_fraction")
    path = new_path(spark, "resumed")
    resume.run_missing(spots.where("spot_id < 12"), "spot_id", make, path, "first")
    resume.run_missing(spots, "spot_id", make, path, "second")
    rows = resume.made(spark, path, "segment_id long, foam_fraction double, run string, spot_id long")
    return rows.groupBy("spot_id", "run").agg(F.count("*").alias("n"), F.round(F.max("foam_fraction"), 3).alias("max_foam"))
