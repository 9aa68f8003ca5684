"""Domain views over the driver's tables.

Each view is one projection of a table; ``CTE`` holds the same views as SQL for
DuckDB, so that both sides read one definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pixel classes that the pixel view cycles through.
SCL = (0, 3, 6, 8, 9, 10, 11)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    k = F.round(F.col("l_discount") * 100).cast("int")
    return line.select(
        F.col("l_partkey").alias("segment_id"),
        (F.col("l_suppkey") % 20).alias("spot_id"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("scene_date"),
        (F.col("l_quantity") / 10).alias("swell_height_m"),
        (5 + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 10).cast("double").alias("swell_period_s"),
        ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11) % 360).cast("double").alias("swell_direction_deg"),
        (k * k * 9 / 1000).alias("foam_fraction"),
        F.when(F.col("l_orderkey") % 50 == 0, None).otherwise(100.0 - 6 * F.round(F.col("l_tax") * 100)).alias("quality_score"),
        (F.floor("l_extendedprice") % 200).alias("water_pixel_count"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.col("l_suppkey").alias("supplier_id"),
    )


# What tells detections apart: numbers of order and line repeat in ``lineitem``.
ORDER = ("pos", "segment_id", "supplier_id")


def unique_order() -> Column:
    """``ORDER`` as one number: the row's place, then its segment and supplier, 12 and 7 digits wide."""
    wide = lambda c, digits: F.col(c).cast("decimal(19,0)") * F.lit("1" + "0" * digits).cast("decimal(20,0)")
    return (wide("pos", 19) + wide("segment_id", 7) + F.col("supplier_id")).cast("decimal(38,0)")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("segment_id"),
        F.col("p_brand").alias("chain"),
        (F.col("p_partkey") * 137 % 360).cast("double").alias("orientation_deg"),
        (F.col("p_size") % 38 * 5).cast("double").alias("exposure_arc_deg"),
        (F.col("p_partkey") * 97 % 1001 / 10).alias("total_score"),
        (43.3 + F.col("p_partkey") * 17 % 3800 / 1000).alias("lat"),
        (-67.0 + F.col("p_partkey") * 29 % 7400 / 1000).alias("lon"),
    )


def known_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return supplier.select(
        F.col("s_suppkey").alias("spot_id"),
        F.col("s_name").alias("name"),
        (43.3 + F.col("s_suppkey") * 271 % 3800 / 1000).alias("lat"),
        (-67.0 + F.col("s_suppkey") * 523 % 7400 / 1000).alias("lon"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per detection with the swell of its scene, constant per (spot, week)."""
    d = detections(spark, sf_dir)
    days = F.datediff("scene_date", F.lit("1970-01-01").cast("date"))
    swell = F.pmod(days * 37 + F.col("spot_id") * 7, F.lit(60)) / 10
    return d.drop("swell_height_m", "swell_period_s").withColumns({"swell_height_m": swell, "swell_period_s": (4 + F.pmod(days + F.col("spot_id"), F.lit(9))).cast("double")})


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings")
    cell = vec.select(F.col("vec_id").alias("scene_id"), F.posexplode("embedding").alias("pos", "v"))
    return cell.select(
        "scene_id",
        (F.col("pos") % 8).alias("px"),
        F.floor(F.col("pos") / 8).cast("int").alias("py"),
        (1000 + F.round(F.col("v").cast("double") * 2000).cast("int")).alias("b8"),
        (900 + F.round(F.col("v").cast("double") * 1000).cast("int")).alias("b3"),
        F.element_at(F.array(*map(F.lit, SCL)), (F.pmod(F.col("pos") * 7 + F.col("scene_id"), F.lit(7)) + 1).cast("int")).alias("scl"),
    )


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scenes over one map of pixels of 50 m: each vector is a patch of 8 by 8 pixels around the
    place of its line (see ``polylines``); scene s reads the vector from element 16 s on."""
    vec = table(spark, sf_dir, "embeddings")
    cell = vec.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("k"))
    pos = (F.col("k") % 64).cast("int")
    scene = F.floor(F.col("k") / 64).cast("int")
    v = F.element_at("embedding", ((pos + scene * 16) % 64 + 1).cast("int")).cast("double")
    return cell.select(
        scene.alias("scene"),
        (F.floor(F.col("vec_id") / 1000) * 8 - 4 + F.floor(pos / 8)).alias("row"),
        (F.col("vec_id") % 1000 * 8 - 4 + pos % 8).alias("col"),
        (1000 + F.round(v * 2000).cast("int")).alias("b8"),
        F.element_at(F.array(*map(F.lit, SCL)), (F.pmod(pos * 7 + F.col("vec_id") + scene, F.lit(7)) + 1).cast("int")).alias("scl"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("station"), "ts", "event_type", "value", "props")


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One open line for each vector: vertex i is (1000 x, 1000 y) of its i-th pair, in
    metres, around a place of its own on a grid of 400 m, so that lines crowd no more on
    a large table than on a small one."""
    vec = table(spark, sf_dir, "embeddings")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.element_at("embedding", i * 2 + 1).alias("x"), F.element_at("embedding", i * 2 + 2).alias("y"))))
    east, north = F.col("line_id") % 1000 * 400, F.floor(F.col("line_id") / 1000) * 400
    return vec.select(F.col("vec_id").alias("line_id"), at.alias("i", "v")).select("line_id", "i", (F.col("v.x").cast("double") * 1000 + east).alias("x"), (F.col("v.y").cast("double") * 1000 + north).alias("y"))


def elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster of 500 rows (0.0076 degrees apart) by 64 columns (0.116 degrees apart), in
    metres; of the vectors of a row the last one counts."""
    vec = table(spark, sf_dir, "embeddings")
    cell = vec.select("vec_id", (F.col("vec_id") % 500).alias("iy"), F.posexplode("embedding").alias("ix", "v"))
    return cell.groupBy("iy", "ix").agg((F.round(F.max_by("v", "vec_id").cast("double") * 400) - 20).alias("elevation"))


def daily(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Reading of each day of the year: the last event of one kind on it."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.groupBy(F.dayofyear("ts").alias("doy")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


CTE = {
    "det": """det AS (
        SELECT l_partkey AS segment_id, l_suppkey % 20 AS spot_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS scene_date,
               l_quantity / 10 AS swell_height_m, CAST(5 + (l_partkey * 7 + l_linenumber) % 10 AS DOUBLE) AS swell_period_s,
               CAST((l_suppkey * 37 + l_linenumber * 11) % 360 AS DOUBLE) AS swell_direction_deg,
               CAST(round(l_discount * 100) AS INT) * CAST(round(l_discount * 100) AS INT) * 9 / 1000 AS foam_fraction,
               CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE 100.0 - 6 * round(l_tax * 100) END AS quality_score,
               CAST(floor(l_extendedprice) AS BIGINT) % 200 AS water_pixel_count, l_orderkey * 10 + l_linenumber AS pos, l_suppkey AS supplier_id
        FROM lineitem)""",
    "seg": """seg AS (
        SELECT p_partkey AS segment_id, p_brand AS chain, CAST(p_partkey * 137 % 360 AS DOUBLE) AS orientation_deg,
               CAST(p_size % 38 * 5 AS DOUBLE) AS exposure_arc_deg, (p_partkey * 97 % 1001) / 10 AS total_score,
               43.3::DOUBLE + (p_partkey * 17 % 3800) / 1000 AS lat, -67.0::DOUBLE + (p_partkey * 29 % 7400) / 1000 AS lon
        FROM part)""",
    "known": """known AS (
        SELECT s_suppkey AS spot_id, s_name AS name, 43.3::DOUBLE + (s_suppkey * 271 % 3800) / 1000 AS lat, -67.0::DOUBLE + (s_suppkey * 523 % 7400) / 1000 AS lon
        FROM supplier)""",
    "scene": """scene AS (
        SELECT segment_id, spot_id, scene_date, swell_direction_deg, foam_fraction, quality_score, water_pixel_count, pos, supplier_id,
               ((datediff('day', DATE '1970-01-01', scene_date) * 37 + spot_id * 7) % 60) / 10 AS swell_height_m,
               CAST(4 + (datediff('day', DATE '1970-01-01', scene_date) + spot_id) % 9 AS DOUBLE) AS swell_period_s
        FROM det)""",
    "pix": """pix AS (
        SELECT vec_id AS scene_id, pos % 8 AS px, CAST(pos // 8 AS INT) AS py, 1000 + CAST(round(CAST(v AS DOUBLE) * 2000) AS INT) AS b8,
               900 + CAST(round(CAST(v AS DOUBLE) * 1000) AS INT) AS b3, [0, 3, 6, 8, 9, 10, 11][(pos * 7 + vec_id) % 7 + 1] AS scl
        FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings))""",
    "spix": """spix AS (
        SELECT CAST(scene AS INT) AS scene, vec_id // 1000 * 8 - 4 + pos // 8 AS row, vec_id % 1000 * 8 - 4 + pos % 8 AS col,
               1000 + CAST(round(CAST(embedding[(pos + scene * 16) % 64 + 1] AS DOUBLE) * 2000) AS INT) AS b8, [0, 3, 6, 8, 9, 10, 11][(pos * 7 + vec_id + scene) % 7 + 1] AS scl
        FROM (SELECT vec_id, embedding, k // 64 AS scene, k % 64 AS pos FROM (SELECT vec_id, embedding, unnest(range(256)) AS k FROM embeddings)))""",
    "hourly": "hourly AS (SELECT event_id, user_id AS station, ts, event_type, value, props FROM events)",
    "poly": """poly AS (
        SELECT vec_id AS line_id, i, CAST(embedding[i * 2 + 1] AS DOUBLE) * 1000 + vec_id % 1000 * 400 AS x, CAST(embedding[i * 2 + 2] AS DOUBLE) * 1000 + vec_id // 1000 * 400 AS y
        FROM (SELECT vec_id, embedding, unnest(range(32)) AS i FROM embeddings))""",
    "elev": """elev AS (
        SELECT iy, ix, round(CAST(arg_max(v, vec_id) AS DOUBLE) * 400) - 20 AS elevation
        FROM (SELECT vec_id, vec_id % 500 AS iy, unnest(range(len(embedding))) AS ix, unnest(embedding) AS v FROM embeddings) GROUP BY iy, ix)""",
    "daily": """daily AS (
        SELECT event_type AS kind, dayofyear(ts) AS doy, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL)""",
}


def with_views(names: str, body: str) -> str:
    """The SQL ``body`` with the named views before it."""
    return "WITH " + ", ".join(CTE[n] for n in names.split()) + body
