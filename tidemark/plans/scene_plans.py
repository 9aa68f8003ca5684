"""Scenes, time series, rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels, scores
from tidemark.operators import raster, scenes, series
from tidemark.plans.registry import query
from tidemark.sources import adapters
from tidemark.sources.adapters import table, with_views

KEYS = ["spot_id", "scene_date"]
SCENE_SQL = """, sf AS (SELECT spot_id, scene_date, count(*) AS segment_count, count(foam) AS valid_segments, round(max(foam), 4) AS max_foam, round(avg(foam) + 1e-9, 4) AS mean_foam,
        list_sort(list(foam) FILTER (foam IS NOT NULL))[count(foam) // 2 + 1] AS median_foam, arg_min(swell_height_m, (pos, segment_id, supplier_id)) AS swell_height_m, coalesce(nullif(first(swell_period_s ORDER BY pos, segment_id, supplier_id), 0), 8) AS swell_period_s,
        arg_min(swell_direction_deg, (pos, segment_id, supplier_id)) AS swell_direction_deg, coalesce(first(quality_score ORDER BY pos, segment_id, supplier_id), 0) AS quality_score
        FROM (SELECT *, CASE WHEN coalesce(water_pixel_count, 0) >= 50 THEN foam_fraction END AS foam FROM scene) GROUP BY spot_id, scene_date HAVING count(foam) > 0 AND first(swell_height_m ORDER BY pos, segment_id, supplier_id) IS NOT NULL)"""
GALLERY_SQL = "CASE " + " ".join(f"WHEN swell_height_m >= {a} AND swell_height_m < {b} THEN '{n}'" for a, b, n in zip(labels.GALLERY_EDGES, labels.GALLERY_EDGES[1:], labels.GALLERY_LABELS, strict=False)) + " END"
LONG_SQL = "CASE WHEN coalesce(swell_period_s, 0) >= 8 THEN 0 ELSE 1 END"


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.scene_foam(adapters.scenes(spark, sf_dir), KEYS, adapters.unique_order())


@query(with_views("det scene", SCENE_SQL + " SELECT * FROM sf"))
def scene_foam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir)


@query(with_views("det scene", SCENE_SQL + " SELECT spot_id, scene_date, round(1025 * 9.81 * 9.81 * swell_height_m * swell_height_m * coalesce(nullif(swell_period_s, 0), 8) / (64 * pi()), 3) AS wave_energy FROM sf"))
def wave_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir).select(*KEYS, F.round(scores.wave_power(F.col("swell_height_m"), F.col("swell_period_s")), 3).alias("wave_energy"))


@query(
    with_views(
        "det scene",
        SCENE_SQL
        + f""" SELECT spot_id, bin, scene_date, median_foam, swell_period_s FROM (SELECT *, row_number() OVER (PARTITION BY spot_id, bin ORDER BY {LONG_SQL}, median_foam DESC, scene_date) AS r
        FROM (SELECT *, {GALLERY_SQL} AS bin FROM sf WHERE quality_score >= 90 AND valid_segments >= 2) WHERE bin IS NOT NULL) WHERE r = 1""",
    )
)
def pick_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scene of each spot and bin: those of long period first, then by median foam."""
    pool = _scenes(spark, sf_dir).where("quality_score >= 90 and valid_segments >= 2").withColumn("bin", labels.gallery_bin(F.col("swell_height_m"))).where("bin is not null")
    best = scenes.top_in_group(pool, ["spot_id", "bin"], [scenes.long_first(), F.desc("median_foam"), F.col("scene_date")])
    return best.select("spot_id", "bin", "scene_date", "median_foam", "swell_period_s")


@query(
    with_views(
        "det scene",
        SCENE_SQL
        + f""", cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spot_id, bin ORDER BY coalesce(swell_period_s, 0) DESC, scene_date) AS r FROM (SELECT *, {GALLERY_SQL} AS bin FROM sf) WHERE bin IS NOT NULL) WHERE r <= 3)
        SELECT spot_id, bin, scene_date, quality_score FROM (SELECT *, row_number() OVER (PARTITION BY spot_id, bin ORDER BY {LONG_SQL}, quality_score DESC, scene_date) AS q FROM cand WHERE quality_score >= 90) WHERE q = 1""",
    )
)
def pick_scenes_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates of each bin by period, the earliest first; only then quality decides."""
    binned = _scenes(spark, sf_dir).withColumn("bin", labels.gallery_bin(F.col("swell_height_m"))).where("bin is not null")
    few = scenes.top_in_group(binned, ["spot_id", "bin"], [F.desc(F.coalesce("swell_period_s", F.lit(0.0))), F.col("scene_date")], 3)
    best = scenes.top_in_group(few.where("quality_score >= 90"), ["spot_id", "bin"], [scenes.long_first(), F.desc("quality_score"), F.col("scene_date")])
    return best.select("spot_id", "bin", "scene_date", "quality_score")


COMPARE_SQL = SCENE_SQL + """, cmp AS (SELECT scene_date, count(*) AS n_spots, list_sort(list(swell_height_m))[count(*) // 2 + 1] AS median_swell_m, arg_min(swell_period_s, spot_id) AS period_s,
        first(swell_direction_deg ORDER BY swell_period_s IS NULL, spot_id) AS direction_deg, array_to_string(list_sort(list(CAST(spot_id AS VARCHAR))), ',') AS spots FROM sf GROUP BY scene_date)"""
_POINTS = "[" + ", ".join(f"'{p}'" for p in labels.COMPASS) + "]"


@query(with_views("det scene", COMPARE_SQL + f" SELECT *, {_POINTS}[CAST(floor(direction_deg / 22.5 + 0.5) AS INT) % 16 + 1] AS direction FROM cmp WHERE n_spots >= 3 AND median_swell_m >= 1 AND median_swell_m < 5"))
def compare_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scenes.compare_dates(_scenes(spark, sf_dir), "spot_id", "scene_date")
    return c.where("n_spots >= 3 and median_swell_m >= 1 and median_swell_m < 5").withColumn("direction", labels.compass(F.col("direction_deg")))


@query(with_views("det scene", COMPARE_SQL + " SELECT scene_date, n_spots FROM cmp ORDER BY n_spots DESC, scene_date DESC LIMIT 25"))
def compare_dates_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scenes.compare_dates(_scenes(spark, sf_dir), "spot_id", "scene_date")
    return c.select("scene_date", "n_spots").orderBy(F.desc("n_spots"), F.desc("scene_date")).limit(25)


@query(
    with_views(
        "hourly",
        """, d AS (SELECT station, CAST(ts AS DATE) AS day, value, ts, event_id, abs(epoch(ts) - epoch(date_trunc('day', ts)) - 54000) AS off FROM hourly),
        n AS (SELECT station, day, count(*) AS n, first(value ORDER BY CAST(floor(off) AS BIGINT), ts, event_id) AS value, min(value) AS low, max(value) AS high FROM d WHERE off <= 3600 GROUP BY station, day)
        SELECT station, day, n, value, CASE WHEN n < 2 THEN 'unknown' WHEN value > (low + high) / 2 + (high - (low + high) / 2) * 0.3::DOUBLE THEN 'high' WHEN value < (low + high) / 2 - ((low + high) / 2 - low) * 0.3::DOUBLE THEN 'low' ELSE 'mid' END AS state FROM n""",
    )
)
def tide_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading nearest to 15:00 within an hour, and the tide's state from the readings in reach."""
    near = series.nearest_in_day(adapters.hourly(spark, sf_dir), ["station"], "ts", "value", tie="event_id")
    return near.select("station", "day", "n", "value", series.tide_state(F.col("value"), F.col("low"), F.col("high"), F.col("n")).alias("state"))


@query(
    """WITH t AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS target FROM orders), c AS (SELECT o_orderkey AS scene_id, o_orderdate AS ts, o_totalprice AS cloud FROM orders WHERE o_totalprice < 100000)
    SELECT CAST(target AS DATE) AS target, scene_id, cloud FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY cloud, scene_id) AS r FROM t JOIN c ON ts >= target - INTERVAL 3 DAY AND ts < target + INTERVAL 3 DAY) WHERE r = 1"""
)
def scene_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cloudy scene within three days of each day that has a scene."""
    orders = table(spark, sf_dir, "orders")
    targets = orders.select(F.to_date("o_orderdate").alias("target")).distinct()
    candidates = orders.where("o_totalprice < 100000").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("cloud"))
    return series.asof_best(targets, candidates, "target", "ts", 3, ["cloud", "scene_id"], []).select("target", "scene_id", "cloud")


@query(
    """WITH t(target) AS (VALUES (DATE '1995-03-01'), (DATE '1996-07-15'), (DATE '1997-12-31'), (DATE '1890-01-01')), c AS (SELECT o_orderkey AS scene_id, o_orderdate AS ts, o_totalprice AS cloud FROM orders WHERE o_totalprice < 100000),
    b AS (SELECT target, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY cloud, scene_id) AS r FROM t JOIN c ON ts >= target - INTERVAL 3 DAY AND ts < target + INTERVAL 3 DAY) WHERE r = 1)
    SELECT strftime(target, '%Y-%m-%d') || '_' || combo || '.png' AS name, scene_id FROM b, (VALUES ('rgb'), ('nir'), ('swir')) AS k(combo)"""
)
def band_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every band combination for the best scene of each listed day; days without a scene are skipped."""
    targets = spark.createDataFrame([("1995-03-01",), ("1996-07-15",), ("1997-12-31",), ("1890-01-01",)], "d string").select(F.to_date("d").alias("target"))
    candidates = table(spark, sf_dir, "orders").where("o_totalprice < 100000").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("cloud"))
    best = series.asof_best(targets, candidates, "target", "ts", 3, ["cloud", "scene_id"], [])
    combos = best.select("target", "scene_id", F.explode(F.array(F.lit("rgb"), F.lit("nir"), F.lit("swir"))).alias("combo"))
    return combos.select(F.concat(F.date_format("target", "yyyy-MM-dd"), F.lit("_"), "combo", F.lit(".png")).alias("name"), "scene_id")


@query("SELECT day, scene_id, cloud FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS scene_id, o_totalprice AS cloud, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def least_cloudy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cloudy scene of each day: an aggregate, so that days need no sorting."""
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.struct(F.col("o_totalprice").alias("cloud"), F.col("o_orderkey").alias("scene_id")).alias("s"))
    return rows.groupBy("day").agg(F.min("s").alias("s")).select("day", "s.scene_id", "s.cloud")


@query("SELECT count(*) AS n_total, count(*) FILTER (o_totalprice < 150000) AS n_clear, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def scene_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp'1995-01-01' and o_orderdate < timestamp'1998-01-01'")
    return rows.agg(F.count("*").alias("n_total"), F.count(F.when(F.col("o_totalprice") < 150_000, 1)).alias("n_clear"), F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))


@query("SELECT o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice < 150000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def export_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest clear scenes: a top-k report."""
    rows = table(spark, sf_dir, "orders").where("o_totalprice < 150000").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return rows.select(F.col("o_orderkey").alias("scene_id"), F.to_date("o_orderdate").alias("day"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice < 50000")
def clear_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_totalprice < 50000").select(F.to_date("o_orderdate").alias("day")).distinct()


@query(with_views("hourly", """, h AS (SELECT station, CAST(ts AS DATE) AS day, hour(ts) AS h, max(value) AS value FROM hourly GROUP BY ALL), days AS (SELECT DISTINCT station, day FROM h)
    SELECT d.station, d.day, coalesce(a.value, b.value) AS value, a.value IS NOT NULL AS exact FROM days d LEFT JOIN h a ON a.station = d.station AND a.day = d.day AND a.h = 15
    LEFT JOIN (SELECT station, day, arg_max(value, h) AS value FROM h WHERE h < 15 GROUP BY ALL) b ON b.station = d.station AND b.day = d.day"""))
def hourly_at_overpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at 15:00, else the last one before: one aggregate, no second look-up."""
    h = adapters.hourly(spark, sf_dir).groupBy("station", F.to_date("ts").alias("day"), F.hour("ts").alias("h")).agg(F.max("value").alias("value"))
    exact = F.max(F.when(F.col("h") == 15, F.col("value")))
    before = F.max_by("value", F.when(F.col("h") < 15, F.col("h")))
    return h.groupBy("station", "day").agg(F.coalesce(exact, before).alias("value"), exact.isNotNull().alias("exact"))


@query(with_views("hourly", " SELECT station, strftime(ts, '%Y-%m') AS month, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM hourly GROUP BY ALL"))
def monthly_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = adapters.hourly(spark, sf_dir).select("station", F.to_date("ts").alias("day"))
    return series.monthly_ranges(days, ["station"], "day")


@query(with_views("hourly", """, s AS (SELECT station, list(value ORDER BY ts, event_id) AS v FROM hourly GROUP BY station)
    SELECT station, v[least(11, len(v) - 1) + 1] AS at_11, len(v) AS n FROM s"""))
def hour_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element 11 of a station's series, or its last: rows are counted, the series is not gathered."""
    from pyspark.sql import Window

    w = Window.partitionBy("station")
    rows = adapters.hourly(spark, sf_dir).withColumns({"r": F.row_number().over(w.orderBy("ts", "event_id")), "n": F.count("*").over(w)})
    return rows.where(F.col("r") == F.least(F.lit(12), F.col("n"))).select("station", F.col("value").alias("at_11"), "n")


@query(with_views("hourly", " SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'archive' ELSE 'forecast' END AS route, coalesce(nullif(value, 0), 1.0) AS value FROM hourly"))
def hour_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp"), "archive").otherwise("forecast")
    return adapters.hourly(spark, sf_dir).select("event_id", route.alias("route"), F.coalesce(F.nullif("value", F.lit(0.0)), F.lit(1.0)).alias("value"))


QUALITY_SQL = """, q AS (SELECT scene_id, count(*) AS n_pixels, count(*) FILTER (scl IN (8, 9, 10)) / count(*) AS cloud, count(*) FILTER (scl = 3) / count(*) AS shadow, count(*) FILTER (scl <> 0) / count(*) AS valid,
    coalesce(count(*) FILTER (scl = 11) / nullif(count(*) FILTER (scl NOT IN (0, 6)), 0), 0) AS snow_land FROM pix GROUP BY scene_id)"""


@query(with_views("pix", QUALITY_SQL + """ SELECT scene_id, n_pixels, round(cloud, 4) AS cloud, round(shadow, 4) AS shadow, round(valid, 4) AS valid, round(snow_land, 4) AS snow_land,
    round(40 * (1 - least(cloud, 1)) + 30 * least(valid, 1) + 20 * (1 - least(snow_land, 1)) + 10 * (1 - least(shadow, 1)), 2) AS quality_score FROM q"""))
def scl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = raster.scene_quality(adapters.pixels(spark, sf_dir), ["scene_id"])
    return q.select("scene_id", "n_pixels", *(F.round(c, 4).alias(c) for c in ("cloud", "shadow", "valid", "snow_land")), F.round("quality_score", 2).alias("quality_score"))


@query(with_views("pix", " SELECT scene_id, " + ", ".join(f"count(*) FILTER (scl = {c}) AS scl_{c}" for c in adapters.SCL) + " FROM pix GROUP BY scene_id"))
def scl_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.class_histogram(adapters.pixels(spark, sf_dir), ["scene_id"], adapters.SCL)


@query(with_views("pix", """ SELECT scene_id, py AS zone, count(*) AS total_buffer_pixels, count(*) FILTER (scl IN (6, 3)) AS water_pixel_count, count(*) FILTER (scl IN (6, 3) AND b8 > 800) AS foam_pixel_count,
    round(avg(b8) FILTER (scl IN (6, 3)), 3) AS mean_nir, max(b8) FILTER (scl IN (6, 3)) AS max_nir, round(count(*) FILTER (scl IN (6, 3) AND b8 > 800) / count(*) FILTER (scl IN (6, 3)), 4) AS foam_fraction,
    count(*) FILTER (scl IN (6, 3) AND b8 > 800) * 100 / 200 AS foam_extent_m FROM pix GROUP BY scene_id, py HAVING count(*) FILTER (scl IN (6, 3)) > 0"""))
def zonal_foam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pixels stand for the buffers of segments."""
    z = raster.zonal_foam(adapters.pixels(spark, sf_dir).withColumnRenamed("py", "zone"), ["scene_id", "zone"])
    return z.withColumns({"mean_nir": F.round("mean_nir", 3), "foam_fraction": F.round("foam_fraction", 4)})


@query(with_views("pix", " SELECT scene_id, round(avg((b3 - b8) / nullif(b3 + b8, 0)), 4) AS mean_ndwi, count(*) FILTER ((b3 - b8) / nullif(b3 + b8, 0) > 0) AS n_wet FROM pix GROUP BY scene_id"))
def ndwi(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = adapters.pixels(spark, sf_dir).select("scene_id", scores.ndwi(F.col("b3"), F.col("b8")).alias("v"))
    return v.groupBy("scene_id").agg(F.round(F.avg("v"), 4).alias("mean_ndwi"), F.count(F.when(F.col("v") > 0, 1)).alias("n_wet"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS step, count(*) AS n, bool_and(value >= 0 OR event_type = 'error') AS all_ok FROM events GROUP BY ALL")
def step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ok = (F.col("value") >= 0) | (F.col("event_type") == "error")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("step")).agg(F.count("*").alias("n"), F.bool_and(ok).alias("all_ok"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the streaming operator over the table."""
    from tidemark.streaming import flags

    return flags.windowed_counts(table(spark, sf_dir, "events"))
