"""Lookups by a given window, date or name, and runs that carry on past bad rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import rows as row_checks
from tidemark.operators import scenes, views
from tidemark.plans.registry import query
from tidemark.plans.scene_plans import _POINTS, SCENE_SQL, _scenes
from tidemark.sources import adapters, documents
from tidemark.sources.adapters import table, with_views

DAY = datetime.date(1995, 3, 6)
FROM, TO, CLOUD, THUMBNAILS = "1994-06-01", "1997-09-30", 150_000, 12


@query(
    f"""SELECT o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS cloud FROM orders
        WHERE o_orderdate >= TIMESTAMP '{FROM}' AND o_orderdate < TIMESTAMP '{TO}' AND o_totalprice < {CLOUD} ORDER BY o_totalprice, o_orderkey LIMIT {THUMBNAILS}"""
)
def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cloudy scenes of a window under a cloud limit: a top-k report, whose bounds reach the scan."""
    found = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit(FROM).cast("timestamp")) & (F.col("o_orderdate") < F.lit(TO).cast("timestamp")) & (F.col("o_totalprice") < CLOUD))
    some = found.orderBy("o_totalprice", "o_orderkey").limit(THUMBNAILS)
    return some.select(F.col("o_orderkey").alias("scene_id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("cloud"))


_NAMES_SQL = "name AS (SELECT s_suppkey % 20 AS spot_id, min(s_name) AS name FROM supplier GROUP BY 1)"


@query(
    with_views(
        "det scene",
        SCENE_SQL
        + f""", {_NAMES_SQL}, c AS (SELECT scene_date, count(*) AS n_spots, list_sort(list(swell_height_m))[count(*) // 2 + 1] AS median_swell_m, arg_min(swell_period_s, spot_id) AS period_s,
        first(swell_direction_deg ORDER BY swell_period_s IS NULL, spot_id) AS direction_deg, array_to_string(list_sort(list(name)), ', ') AS names FROM sf JOIN name USING (spot_id) WHERE scene_date = DATE '{DAY}' GROUP BY scene_date)
        SELECT *, {_POINTS}[CAST(floor(direction_deg / 22.5 + 0.5) AS INT) % 16 + 1] AS direction FROM c""",
    )
)
def compare_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date of the comparison by its own: no filter of swell or spots, one spot is enough, names in a reader's order."""
    spots = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 20).alias("spot_id")).agg(F.min("s_name").alias("name"))
    day = scenes.scene_foam(adapters.scenes(spark, sf_dir).where(F.col("scene_date") == F.lit(DAY)), ["spot_id", "scene_date"], adapters.unique_order())
    c = scenes.compare_dates(day, "spot_id", "scene_date").drop("spots")
    named = day.join(spots, "spot_id").groupBy("scene_date").agg(scenes.in_reading_order("name").alias("names"))
    return c.join(named, "scene_date").withColumn("direction", labels.compass(F.col("direction_deg")))


@query(
    with_views(
        "det scene",
        SCENE_SQL
        + f""", {_NAMES_SQL}, n AS (SELECT scene_date, count(*) AS n_spots, array_to_string(list_sort(list(name)), ', ') AS names FROM sf JOIN name USING (spot_id) GROUP BY scene_date) SELECT * FROM n WHERE n_spots >= 3""",
    )
)
def date_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the spots of each date with three spots or more, in a reader's order."""
    spots = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 20).alias("spot_id")).agg(F.min("s_name").alias("name"))
    named = _scenes(spark, sf_dir).join(spots, "spot_id")
    return named.groupBy("scene_date").agg(F.count("*").alias("n_spots"), scenes.in_reading_order("name").alias("names")).where("n_spots >= 3")


@query(
    """WITH m AS (SELECT DISTINCT 'out/spot-' || l_suppkey || '_foam_detections.json' AS path FROM lineitem), s AS (SELECT path, regexp_extract(path, '([^/]+)_foam_detections\\.json$', 1) AS slug FROM m),
        c AS (SELECT 'spot-' || s_suppkey AS slug FROM supplier WHERE s_acctbal >= 0)
        SELECT s.slug, s.path, c.slug IS NOT NULL AS has_config FROM s LEFT JOIN c USING (slug)"""
)
def discover_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foam manifests by their file names, with whether their spot has a config: those without are a warning."""
    paths = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("out/spot-"), F.col("l_suppkey").cast("string"), F.lit("_foam_detections.json")).alias("path")).distinct()
    configs = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("spot-"), F.col("s_suppkey").cast("string")).alias("slug"))
    return views.discovered(paths.withColumn("slug", documents.slug_of(F.col("path"), "_foam_detections")), configs, "slug")


_REASON_SQL = "CASE WHEN value IS NULL THEN 'no value' WHEN value < 0 THEN 'below zero' WHEN coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) < 0 THEN 'no key' WHEN event_type NOT IN ('click', 'purchase', 'view') THEN 'other kind' END"


@query(f"SELECT station, count(*) AS n_rows, count(*) FILTER (reason IS NULL) AS n_good, count(reason) AS n_errors, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), ','), '') AS reasons FROM (SELECT user_id AS station, {_REASON_SQL} AS reason FROM events) GROUP BY station")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each station that pass the checks and that fail them, with the reasons: no row stops the run."""
    checked = row_checks.checked(adapters.hourly(spark, sf_dir), _rules())
    found = checked.groupBy("station").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("error").isNull(), 1)).alias("n_good"), F.count("error").alias("n_errors"), F.collect_set("error").alias("reasons"))
    return found.withColumn("reasons", F.array_join(F.array_sort("reasons"), ","))


def _rules() -> dict:
    key = F.get_json_object("props", "$.k").try_cast("bigint")
    return {
        "no value": F.col("value").isNotNull(),
        "below zero": F.col("value") >= 0,
        "no key": F.coalesce(key, F.lit(-1)) >= 0,
        "other kind": F.col("event_type").isin("click", "purchase", "view"),
    }
