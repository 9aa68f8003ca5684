"""Scenes and segment buffers: pixels met with the runs of rasterised buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rounding import rounded
from tidemark.operators import raster, spatial
from tidemark.plans.places import EDGE_SQL
from tidemark.plans.registry import query
from tidemark.sources import adapters
from tidemark.sources.adapters import with_views

PIXEL, REACH = 50.0, 200.0

_NEAR = "sqrt((x - px - t * (qx - px)) * (x - px - t * (qx - px)) + (y - py - t * (qy - py)) * (y - py - t * (qy - py)))"
_ALONG = "greatest(0, least(1, coalesce(((x - px) * (qx - px) + (y - py) * (qy - py)) / nullif((qx - px) * (qx - px) + (qy - py) * (qy - py), 0), 0)))"

#: Every pixel centre against every edge of the lines whose box it is in, and against the
#: edges moved landward: no runs here.
_INSIDE_SQL = (
    EDGE_SQL
    + f""", cell AS (SELECT DISTINCT row, col, (col + 0.5) * 50 AS x, (row + 0.5) * 50 AS y FROM spix),
    faced AS (SELECT *, sin(radians(line_id * 37 % 360 + 180)) * 200 AS dx, cos(radians(line_id * 37 % 360 + 180)) * 200 AS dy FROM edge),
    box AS (SELECT line_id, min(least(ax, bx)) - 200 AS x0, max(greatest(ax, bx)) + 200 AS x1, min(least(ay, yb)) - 200 AS y0, max(greatest(ay, yb)) + 200 AS y1 FROM edge GROUP BY line_id),
    near AS (SELECT line_id, row, col, x, y FROM box JOIN cell ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1),
    met AS (SELECT line_id, row, col, min({_NEAR}) FILTER (NOT land) AS off, min({_NEAR}) FILTER (land) AS land
        FROM (SELECT *, {_ALONG} AS t FROM (
            SELECT n.*, e.ax AS px, e.ay AS py, e.bx AS qx, e.yb AS qy, false AS land FROM near n JOIN faced e USING (line_id)
            UNION ALL SELECT n.*, e.ax + dx, e.ay + dy, e.bx + dx, e.yb + dy, true FROM near n JOIN faced e USING (line_id))) GROUP BY ALL),
    inside AS (SELECT line_id, row, col FROM met WHERE off <= 200 AND land > 100)"""
)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spatial.edges(adapters.polylines(spark, sf_dir), "line_id", "i")
    faced = edges.withColumn("facing", (F.col("line_id") * 37 % 360).cast("double"))
    return raster.buffer_runs(faced, "line_id", "facing", REACH, PIXEL)


@query(with_views("poly spix", _INSIDE_SQL + " SELECT line_id, row, count(*) AS n_pixels, min(col) AS first_col, max(col) AS last_col FROM inside GROUP BY ALL"))
def buffer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each line's seaward buffer in each row of the scenes' raster."""
    seen = adapters.scene_pixels(spark, sf_dir).select("row", "col").distinct()
    met = raster.in_runs(seen, _runs(spark, sf_dir))
    return met.groupBy("line_id", "row").agg(F.count("*").alias("n_pixels"), F.min("col").alias("first_col"), F.max("col").alias("last_col"))


@query(
    with_views(
        "poly spix",
        _INSIDE_SQL
        + """, w AS (SELECT scene, line_id, count(*) AS water, count(*) FILTER (b8 > 800) AS foam, sum(b8) AS total, max(b8) AS max_nir FROM spix JOIN inside USING (row, col) WHERE scl IN (3, 6) GROUP BY ALL)
        SELECT scene, line_id, round(foam / water + 1e-9, 4) AS foam_fraction, round(foam * 100 / 200 + 1e-9, 1) AS foam_extent_m, round(total / water + 1e-9, 1) AS mean_nir, max_nir, water AS water_pixel_count, foam AS foam_pixel_count, water AS total_buffer_pixels FROM w""",
    )
)
def segment_foam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brightness and foam of every scene in every line's seaward buffer of 200 m."""
    found = raster.zonal_join(adapters.scene_pixels(spark, sf_dir), _runs(spark, sf_dir), "scene", "line_id")
    return found.withColumns({"foam_fraction": rounded("foam_fraction", 4), "foam_extent_m": rounded("foam_extent_m", 1), "mean_nir": rounded("mean_nir", 1)})


@query(
    with_views(
        "poly spix",
        _INSIDE_SQL
        + """, q AS (SELECT scene, 100 * (count(*) FILTER (scl IN (8, 9, 10))) / count(*) AS cloud FROM spix GROUP BY scene),
        c AS (SELECT scene, line_id FROM q, (SELECT DISTINCT line_id FROM inside) WHERE cloud < 43),
        w AS (SELECT DISTINCT scene, line_id FROM spix JOIN inside USING (row, col) WHERE scl IN (3, 6))
        SELECT scene, count(*) AS n_pairs, count(w.line_id) AS n_detections, count(*) - count(w.line_id) AS n_without_water FROM c LEFT JOIN w USING (scene, line_id) GROUP BY scene""",
    )
)
def scene_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each scene with less than 43 % cloud: pairs with a buffer, those with water, those without.

    A pair without water has no detection, so that all pairs are only counted."""
    pixels, runs = adapters.scene_pixels(spark, sf_dir), _runs(spark, sf_dir)
    cloud = pixels.groupBy("scene").agg((F.count(F.when(F.col("scl").isin(*raster.CLOUDS), 1)) * 100 / F.count("*")).alias("cloud"))
    clear = cloud.where("cloud < 43").select("scene")
    seen = pixels.select("row", "col").distinct()
    zones = raster.in_runs(seen, runs).agg(F.countDistinct("line_id").alias("n_pairs"))
    found = raster.zonal_join(pixels, runs, "scene", "line_id").groupBy("scene").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return clear.join(found, "scene", "left").join(F.broadcast(zones)).select("scene", "n_pairs", n.alias("n_detections"), (F.col("n_pairs") - n).alias("n_without_water"))
