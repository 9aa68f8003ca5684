"""Geometry: edges, pieces, exposure, tiling, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import geometry, labels
from tidemark.functions.rounding import mean_rounded, rounded
from tidemark.operators import atlas, spatial
from tidemark.plans.registry import query
from tidemark.sources import adapters
from tidemark.sources.adapters import with_views

EDGE_SQL = """, e0 AS (SELECT line_id, i, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS yb FROM poly WINDOW w AS (PARTITION BY line_id ORDER BY i)),
    e1 AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay)) AS length FROM e0 WHERE bx IS NOT NULL),
    edge AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e1)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.edges(adapters.polylines(spark, sf_dir), "line_id", "i")


@query(
    with_views(
        "poly",
        EDGE_SQL
        + """, t AS (SELECT line_id, sum(length) AS total, arg_min(ax, i) AS x0, arg_min(ay, i) AS y0, arg_max(bx, i) AS x1, arg_max(yb, i) AS y1, count(*) + 1 AS points FROM edge GROUP BY line_id)
        SELECT line_id, points, round(total, 3) AS length_m, round(CASE WHEN points >= 3 AND straight > 0 THEN least((total / straight - 1) * 5, 0.3) ELSE 0 END, 4) AS bonus, round((degrees(atan2(x1 - x0, y1 - y0)) + 360) % 360, 3) AS bearing
        FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS straight FROM t)""",
    )
)
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _edges(spark, sf_dir).groupBy("line_id").agg(
        F.sum("length").alias("total"), (F.count("*") + 1).alias("points"), F.min_by("ax", "i").alias("x0"), F.min_by("ay", "i").alias("y0"), F.max_by("bx", "i").alias("x1"), F.max_by("by", "i").alias("y1")
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    bonus = geometry.sinuosity_bonus(F.col("total"), F.hypot(dx, dy), F.col("points"))
    return ends.select("line_id", "points", F.round("total", 3).alias("length_m"), F.round(bonus, 4).alias("bonus"), F.round(geometry.bearing(dx, dy), 3).alias("bearing"))


@query(
    with_views(
        "poly",
        EDGE_SQL
        + """, t AS (SELECT line_id, sum(length) AS total FROM edge GROUP BY line_id HAVING sum(length) >= 500), p AS (SELECT line_id, unnest(range(CAST(floor((total - 500) / 250) AS BIGINT) + 1)) AS k FROM t),
        z AS (SELECT p.line_id, k, min(start + length) FILTER (start + length > k * 250) AS nx FROM p JOIN edge USING (line_id) GROUP BY ALL)
        SELECT p.line_id, CAST(p.k AS BIGINT) AS k, round(ax + (k * 250 - start) / length * (bx - ax), 3) AS from_x, round(ay + (k * 250 - start) / length * (yb - ay), 3) AS from_y
        FROM p JOIN edge e ON e.line_id = p.line_id AND start <= k * 250 AND k * 250 < start + length""",
    )
)
def segment_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 m pieces every 250 m."""
    p = spatial.pieces(_edges(spark, sf_dir), "line_id", 500.0, 250.0)
    return p.select("line_id", F.col("k").cast("long").alias("k"), F.round("ax", 3).alias("from_x"), F.round("ay", 3).alias("from_y"))


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = adapters.polylines(spark, sf_dir).where("i = 0")
    return first.select(F.col("line_id").alias("origin"), "x", "y", (F.col("line_id") * 37 % 360).cast("double").alias("facing"))


ORIGIN_SQL = ", origin AS (SELECT line_id AS origin, x, y, CAST(line_id * 37 % 360 AS DOUBLE) AS facing FROM poly WHERE i = 0)"


@query(
    with_views(
        "poly",
        EDGE_SQL
        + ORIGIN_SQL
        + """, met AS (SELECT origin, facing, x, y, ax, ay, bx, yb FROM origin, edge WHERE least(ax, bx) <= x + 500 AND greatest(ax, bx) >= x - 500 AND least(ay, yb) <= y + 500 AND greatest(ay, yb) >= y - 500),
        ray AS (SELECT *, x + sin(radians(facing + turn)) * 500 AS qx, y + cos(radians(facing + turn)) * 500 AS qy FROM (SELECT *, unnest(range(-90, 91, 5)) AS turn FROM met)),
        c AS (SELECT origin, turn, x, y, qx - x AS rx, qy - y AS ry, ax, ay, bx - ax AS sx, yb - ay AS sy FROM ray),
        h AS (SELECT DISTINCT origin, turn FROM (SELECT *, rx * sy - ry * sx AS det FROM c) WHERE abs(det) > 1e-12 AND ((ax - x) * sy - (ay - y) * sx) / det * 500 > 1 AND ((ax - x) * sy - (ay - y) * sx) / det <= 1
            AND ((ax - x) * ry - (ay - y) * rx) / det BETWEEN 0 AND 1)
        SELECT o.origin, CAST((37 - count(turn)) * 5 AS BIGINT) AS exposure_arc_deg FROM origin o LEFT JOIN h USING (origin) GROUP BY o.origin""",
    )
)
def exposure_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """37 rays of 500 m from the head of each line against the edges of all lines."""
    return spatial.exposure_arc(_origins(spark, sf_dir), _edges(spark, sf_dir), "origin", "facing", 500.0)


@query(
    with_views(
        "poly",
        EDGE_SQL
        + ORIGIN_SQL
        + """, c AS (SELECT origin, line_id, x, y, ax, ay, bx, yb, greatest(0, least(1, coalesce(((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / nullif(length * length, 0), 0))) AS t FROM origin, edge),
        d AS (SELECT origin, line_id, min(sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (yb - ay)) * (y - ay - t * (yb - ay)))) AS d FROM c GROUP BY ALL)
        SELECT origin, line_id, round(d, 3) AS distance FROM d WHERE d <= 40""",
    )
)
def grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within 40 m of the heads of lines."""
    found = spatial.within(_origins(spark, sf_dir), _edges(spark, sf_dir), "origin", "line_id", 40.0)
    return found.withColumn("distance", F.round("distance", 3))


@query(
    with_views(
        "poly",
        EDGE_SQL
        + ORIGIN_SQL
        + """, q AS (SELECT origin, (bx - ax) * (bx - ax) + (yb - ay) * (yb - ay) AS a, 2 * ((ax - x) * (bx - ax) + (ay - y) * (yb - ay)) AS b, (ax - x) * (ax - x) + (ay - y) * (ay - y) AS c FROM origin, edge),
        r AS (SELECT origin, a, """
        + ", ".join(
            f"CASE WHEN b * b - 4 * a * (c - {r * r}) > 0 THEN greatest(0, least(1, (-b + sqrt(greatest(b * b - 4 * a * (c - {r * r}), 0))) / (2 * a)) - greatest(0, (-b - sqrt(greatest(b * b - 4 * a * (c - {r * r}), 0))) / (2 * a))) * sqrt(a) ELSE 0 END AS in_{r}"
            for r in (100, 50)
        )
        + """ FROM q WHERE a > 0)
        SELECT origin, round(sum(in_100 - in_50), 2) AS ring_length, round(least((least(sum(in_100 - in_50) / 6000, 1) + 0.1) * 25, 25), 3) AS shape_score FROM r WHERE in_100 - in_50 > 0 GROUP BY origin""",
    )
)
def ring_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spatial.annulus_length(_origins(spark, sf_dir), _edges(spark, sf_dir), "origin", 50.0, 100.0)
    score = geometry.shape_score(F.col("ring_length"), F.lit(0.1))
    return r.select("origin", F.round("ring_length", 2).alias("ring_length"), F.round(score, 3).alias("shape_score"))


@query(
    with_views(
        "poly",
        EDGE_SQL
        + ORIGIN_SQL
        + """, t AS (SELECT origin, facing, turn, x + sin(radians(facing + turn)) * 200 AS x, y + cos(radians(facing + turn)) * 200 AS y FROM (SELECT *, unnest([90, -90]) AS turn FROM origin)),
        c AS (SELECT origin, facing, turn, x, y, ax, ay, bx, yb, greatest(0, least(1, coalesce(((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / nullif(length * length, 0), 0))) AS u FROM t, edge),
        d AS (SELECT origin, facing, turn, min(sqrt((x - ax - u * (bx - ax)) * (x - ax - u * (bx - ax)) + (y - ay - u * (yb - ay)) * (y - ay - u * (yb - ay)))) AS d FROM c GROUP BY ALL)
        SELECT origin, (facing + turn + 360) % 360 AS normal_deg FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY CASE WHEN d <= 100 THEN round(d, 6) ELSE 1e9 END DESC, turn DESC) AS r FROM d) WHERE r = 1""",
    )
)
def seaward_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.seaward_normal(_origins(spark, sf_dir), _edges(spark, sf_dir), "origin", "facing", 100.0)


@query(
    with_views(
        "seg known",
        """, d AS (SELECT segment_id, spot_id, sqrt((s.lon - k.lon) * (s.lon - k.lon) + (s.lat - k.lat) * (s.lat - k.lat)) AS d FROM seg s, known k)
        SELECT segment_id, arg_min(spot_id, (round(d, 9), spot_id)) AS spot_id, round(min(d), 6) AS distance FROM d WHERE d <= 0.5 GROUP BY segment_id""",
    )
)
def nearest_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest known spot within half a degree of each segment."""
    points = adapters.segments(spark, sf_dir).select("segment_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    spots = adapters.known_spots(spark, sf_dir).select("spot_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.nearest(points, spots, "segment_id", "spot_id", 0.5).withColumn("distance", F.round("distance", 6))


DISTANCE_SQL = "sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (yb - ay)) * (y - ay - t * (yb - ay)))"
ALONG_SQL = "greatest(0, least(1, coalesce(((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / nullif(length * length, 0), 0)))"


@query(
    with_views(
        "poly",
        EDGE_SQL
        + ORIGIN_SQL
        + f""", c AS (SELECT origin, line_id, i, x, y, ax, ay, bx, yb, length, start, {ALONG_SQL} AS t FROM (SELECT origin, x + 37 AS x, y + 53 AS y FROM origin), edge),
        d AS (SELECT *, {DISTANCE_SQL} AS d FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY round(d, 9), line_id, i) AS r FROM d WHERE d <= 100),
        f AS (SELECT origin, line_id, d, (start + t * length) / total AS fraction FROM n JOIN (SELECT line_id, sum(length) AS total FROM edge GROUP BY line_id) USING (line_id) WHERE r = 1)
        SELECT origin, line_id, round(d, 3) AS distance, round(fraction, 6) AS fraction, row_number() OVER (PARTITION BY line_id ORDER BY round(fraction, 6), origin) AS place FROM f""",
    )
)
def chain_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line nearest to a place beside the head of each line, within 100 m, and the places' order along it."""
    places = _origins(spark, sf_dir).select("origin", (F.col("x") + 37).alias("x"), (F.col("y") + 53).alias("y"))
    found = spatial.nearest_line(places, _edges(spark, sf_dir), "origin", "line_id", 100.0)
    found = found.withColumns({"distance": F.round("distance", 3), "fraction": F.round("fraction", 6)})
    return found.withColumn("place", F.row_number().over(Window.partitionBy("line_id").orderBy("fraction", "origin")))


ROAD_SQL = f""", c AS (SELECT origin, x, y, ax, ay, bx, yb, {ALONG_SQL} AS t FROM (SELECT origin, x - 90 AS x, y - 2000 AS y FROM origin), edge),
    near AS (SELECT origin, min(d) AS d FROM (SELECT origin, {DISTANCE_SQL} AS d FROM c) WHERE d <= 5000 GROUP BY origin)"""


@query(
    with_views(
        "poly",
        EDGE_SQL
        + ORIGIN_SQL
        + ROAD_SQL
        + """ SELECT origin, round(d, 3) AS distance, round(CASE WHEN d IS NULL OR d >= 5000 THEN 0 WHEN d <= 200 THEN 15.0 ELSE 15 * (1 - (d - 200) / 4800) END + 1e-9, 1) AS road_access_score,
        CASE WHEN d IS NULL THEN 'No road within 5km' WHEN d <= 200 THEN 'Road access within ' || CAST(CAST(round_even(d, 0) AS BIGINT) AS VARCHAR) || 'm' ELSE 'Road ' || CAST(CAST(round_even(d, 0) AS BIGINT) AS VARCHAR) || 'm away' END AS text
        FROM origin LEFT JOIN near USING (origin)""",
    )
)
def road_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of a place south of each line's head to the nearest line, as a road, within 5 km, its score and text."""
    heads = _origins(spark, sf_dir)
    places = heads.select("origin", (F.col("x") - 90).alias("x"), (F.col("y") - 2000).alias("y"))
    near = spatial.nearest_line(places, _edges(spark, sf_dir), "origin", "line_id", 5000.0, 500.0).select("origin", "distance")
    joined = heads.select("origin").join(near, "origin", "left")
    return joined.select("origin", F.round("distance", 3).alias("distance"), rounded(geometry.road_access(F.col("distance")), 1).alias("road_access_score"), labels.road_text(F.col("distance")).alias("text"))


@query(
    with_views(
        "poly",
        EDGE_SQL
        + ORIGIN_SQL
        + f""", p AS (SELECT origin * 8 + k AS point, x + sin(radians(facing + 180 * (k % 2))) * (30 + 60 * (k // 2)) AS x, y + cos(radians(facing + 180 * (k % 2))) * (30 + 60 * (k // 2)) AS y FROM (SELECT *, unnest(range(8)) AS k FROM origin)),
        m AS (SELECT e.*, sin(radians(o.facing + 180)) * 200 AS dx, cos(radians(o.facing + 180)) * 200 AS dy FROM edge e JOIN origin o ON o.origin = e.line_id),
        n AS (SELECT point, line_id, min({DISTANCE_SQL}) AS near FROM (SELECT point, line_id, x, y, ax, ay, bx, yb, {ALONG_SQL} AS t FROM p, m) GROUP BY ALL),
        l AS (SELECT point, line_id, min({DISTANCE_SQL}) AS land FROM (SELECT point, line_id, x, y, ax, ay, bx, yb, {ALONG_SQL} AS t FROM (SELECT point, line_id, x, y, length, ax + dx AS ax, ay + dy AS ay, bx + dx AS bx, yb + dy AS yb FROM p, m)) GROUP BY ALL)
        SELECT point, line_id FROM n JOIN l USING (point, line_id) WHERE near <= 200 AND land > 100""",
    )
)
def seaward_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places before and behind the head of each line that lie in a line's seaward buffer of 200 m."""
    heads = _origins(spark, sf_dir)
    k = heads.select("origin", "x", "y", "facing", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    px, py = geometry.ray_end(F.col("x"), F.col("y"), 30 + 60 * F.floor(F.col("k") / 2), F.col("facing") + 180 * (F.col("k") % 2))
    points = k.select((F.col("origin") * 8 + F.col("k")).alias("point"), px.alias("x"), py.alias("y"))
    faced = _edges(spark, sf_dir).join(heads.select(F.col("origin").alias("line_id"), "facing"), "line_id")
    return spatial.seaward_side(points, faced, "point", "line_id", "facing", 200.0)


@query(with_views("seg", " SELECT segment_id, round(200 / (111000 * cos(radians(44.6::DOUBLE))) * sin(radians((orientation_deg + 180) % 360)), 9) AS east, round(200 / 111000::DOUBLE * cos(radians((orientation_deg + 180) % 360)), 9) AS north FROM seg"))
def landward_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geometry.landward_offset(F.col("orientation_deg"))
    return adapters.segments(spark, sf_dir).select("segment_id", F.round(east, 9).alias("east"), F.round(north, 9).alias("north"))


_TM = """SELECT segment_id, lon, lat, radians(lat) AS phi, radians(lon + 63) AS lam FROM seg"""


def _utm_sql() -> str:
    n = (1 / geometry.INV_F) / (2 - 1 / geometry.INV_F)
    e = (1 - (1 - 1 / geometry.INV_F) ** 2) ** 0.5
    radius = geometry.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    east = " + ".join(f"{a:.17e} * cos(xi * {2 * j}) * (exp(eta * {2 * j}) - exp(-eta * {2 * j})) / 2" for j, a in enumerate(alpha, 1))
    north = " + ".join(f"{a:.17e} * sin(xi * {2 * j}) * (exp(eta * {2 * j}) + exp(-eta * {2 * j})) / 2" for j, a in enumerate(alpha, 1))
    k = geometry.K0 * radius
    return with_views(
        "seg",
        f""", a AS ({_TM}), b AS (SELECT *, ln((1 + sin(phi)) / (1 - sin(phi))) / 2 - {e!r}::DOUBLE * ln((1 + {e!r}::DOUBLE * sin(phi)) / (1 - {e!r}::DOUBLE * sin(phi))) / 2 AS u FROM a),
        c AS (SELECT *, (exp(u) - exp(-u)) / 2 AS t FROM b), d AS (SELECT *, atan2(t, cos(lam)) AS xi, ln((1 + sin(lam) / sqrt(1 + t * t)) / (1 - sin(lam) / sqrt(1 + t * t))) / 2 AS eta FROM c)
        SELECT segment_id, round(500000 + (eta + {east}) * {k!r}::DOUBLE, 2) AS easting, round((xi + {north}) * {k!r}::DOUBLE, 2) AS northing FROM d""",
    )


@query(_utm_sql())
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geometry.utm(F.col("lon"), F.col("lat"))
    return adapters.segments(spark, sf_dir).select("segment_id", F.round(east, 2).alias("easting"), F.round(north, 2).alias("northing"))


TILE_SQL = """, o AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY segment_id) - 1 AS pos, count(*) OVER (PARTITION BY chain) AS n FROM seg),
    g AS (SELECT o.*, x.g FROM o JOIN (SELECT unnest(range(2000)) AS g) x ON x.g * 5 <= pos AND pos < x.g * 5 + 6 WHERE n - x.g * 5 >= 2),
    sec AS (SELECT chain, g, count(*) AS segment_count, round(avg(lat), 6) AS centroid_lat, round(avg(lon), 6) AS centroid_lon, round(min(lon) - 0.005, 6) AS west, round(min(lat) - 0.005, 6) AS south,
        round(max(lon) + 0.005, 6) AS east, round(max(lat) + 0.005, 6) AS north, round(avg(total_score) + 1e-9, 1) AS mean_score, max(total_score) AS max_score, count(*) * 250.0 AS coastline_length_m, string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY pos) AS segment_ids FROM g GROUP BY chain, g)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.sections(atlas.tiled(adapters.segments(spark, sf_dir), "chain", ["segment_id"]), "chain")


@query(
    with_views(
        "seg",
        TILE_SQL
        + """ SELECT 'atlas-' || lpad(CAST(row_number() OVER (ORDER BY chain, g) AS VARCHAR), 4, '0') AS section_id, chain, CAST(g AS BIGINT) AS g, segment_count, centroid_lat, centroid_lon, west, south, east, north, mean_score, max_score, CAST(coastline_length_m AS DOUBLE) AS coastline_length_m, segment_ids
        FROM sec WHERE max_score > 40""",
    )
)
def tile_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of six with one overlap whose best score is above 40, numbered in order."""
    s = atlas.numbered(_sections(spark, sf_dir).where("max_score > 40"), ["chain", "g"])
    return s.withColumn("g", F.col("g").cast("long")).select("section_id", "chain", "g", "segment_count", "centroid_lat", "centroid_lon", "west", "south", "east", "north", "mean_score", "max_score", "coastline_length_m", "segment_ids")


@query(
    with_views(
        "seg",
        TILE_SQL
        + """ SELECT count(*) AS n_sections, CAST(sum(segment_count) AS BIGINT) AS n_covered, round(avg(mean_score), 3) AS mean_score, count(*) FILTER (mean_score >= 40) AS at_40, count(*) FILTER (mean_score >= 50) AS at_50,
        count(*) FILTER (mean_score >= 60) AS at_60, count(*) FILTER (mean_score >= 70) AS at_70, min(south) AS south, max(north) AS north FROM sec""",
    )
)
def atlas_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.count(F.when(F.col("mean_score") >= k, 1)).alias(f"at_{k}")
    return _sections(spark, sf_dir).agg(F.count("*").alias("n_sections"), F.sum("segment_count").alias("n_covered"), mean_rounded("mean_score", 1, 3).alias("mean_score"), *map(at, (40, 50, 60, 70)), F.min("south").alias("south"), F.max("north").alias("north"))


CHAIN_SQL = """WITH RECURSIVE e AS (SELECT l_partkey AS edge, l_partkey AS u, (l_partkey * 7 + 3) % 1000003 AS v, CAST(min(l_quantity) AS DOUBLE) AS length FROM lineitem GROUP BY l_partkey),
    p AS (SELECT min(edge) AS a, max(edge) AS b FROM (SELECT edge, unnest([u, v]) AS point FROM e) GROUP BY point HAVING count(*) = 2 AND min(edge) <> max(edge)),
    l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r AS (SELECT edge, edge AS other FROM e UNION SELECT r.edge, l.b FROM r JOIN l ON l.a = r.other),
    c AS (SELECT chain, count(*) AS n_edges, sum(length) AS length FROM (SELECT edge, min(other) AS chain FROM r GROUP BY edge) JOIN e USING (edge) GROUP BY chain)"""


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each part that is sold, from its number to a number seven times as far."""
    line = adapters.table(spark, sf_dir, "lineitem")
    edge = line.groupBy(F.col("l_partkey").alias("edge")).agg(F.min("l_quantity").cast("double").alias("length"))
    return edge.select("edge", F.col("edge").alias("u"), ((F.col("edge") * 7 + 3) % 1_000_003).alias("v"), "length")


@query(CHAIN_SQL + " SELECT chain, n_edges FROM c")
def chain_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges merged to chains where exactly two meet."""
    return atlas.chains(_part_edges(spark, sf_dir)).groupBy("chain").agg(F.count("*").alias("n_edges"))


@query(CHAIN_SQL + " SELECT chain, n_edges, length, row_number() OVER (ORDER BY length DESC, chain) AS place FROM c WHERE length > 3")
def chain_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains longer than 3, in the order of their lengths."""
    return atlas.measured(_part_edges(spark, sf_dir), 3.0)


@query(with_views("seg", " SELECT segment_id, lat, lon FROM seg WHERE lat BETWEEN 44 AND 45 AND lon BETWEEN -64 AND -62"))
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.segments(spark, sf_dir)
    return s.where(F.col("lat").between(44, 45) & F.col("lon").between(-64, -62)).select("segment_id", "lat", "lon")


@query(
    with_views(
        "seg",
        """ SELECT segment_id, CASE WHEN ok THEN greatest(0, least(CAST(trunc((lon + 64) / 2 * 800) AS INT), 799)) END AS x, CASE WHEN ok THEN greatest(0, least(CAST(trunc((45 - lat) / 1 * 600) AS INT), 599)) END AS y
        FROM (SELECT *, lat >= 44 - 0.001 AND lat <= 45 + 0.001 AND lon >= -64 - 0.001 AND lon <= -62 + 0.001 AS ok FROM seg)""",
    )
)
def image_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geometry.to_pixel(F.col("lat"), F.col("lon"), (-64.0, 44.0, -62.0, 45.0), 800, 600)
    return adapters.segments(spark, sf_dir).select("segment_id", x.alias("x"), y.alias("y"))
