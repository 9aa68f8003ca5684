"""Profiles, evidence, composite ranking, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry, labels, scores
from tidemark.functions.rounding import mean_rounded, rounded
from tidemark.operators import profiles, ranking, spatial
from tidemark.plans.registry import query
from tidemark.sources import adapters
from tidemark.sources.adapters import with_views

KEY = ["segment_id"]
_HEIGHTS = [f"WHEN swell_height_m >= {lo} AND swell_height_m < {hi} THEN" for lo, hi in zip(labels.SWELL_EDGES, labels.SWELL_EDGES[1:], strict=False)]
SWELL_BIN_SQL = "CASE " + " ".join(f"{w} '{n}'" for w, n in zip(_HEIGHTS, labels.band_labels(labels.SWELL_EDGES), strict=True)) + f" ELSE '>{labels.SWELL_EDGES[-1]}m' END"
SWELL_POS_SQL = "(" + " + ".join(f"CAST(swell_height_m >= {e} AS INT)" for e in labels.SWELL_EDGES[1:]) + ")"
SECTOR_SQL = "[" + ", ".join(f"'{s}'" for s in labels.SECTORS) + "][CAST(floor(swell_direction_deg / 45) AS INT) + 1]"
BINNED_SQL = f""", binned AS (SELECT segment_id, {SWELL_BIN_SQL} AS bin, {SWELL_POS_SQL} AS position, avg(foam_fraction) AS mean_foam, count(*) AS n
    FROM det WHERE swell_height_m IS NOT NULL AND foam_fraction IS NOT NULL GROUP BY ALL)"""
SECTORED_SQL = f""", sectored AS (SELECT segment_id, {SECTOR_SQL} AS sector, CAST(floor(swell_direction_deg / 45) AS INT) AS position, avg(foam_fraction) AS mean_foam, count(*) AS n
    FROM det WHERE swell_height_m IS NOT NULL AND foam_fraction IS NOT NULL GROUP BY ALL)"""
PROFILE_SQL = """ SELECT segment_id, count(*) AS observation_count,
    round(min(swell_height_m) FILTER (foam_fraction > 0.05), 2) AS turn_on_threshold_m, round(min(swell_height_m) FILTER (foam_fraction > 0.8), 2) AS blow_out_point_m,
    round(avg(foam_fraction) + 1e-9, 4) AS mean_foam, round(max(foam_fraction), 4) AS max_foam, round(stddev_pop(foam_fraction), 4) AS std_foam,
    CASE WHEN count(*) >= 3 THEN 'complete' ELSE 'insufficient_data' END AS status
    FROM det WHERE swell_height_m IS NOT NULL AND foam_fraction IS NOT NULL GROUP BY segment_id"""


@query(with_views("det", PROFILE_SQL))
def swell_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.response(adapters.detections(spark, sf_dir), KEY)


@query(with_views("det", BINNED_SQL + " SELECT segment_id, bin, position, round(mean_foam + 1e-9, 4) AS mean_foam, n FROM binned"))
def swell_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.swell_bins(adapters.detections(spark, sf_dir), KEY).withColumn("mean_foam", rounded("mean_foam", 4))


@query(
    with_views(
        "det",
        BINNED_SQL
        + """ SELECT segment_id, arg_max(bin, round(mean_foam + 1e-9, 4) * 100 - position) FILTER (n >= 2 AND round(mean_foam + 1e-9, 4) > 0 AND round(mean_foam + 1e-9, 4) = top) AS best_bin,
        max(round(mean_foam + 1e-9, 4)) FILTER (n >= 2 AND round(mean_foam + 1e-9, 4) > 0) AS best_mean
        FROM (SELECT *, max(CASE WHEN n >= 2 AND round(mean_foam + 1e-9, 4) > 0 THEN round(mean_foam + 1e-9, 4) END) OVER (PARTITION BY segment_id) AS top FROM binned) GROUP BY segment_id""",
    )
)
def best_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.best_bin(profiles.swell_bins(adapters.detections(spark, sf_dir), KEY), KEY)


@query(
    with_views(
        "det",
        BINNED_SQL
        + f""" SELECT *, CAST(optimal_min_m AS VARCHAR) || '-' || CAST(optimal_max_m AS VARCHAR) || 'm' AS label FROM (SELECT segment_id, min(lo) FILTER (n >= 2 AND round(mean_foam + 1e-9, 4) > 0.15) AS optimal_min_m, max(hi) FILTER (n >= 2 AND round(mean_foam + 1e-9, 4) > 0.15) AS optimal_max_m
        FROM (SELECT *, ({list(labels.SWELL_EDGES)}::DOUBLE[])[position + 1] AS lo, ({list(labels.SWELL_EDGES)}::DOUBLE[])[position + 2] AS hi FROM binned) GROUP BY segment_id)""",
    )
)
def optimal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.optimal_range(profiles.swell_bins(adapters.detections(spark, sf_dir), KEY), KEY)
    return found.withColumn("label", labels.range_label(F.col("optimal_min_m"), F.col("optimal_max_m")))


@query(
    with_views(
        "det",
        SECTORED_SQL
        + """ SELECT segment_id, count(*) FILTER (n >= 2 AND round(mean_foam + 1e-9, 4) > 0.05) AS n_responsive,
        coalesce(string_agg(sector, ',' ORDER BY position) FILTER (n >= 2 AND round(mean_foam + 1e-9, 4) > 0.05), '') AS responsive FROM sectored GROUP BY segment_id""",
    )
)
def direction_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.responsive_sectors(profiles.direction_bins(adapters.detections(spark, sf_dir), KEY), KEY)


@query(
    with_views(
        "det",
        SECTORED_SQL
        + """, good AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY round(mean_foam + 1e-9, 9) DESC, position) AS r FROM sectored WHERE n >= 2 AND mean_foam > 0)
        SELECT s.segment_id, sector AS best_sector, round(mean_foam + 1e-9, 4) AS best_mean FROM (SELECT DISTINCT segment_id FROM sectored) s LEFT JOIN good g ON g.segment_id = s.segment_id AND r = 1""",
    )
)
def primary_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unrounded means decide; nine digits stand for that, whatever the order of summing."""
    return profiles.best_bin(profiles.direction_bins(adapters.detections(spark, sf_dir), KEY), KEY, "sector", digits=9)


@query(
    with_views(
        "det",
        f""", binned AS (SELECT spot_id, segment_id, {SWELL_BIN_SQL} AS bin, avg(foam_fraction) AS mean_foam, count(*) AS n FROM det WHERE foam_fraction IS NOT NULL GROUP BY ALL)
        SELECT spot_id, bin, round(avg(round(mean_foam + 1e-9, 4)) + 1e-9, 4) AS mean_of_means, CAST(sum(n) AS BIGINT) AS n FROM binned GROUP BY spot_id, bin""",
    )
)
def spot_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.spot_profile(profiles.swell_bins(adapters.detections(spark, sf_dir), ["spot_id", "segment_id"]), "spot_id")


EVIDENCE_SQL = """, ev AS (SELECT segment_id, count(*) FILTER (ok) AS n_valid, max(foam_fraction) FILTER (ok) AS max_foam,
        coalesce(avg(foam_fraction) FILTER (ok AND coalesce(swell_height_m, 0) >= 1), 0) AS mean_swell_foam,
        count(*) FILTER (ok AND foam_fraction > 0.05) / nullif(count(*) FILTER (ok), 0) AS consistency,
        max(foam_fraction) FILTER (ok) - min(foam_fraction) FILTER (ok) AS foam_range,
        max(CASE WHEN ok AND swell_height_m < 0.5 AND foam_fraction > 0.2 THEN 1 ELSE 0 END) AS flat_day_foam
        FROM (SELECT *, coalesce(quality_score, 0) >= 60 AND foam_fraction IS NOT NULL AS ok FROM det) GROUP BY segment_id),
    foam AS (SELECT *, CASE WHEN n_valid > 0 THEN round(40 * (0.35 * least(max_foam / 0.5, 1) + 0.3 * least(mean_swell_foam / 0.3, 1) + 0.2 * consistency + 0.15 * least(foam_range / 0.4, 1)) + 1e-9, 2) END AS foam_component,
        flat_day_foam * 5.0 AS penalty FROM ev)"""


@query(
    with_views(
        "det",
        EVIDENCE_SQL
        + """ SELECT segment_id, n_valid, round(max_foam + 1e-9, 4) AS max_foam, round(mean_swell_foam + 1e-9, 4) AS mean_swell_foam, round(consistency + 1e-9, 4) AS consistency,
        round(foam_range + 1e-9, 4) AS foam_range, foam_component FROM foam""",
    )
)
def foam_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ranking.foam_evidence(adapters.detections(spark, sf_dir), KEY)
    return e.select("segment_id", "n_valid", *(rounded(c, 4).alias(c) for c in ("max_foam", "mean_swell_foam", "consistency", "foam_range")), "foam_component")


@query(with_views("det", EVIDENCE_SQL + " SELECT segment_id, CAST(penalty AS DOUBLE) AS penalty FROM foam WHERE penalty > 0"))
def false_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ranking.foam_evidence(adapters.detections(spark, sf_dir), KEY)
    return e.where("penalty > 0").select("segment_id", "penalty")


PROFILE_SCORE_SQL = (
    BINNED_SQL
    + SECTORED_SQL
    + """, prof AS (SELECT segment_id, count(*) AS obs, min(swell_height_m) FILTER (foam_fraction > 0.05) IS NOT NULL AS has_on FROM det
            WHERE swell_height_m IS NOT NULL AND foam_fraction IS NOT NULL GROUP BY segment_id HAVING count(*) >= 3),
        opt AS (SELECT segment_id, count(*) FILTER (n >= 2 AND round(mean_foam + 1e-9, 4) > 0.15) > 0 AS has_opt FROM binned GROUP BY segment_id),
        dirs AS (SELECT segment_id, count(*) FILTER (n >= 2 AND round(mean_foam + 1e-9, 4) > 0.05) AS nd FROM sectored GROUP BY segment_id),
        ps AS (SELECT segment_id, round(25 * (0.25 * CAST(has_on AS INT) + 0.25 * CAST(has_opt AS INT) + 0.25 * CASE WHEN nd > 0 THEN greatest(0, 1 - nd / 8) ELSE 0 END + 0.25 * least(obs / 30, 1)) + 1e-9, 2) AS profile_component
            FROM prof JOIN opt USING (segment_id) JOIN dirs USING (segment_id))"""
)


def _components(det: DataFrame) -> DataFrame:
    """Foam and profile components of every segment from one pass over the detections."""
    agg = ranking.with_foam_component(profiles.component(det, KEY, ranking.evidence_aggregates()))
    score = scores.profile_score(F.col("has_turn_on"), F.col("has_optimal"), F.col("n_responsive"), F.col("observation_count"))
    complete = F.col("observation_count") >= profiles.MIN_OBSERVATIONS
    return agg.select("segment_id", "foam_component", "penalty", F.when(complete, rounded(score, 2)).alias("profile_component"))


@query(with_views("det", PROFILE_SCORE_SQL + " SELECT segment_id, profile_component FROM ps"))
def profile_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(adapters.detections(spark, sf_dir)).where("profile_component is not null").select("segment_id", "profile_component")


COMPOSITE_SQL = (
    EVIDENCE_SQL
    + PROFILE_SCORE_SQL
    + """, comp AS (SELECT segment_id, chain, total_score,
            100 * (0.35 * total_score * 0.35 + coalesce(0.4 * foam_component, 0) + coalesce(0.25 * profile_component, 0))
              / (0.35 * 35 + CASE WHEN foam_component IS NULL THEN 0 ELSE 0.4 * 40 END + CASE WHEN profile_component IS NULL THEN 0 ELSE 0.25 * 25 END) AS raw,
            coalesce(penalty, 0) AS penalty, 1 + CAST(foam_component IS NOT NULL AS INT) + CAST(profile_component IS NOT NULL AS INT) AS confidence
        FROM seg LEFT JOIN foam USING (segment_id) LEFT JOIN ps USING (segment_id) WHERE total_score > 0),
    scored AS (SELECT segment_id, chain, total_score, confidence, penalty, round(CASE WHEN penalty > 0 THEN greatest(0, raw - penalty) ELSE raw END + 1e-9, 1) AS composite_score FROM comp)"""
)


def scored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _components(adapters.detections(spark, sf_dir))
    joined = adapters.segments(spark, sf_dir).where("total_score > 0").join(parts, "segment_id", "left")
    penalty = F.coalesce("penalty", F.lit(0.0))
    score = scores.composite(F.col("total_score"), F.col("foam_component"), F.col("profile_component"), penalty=penalty)
    confidence = F.lit(1) + F.col("foam_component").isNotNull().cast("int") + F.col("profile_component").isNotNull().cast("int")
    return joined.select("segment_id", "chain", "lat", "lon", "total_score", confidence.alias("confidence"), penalty.alias("penalty"), rounded(score, 1).alias("composite_score"))


@query(
    with_views(
        "det seg",
        COMPOSITE_SQL
        + """ SELECT segment_id, composite_score, confidence, CAST(penalty AS DOUBLE) AS penalty, row_number() OVER (ORDER BY composite_score DESC, segment_id) AS rank,
        round((1 - row_number() OVER (ORDER BY composite_score DESC, segment_id) / count(*) OVER ()) * 100, 1) AS percentile FROM scored""",
    )
)
def composite_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranking.ranked(scored_segments(spark, sf_dir), "composite_score", ["segment_id"])
    return r.select("segment_id", "composite_score", "confidence", "penalty", "rank", ranking.percentile_of_rank(F.col("rank"), F.col("n_total")).alias("percentile"))


@query(
    with_views(
        "seg",
        """ SELECT count(*) AS n, round(min(total_score), 4) AS min_score, round(max(total_score), 4) AS max_score, round(avg(total_score), 4) AS mean_score,
        round(quantile_cont(total_score, 0.5), 4) AS p50, round(quantile_cont(total_score, 0.75), 4) AS p75, round(quantile_cont(total_score, 0.9), 4) AS p90,
        round(quantile_cont(total_score, 0.95), 4) AS p95, round(quantile_cont(total_score, 0.99), 4) AS p99 FROM seg""",
    )
)
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.distribution(adapters.segments(spark, sf_dir), "total_score", places=1)


@query(with_views("seg", " SELECT chain, list_sort(list(total_score))[count(*) // 2 + 1] AS upper_median FROM seg GROUP BY chain"))
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.upper_median(adapters.segments(spark, sf_dir), ["chain"], "total_score", "upper_median")


@query(with_views("det seg", COMPOSITE_SQL + " SELECT confidence, count(*) AS n, count(*) FILTER (penalty > 0) AS n_penalised, round(avg(composite_score), 3) AS mean_score FROM scored GROUP BY confidence"))
def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_segments(spark, sf_dir)
    return s.groupBy("confidence").agg(F.count("*").alias("n"), F.count(F.when(F.col("penalty") > 0, 1)).alias("n_penalised"), mean_rounded("composite_score", 1, 3).alias("mean_score"))


NEAREST_SQL = """, pairs AS (SELECT k.spot_id, s.segment_id, sqrt((s.lon - k.lon) * (s.lon - k.lon) + (s.lat - k.lat) * (s.lat - k.lat)) AS d FROM known k, seg s),
    near AS (SELECT spot_id, segment_id, d FROM (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY round(d, 9), segment_id) AS r FROM pairs) WHERE r = 1)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = adapters.known_spots(spark, sf_dir).select("spot_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    targets = adapters.segments(spark, sf_dir).select("segment_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.nearest(known, targets, "spot_id", "segment_id")


@query(with_views("seg known", NEAREST_SQL + " SELECT spot_id, round(d, 6) AS distance FROM near"))
def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("spot_id", F.round("distance", 6).alias("distance"))


@query(
    with_views(
        "seg known",
        NEAREST_SQL
        + """ SELECT n.spot_id, round(100.0 * (SELECT count(*) FROM seg x WHERE x.total_score <= s.total_score) / (SELECT count(*) FROM seg), 3) AS share_at_or_below,
        (SELECT count(*) FROM seg x WHERE x.total_score > s.total_score) + 1 AS competition_rank FROM near n JOIN seg s USING (segment_id)""",
    )
)
def calibration_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at or below a score = all rows minus those above: one ranking gives both percentiles."""
    seg = adapters.segments(spark, sf_dir)
    r = ranking.ranked(seg.select("segment_id", "total_score"), "total_score", ["segment_id"])
    same = seg.groupBy("total_score").agg(F.count("*").alias("same"))
    matched = _nearest(spark, sf_dir).join(r, "segment_id").join(same, "total_score")
    below = F.col("n_total") - F.col("competition_rank") + 1
    return matched.select("spot_id", F.round(F.lit(100.0) * below / F.col("n_total"), 3).alias("share_at_or_below"), "competition_rank")


@query(
    with_views(
        "seg known",
        NEAREST_SQL
        + """ SELECT count(*) AS n_spots, round(avg(s.total_score), 4) AS mean_score, round(median(s.total_score), 4) AS median_score, round(max(d), 6) AS max_distance,
        count(*) FILTER (d <= 0.05) AS n_close FROM near n JOIN seg s USING (segment_id)""",
    )
)
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _nearest(spark, sf_dir).join(adapters.segments(spark, sf_dir), "segment_id")
    return m.agg(
        F.count("*").alias("n_spots"),
        mean_rounded("total_score", 1, 4).alias("mean_score"),
        F.round(F.median("total_score"), 4).alias("median_score"),
        F.round(F.max("distance"), 6).alias("max_distance"),
        F.count(F.when(F.col("distance") <= 0.05, 1)).alias("n_close"),
    )


@query(
    with_views(
        "seg",
        """ SELECT segment_id, round(CASE WHEN o <= 30 THEN 1.0 WHEN o <= 60 THEN 1 - (o - 30) / 30 WHEN o <= 90 THEN 0.5 * (1 - (o - 60) / 30) ELSE 0 END * least(exposure_arc_deg / 120, 1) * 40 + 1e-9, 1) AS swell_exposure_score
        FROM (SELECT *, abs(((orientation_deg - 170 + 180) % 360 + 360) % 360 - 180) AS o FROM seg)""",
    )
)
def swell_exposure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.segments(spark, sf_dir)
    return s.select("segment_id", rounded(geometry.swell_exposure(F.col("orientation_deg"), F.col("exposure_arc_deg")), 1).alias("swell_exposure_score"))


@query(
    with_views(
        "seg",
        """ SELECT segment_id, round(CASE WHEN d <= 200 THEN 15.0 WHEN d >= 5000 THEN 0 ELSE 15 * (1 - (d - 200) / 4800) END + 1e-9, 1) AS road_access_score
        FROM (SELECT segment_id, CAST(segment_id * 31 % 6000 AS DOUBLE) AS d FROM seg)""",
    )
)
def road_access_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = (F.col("segment_id") * 31 % 6000).cast("double")
    return adapters.segments(spark, sf_dir).select("segment_id", rounded(geometry.road_access(distance), 1).alias("road_access_score"))


TRANSECT_SQL = """, cell AS (SELECT segment_id, greatest(0, least(63, CAST(ceil((lon + 67) / 0.116 - 0.5) AS INT))) AS ix, greatest(0, least(499, CAST(ceil((lat - 43.3) / 0.0076 - 0.5) AS INT))) AS y0 FROM seg),
    deep AS (SELECT segment_id, k, -elevation AS depth FROM (SELECT *, least(499, y0 + k) AS iy FROM (SELECT *, unnest(range(5)) AS k FROM cell)) JOIN elev USING (iy, ix) WHERE elevation < 0),
    bath AS (SELECT segment_id, count(depth) AS n_wet, CASE WHEN count(depth) >= 2 THEN (arg_max(depth, k) - arg_min(depth, k)) / (count(depth) * 500) END AS slope FROM cell LEFT JOIN deep USING (segment_id) GROUP BY segment_id)"""
SLOPE_TEXT_SQL = "CASE WHEN n_wet < 2 THEN 'Shallow nearshore area' ELSE 'Nearshore gradient: ' || printf('%.3f', slope) || ' m/m' END"
BATHYMETRY_SQL = "CASE WHEN n_wet >= 2 THEN round(least(slope / 0.05, 1) * 20 + 1e-9, 1) ELSE 5.0 END"


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = adapters.segments(spark, sf_dir)
    return spatial.depth_profile(segments, adapters.elevations(spark, sf_dir), "segment_id", (-67.0, 43.3), (0.116, 0.0076), (64, 500))


@query(with_views("seg elev", TRANSECT_SQL + f" SELECT segment_id, n_wet, {BATHYMETRY_SQL} AS bathymetry_score, {SLOPE_TEXT_SQL} AS text FROM bath"))
def bathymetry_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the sea bed over the cells under water of a five-cell transect, as points and as text."""
    n, slope = F.col("n_wet"), F.col("slope")
    return _depths(spark, sf_dir).select("segment_id", "n_wet", rounded(geometry.bathymetry(n, slope), 1).alias("bathymetry_score"), labels.slope_text(n, slope).alias("text"))


@query(
    with_views(
        "seg elev",
        TRANSECT_SQL
        + f""", f AS (SELECT *, CASE WHEN o <= 30 THEN 1.0 WHEN o <= 60 THEN 1 - (o - 30) / 30 WHEN o <= 90 THEN 0.5 * (1 - (o - 60) / 30) ELSE 0 END AS share FROM (SELECT *, abs(((orientation_deg - 170 + 180) % 360 + 360) % 360 - 180) AS o FROM seg)),
        s AS (SELECT f.*, round(share * least(exposure_arc_deg / 120, 1) * 40 + 1e-9, 1) AS swell, total_score / 4 AS shape, {BATHYMETRY_SQL} AS bathymetry,
            CASE WHEN d <= 200 THEN 15.0 WHEN d >= 5000 THEN 0 ELSE 15 * (1 - (d - 200) / 4800) END AS road
            FROM (SELECT *, CAST(segment_id * 31 % 6000 AS DOUBLE) AS d FROM f) AS f JOIN bath USING (segment_id))
        SELECT segment_id, 'ns-seg-' || lpad(CAST(segment_id AS VARCHAR), 5, '0') AS code,
        'Faces ' || CAST(CAST(round_even(orientation_deg, 0) AS BIGINT) AS VARCHAR) || '° — ' || CASE WHEN share >= 0.8 THEN 'directly into Atlantic swell window' WHEN share >= 0.4 THEN 'oblique to primary swell' ELSE 'poor alignment with Atlantic swell' END AS facing,
        concat_ws('; ', CASE WHEN swell >= 30 THEN 'Excellent swell exposure' WHEN swell >= 20 THEN 'Good swell alignment' END, CASE WHEN shape >= 15 THEN 'Favorable coastal geometry' END, CASE WHEN road >= 10 THEN 'Good road access' END) AS highlights,
        concat_ws('; ', CASE WHEN bathymetry = 0 THEN 'No bathymetry data available' END, CASE WHEN road = 0 THEN 'Remote — no nearby road access' END, CASE WHEN exposure_arc_deg < 60 THEN 'Limited ocean exposure' END) AS caveats FROM s""",
    )
)
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scores of each segment rest on, in words."""
    s = adapters.segments(spark, sf_dir).join(_depths(spark, sf_dir), "segment_id")
    swell = rounded(geometry.swell_exposure(F.col("orientation_deg"), F.col("exposure_arc_deg")), 1)
    road = geometry.road_access((F.col("segment_id") * 31 % 6000).cast("double"))
    bathymetry = rounded(geometry.bathymetry(F.col("n_wet"), F.col("slope")), 1)
    return s.select(
        "segment_id",
        F.format_string("ns-seg-%05d", "segment_id").alias("code"),
        labels.facing_text(F.col("orientation_deg"), geometry.facing_share(F.col("orientation_deg"))).alias("facing"),
        F.array_join(labels.highlights(swell, F.col("total_score") / 4, road), "; ").alias("highlights"),
        F.array_join(labels.caveats(bathymetry, road, F.col("exposure_arc_deg")), "; ").alias("caveats"),
    )


@query(with_views("det", ", p AS (" + PROFILE_SQL + ") SELECT count(*) FILTER (status = 'complete') AS n_complete, count(*) FILTER (status <> 'complete') AS n_insufficient, min(turn_on_threshold_m) AS min_turn_on, max(turn_on_threshold_m) AS max_turn_on, round(avg(turn_on_threshold_m), 4) AS mean_turn_on FROM p"))
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles.response(adapters.detections(spark, sf_dir), KEY)
    return p.agg(
        F.count(F.when(F.col("status") == "complete", 1)).alias("n_complete"),
        F.count(F.when(F.col("status") != "complete", 1)).alias("n_insufficient"),
        F.min("turn_on_threshold_m").alias("min_turn_on"),
        F.max("turn_on_threshold_m").alias("max_turn_on"),
        mean_rounded("turn_on_threshold_m", 2, 4).alias("mean_turn_on"),
    )
