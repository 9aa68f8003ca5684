"""Serving views, joins, manifests, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.rounding import exact_mean, rounded
from tidemark.operators import profiles, series, views
from tidemark.operators.scenes import top_in_group
from tidemark.plans.evidence import COMPOSITE_SQL, PROFILE_SQL, scored_segments
from tidemark.plans.registry import query
from tidemark.plans.scene_plans import SCENE_SQL, _scenes
from tidemark.sources import adapters, documents
from tidemark.sources.adapters import table, with_views


@query(with_views("det seg", COMPOSITE_SQL + " SELECT segment_id, coalesce(nullif(composite_score, 0), total_score, 0) AS score, confidence, composite_score > 50 AS high FROM scored WHERE coalesce(nullif(composite_score, 0), total_score, 0) > 30"))
def segments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows above the lower threshold; those above the higher one are flagged."""
    score = F.coalesce(F.nullif("composite_score", F.lit(0.0)), "total_score", F.lit(0.0))
    rows = scored_segments(spark, sf_dir).withColumn("score", score).where("score > 30")
    return rows.select("segment_id", "score", "confidence", (F.col("composite_score") > 50).alias("high"))


@query(with_views("det seg", COMPOSITE_SQL + " SELECT segment_id, composite_score FROM scored ORDER BY composite_score DESC, segment_id LIMIT 50"))
def ranking_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best segments: a top-k report."""
    return scored_segments(spark, sf_dir).select("segment_id", "composite_score").orderBy(F.desc("composite_score"), "segment_id").limit(50)


@query("""WITH d AS (SELECT l_suppkey AS s, count(*) AS n_detections FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) SELECT s_suppkey AS spot_id, s_name AS name, coalesce(n_detections, 0) AS n_detections, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07) AS has_profile, n_name AS station
    FROM supplier LEFT JOIN d ON s = s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""")
def spots_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots with their counts, whether a profile exists, and their station."""
    line = table(spark, sf_dir, "lineitem")
    agg = line.groupBy(F.col("l_suppkey").alias("spot_id")).agg(F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("n_detections"), F.bool_or(F.col("l_tax") > 0.07).alias("has_profile"))
    spots = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("s_suppkey").alias("spot_id"), F.col("s_name").alias("name"), F.col("n_name").alias("station"))
    return spots.join(agg, "spot_id", "left").select("spot_id", "name", F.coalesce("n_detections", F.lit(0)).alias("n_detections"), F.coalesce("has_profile", F.lit(False)).alias("has_profile"), "station")


@query("SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS run FROM orders")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries replace old ones of the same slug."""
    orders = table(spark, sf_dir, "orders")
    old = orders.select(F.col("o_orderkey").alias("slug"), F.col("o_totalprice").alias("value"), F.lit("old").alias("run"))
    new = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("slug"), (F.col("o_totalprice") * 2).alias("value"), F.lit("new").alias("run"))
    return views.upsert(old, new, "slug")


@query("""WITH u AS (SELECT o_custkey AS segment_id, o_custkey % 4 AS file, CAST(floor(o_totalprice / 1000) AS BIGINT) AS observation_count, o_orderkey AS pos FROM orders UNION ALL SELECT o_custkey, 9, CAST(floor(o_totalprice / 1000) AS BIGINT), o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
    SELECT segment_id, observation_count, file FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY observation_count DESC, file, pos) AS r FROM u) WHERE r = 1""")
def union_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the profiles of all files, the one with most observations; the first file wins ties."""
    o = table(spark, sf_dir, "orders")
    cols = lambda file: (F.col("o_custkey").alias("segment_id"), file.alias("file"), F.floor(F.col("o_totalprice") / 1000).alias("observation_count"), F.col("o_orderkey").alias("pos"))
    every = o.select(*cols(F.col("o_custkey") % 4)).unionByName(o.where("o_orderkey % 2 = 0").select(*cols(F.lit(9))))
    return views.best_per_key(every, "segment_id", [F.desc("observation_count"), F.col("file"), F.col("pos")]).select("segment_id", "observation_count", "file")


@query("""SELECT event_id AS flag_id, user_id AS section_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(n_name, '') AS note, event_type = 'click' AS certain FROM events LEFT JOIN nation ON n_nationkey = user_id WHERE json_extract(props, '$.k') IS NOT NULL""")
def flags_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags with a well-formed body, and the name of their section if it is known."""
    flags = table(spark, sf_dir, "events").withColumn("body", F.from_json("props", "k long")).where("body.k is not null")
    named = flags.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("user_id"), "left")
    return named.select(F.col("event_id").alias("flag_id"), F.col("user_id").alias("section_id"), F.col("body.k").alias("k"), F.coalesce("n_name", F.lit("")).alias("note"), (F.col("event_type") == "click").alias("certain"))


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text || ' seen 2024-0' || (doc_id % 9 + 1) || '-15 and 2023-11-02', '\\b\\d{4}-\\d{2}-\\d{2}\\b')) AS d FROM documents) SELECT d AS day, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY d""")
def date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in texts, each with how often and where it stands."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat("text", F.lit(" seen 2024-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-15 and 2023-11-02"))
    found = docs.select("doc_id", F.explode(views.dates_in(text)).alias("day"))
    return found.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(with_views("det", " SELECT spot_id, count(*) AS total_detections, count(DISTINCT scene_date) AS scenes, count(DISTINCT scene_date) FILTER (foam_fraction > 0.05) AS scenes_with_foam, count(*) FILTER (coalesce(quality_score, 0) >= 80) AS high_quality, count(*) FILTER (coalesce(quality_score, 0) >= 60) AS usable, count(*) FILTER (coalesce(quality_score, 0) < 40) AS discarded, round(avg(quality_score), 3) AS mean_quality FROM det GROUP BY spot_id"))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.run_summary(adapters.detections(spark, sf_dir), ["spot_id"])


@query(with_views("det", " SELECT coalesce(CAST(spot_id AS VARCHAR), 'all') AS spot, count(*) AS n, round(sum(foam_fraction), 3) AS foam FROM det GROUP BY ROLLUP (spot_id)"))
def spot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.detections(spark, sf_dir).rollup("spot_id").agg(F.count("*").alias("n"), F.round(F.sum("foam_fraction"), 3).alias("foam"))
    return r.select(F.coalesce(F.col("spot_id").cast("string"), F.lit("all")).alias("spot"), "n", "foam")


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1")
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_scenes FROM orders GROUP BY 1), e AS (SELECT (CAST(ts AS DATE) - INTERVAL 27 YEAR)::DATE AS day, arg_max(value, event_id) AS value, max(event_id) AS last_event FROM events GROUP BY 1)
    SELECT strftime(d.day, '%Y-%m-%d') AS date, n_scenes, value, last_event, CASE WHEN value IS NULL THEN 'unclear' WHEN value > 0 THEN 'present' ELSE 'none' END AS label FROM d LEFT JOIN e USING (day)""")
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene days with the last condition of the day, if any."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n_scenes"))
    last = table(spark, sf_dir, "events").groupBy(F.add_months(F.to_date("ts"), -12 * 27).alias("day")).agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("last_event"))
    label = F.when(F.col("value").isNull(), "unclear").when(F.col("value") > 0, "present").otherwise("none")
    return days.join(last, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("date"), "n_scenes", "value", "last_event", label.alias("label"))


@query("""SELECT page_id, '/gallery/' || page_id || '.png' AS rgb_path, CASE WHEN page_id % 3 = 0 THEN '/gallery/' || page_id || '_annotated.png' END AS annotated_path, coalesce(CASE WHEN page_id % 3 = 0 THEN '/gallery/' || page_id || '_annotated.png' END, '/gallery/' || page_id || '.png') AS shown,
    regexp_replace(url, '^https?://(www\\.)?', '') AS label FROM pages""")
def pretty_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web paths; the annotated picture is shown if there is one."""
    p = table(spark, sf_dir, "pages")
    raw = F.concat(F.lit("data/gallery/"), F.col("page_id").cast("string"), F.lit(".png"))
    rgb = views.web_path(raw)
    annotated = F.when(F.col("page_id") % 3 == 0, views.annotated_path(rgb))
    return p.select("page_id", rgb.alias("rgb_path"), annotated.alias("annotated_path"), F.coalesce(annotated, rgb).alias("shown"), F.regexp_replace("url", r"^https?://(www\.)?", "").alias("label"))


@query("SELECT c_custkey, 'idle' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'active' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    idle = customers.join(orders, on, "left_anti").select("c_custkey", F.lit("idle").alias("kind"))
    return idle.unionByName(customers.join(orders.where("o_totalprice > 200000"), on, "left_semi").select("c_custkey", F.lit("active").alias("kind")))


@query(with_views("seg", " SELECT chain, round(avg(total_score), 4) AS mean_score, count(*) AS n FROM seg GROUP BY chain HAVING avg(total_score) >= 45"))
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.segments(spark, sf_dir).groupBy("chain").agg(exact_mean("total_score", 1).alias("mean_score"), F.count("*").alias("n"))
    return s.where("mean_score >= 45").withColumn("mean_score", F.round("mean_score", 4).cast("double"))


@query(with_views("seg", " SELECT segment_id, CASE WHEN total_score >= 80 THEN '#14b8a6' WHEN total_score >= 60 THEN '#fb923c' WHEN total_score >= 40 THEN '#eab308' WHEN total_score >= 20 THEN '#64748b' ELSE '#475569' END AS colour, CASE WHEN total_score >= 70 THEN '#14b8a6' WHEN total_score >= 60 THEN '#2dd4bf' WHEN total_score >= 50 THEN '#fb923c' ELSE '#64748b' END AS section_colour, CAST(floor(total_score / 100 * 100 + 0.5) AS BIGINT) AS bar, CASE segment_id % 4 WHEN 3 THEN 'Satellite verified' WHEN 2 THEN 'Partial data' ELSE 'Geometry only' END AS badge FROM seg"))
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("total_score")
    return adapters.segments(spark, sf_dir).select("segment_id", labels.steps(score, labels.SEGMENT_COLOURS).alias("colour"), labels.steps(score, labels.SECTION_COLOURS).alias("section_colour"), labels.percent(score, 100.0).alias("bar"), labels.confidence_badge(F.col("segment_id") % 4).alias("badge"))


@query(with_views("det scene", SCENE_SQL + ", p AS (SELECT s_suppkey % 20 AS spot_id, min(s_name) AS name FROM supplier GROUP BY 1) SELECT name, count(scene_date) AS n_scenes, count(*) FILTER (swell_height_m >= 2) AS n_big, round(max(median_foam), 4) AS best FROM p LEFT JOIN sf USING (spot_id) GROUP BY name"))
def gallery_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots with what their scenes hold; spots without scenes stay."""
    spots = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 20).alias("spot_id")).agg(F.min("s_name").alias("name"))
    sc = _scenes(spark, sf_dir).groupBy("spot_id").agg(F.count("*").alias("n_scenes"), F.count(F.when(F.col("swell_height_m") >= 2, 1)).alias("n_big"), F.round(F.max("median_foam"), 4).alias("best"))
    return spots.join(sc, "spot_id", "left").select("name", F.coalesce("n_scenes", F.lit(0)).alias("n_scenes"), F.coalesce("n_big", F.lit(0)).alias("n_big"), "best")


@query(with_views("seg", " SELECT segment_id, 'ns-seg-' || lpad(CAST(row_number() OVER (ORDER BY chain, segment_id) AS VARCHAR), 5, '0') AS code FROM seg WHERE exposure_arc_deg >= 30"))
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import atlas

    kept = adapters.segments(spark, sf_dir).where("exposure_arc_deg >= 30")
    return atlas.numbered(kept, ["chain", "segment_id"], "code", "ns-seg-%05d").select("segment_id", "code")


@query(with_views("det", ", p AS (" + PROFILE_SQL + ") SELECT d.segment_id, d.spot_id, d.scene_date, d.pos, p.turn_on_threshold_m, d.swell_height_m >= p.turn_on_threshold_m AS above FROM det d JOIN p USING (segment_id) WHERE d.foam_fraction > 0.8"))
def detections_with_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = adapters.detections(spark, sf_dir)
    p = profiles.response(det, ["segment_id"]).select("segment_id", "turn_on_threshold_m")
    rows = det.where("foam_fraction > 0.8").join(p, "segment_id")
    return rows.select("segment_id", "spot_id", "scene_date", "pos", "turn_on_threshold_m", (F.col("swell_height_m") >= F.col("turn_on_threshold_m")).alias("above"))


@query(with_views("det", " SELECT segment_id, scene_date, swell_height_m, round(avg(foam_fraction) OVER (PARTITION BY segment_id ORDER BY scene_date, pos, supplier_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) + 1e-9, 4) AS recent_foam FROM det"))
def recent_foam(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("segment_id").orderBy("scene_date", "pos", "supplier_id").rowsBetween(-2, 0)
    return adapters.detections(spark, sf_dir).select("segment_id", "scene_date", "swell_height_m", rounded(F.avg("foam_fraction").over(w), 4).alias("recent_foam"))


@query(
    with_views(
        "det daily",
        """, d AS (SELECT spot_id, scene_date, dayofyear(scene_date) AS doy, count(*) AS n, round(avg(foam_fraction) + 1e-9, 4) AS mean_foam FROM det GROUP BY ALL)
        SELECT spot_id, scene_date, n, mean_foam, m.value AS marine, w.value AS weather FROM d LEFT JOIN (SELECT * FROM daily WHERE kind = 'click') m USING (doy) LEFT JOIN (SELECT * FROM daily WHERE kind = 'view') w USING (doy)""",
    )
)
def conditions_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with the marine and the weather reading of their day of the year; days without one are null.
    A dimension has one row a day of the year, so Spark broadcasts it."""
    scenes = adapters.detections(spark, sf_dir).groupBy("spot_id", "scene_date").agg(F.count("*").alias("n"), rounded(F.avg("foam_fraction"), 4).alias("mean_foam"))
    keyed = scenes.withColumn("doy", F.dayofyear("scene_date"))
    for name, kind in (("marine", "click"), ("weather", "view")):
        keyed = keyed.join(adapters.daily(spark, sf_dir, kind).withColumnRenamed("value", name), "doy", "left")
    return keyed.select("spot_id", "scene_date", "n", "mean_foam", "marine", "weather")


@query("""WITH d AS (SELECT user_id AS station, CAST(ts AS DATE) AS day FROM events), s AS (SELECT *, CASE WHEN day < DATE '2024-01-25' - INTERVAL 5 DAY THEN 'archive' ELSE 'forecast' END AS source FROM d)
    SELECT station, source, strftime(day, '%Y-%m') AS month, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS n_days FROM s GROUP BY ALL""")
def weather_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a station, source and month: days older than five days come from the archive."""
    days = table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), F.to_date("ts").alias("day"))
    return series.request_batches(days, "station", "day", F.to_date(F.lit("2024-01-25")))


@query(
    with_views(
        "seg",
        """, t AS (SELECT chain, list(segment_id ORDER BY segment_id) AS ids FROM seg GROUP BY chain), s AS (SELECT *, len(ids) AS n FROM t)
        SELECT chain, n, array_to_string(ids[:3], ', ') || CASE WHEN n > 3 THEN ' +' || (n - 3) || ' more' ELSE '' END AS head FROM s""",
    )
)
def section_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three segments of each chain and how many more it has; only those are kept, whatever its size."""
    seg = adapters.segments(spark, sf_dir).select("chain", "segment_id")
    sizes = seg.groupBy("chain").agg(F.count("*").alias("n"))
    first = top_in_group(seg, ["chain"], [F.col("segment_id")], 3).groupBy("chain").agg(F.sort_array(F.collect_list("segment_id")).alias("ids"))
    return first.join(sizes, "chain").select("chain", "n", labels.head_of(F.col("ids").cast("array<string>"), 3, F.col("n")).alias("head"))


@query(
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'undated' WHEN o_orderkey % 11 = 0 THEN '2024-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderdate, o_orderkey % 83 AS h, o_orderkey % 4 AS state FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN day ELSE strftime(o_orderdate, '%B %-d, %Y') END AS long_date, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS is_date,
    'spot-' || (o_orderkey % 20) || '_' || strftime(o_orderdate, '%Y-%m-%d') || '_' || printf('%.1f', h / 10) || 'm_rgb_annotated.png' AS file, CASE state WHEN 1 THEN '▲' WHEN 2 THEN '▼' WHEN 3 THEN '◆' ELSE '' END AS tide,
    'spot-' || (o_orderkey % 20) AS slug FROM o"""
)
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, file names, slugs and tide signs as they are shown."""
    key = F.col("o_orderkey")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    day = F.when(key % 7 == 0, "undated").when(key % 11 == 0, "2024-13-45").otherwise(iso)
    slug = F.concat(F.lit("spot-"), (key % 20).cast("string"))
    state = F.get(F.array(*map(F.lit, ("unknown", "high", "low", "mid"))), (key % 4).cast("int"))
    path = F.concat(F.lit("out/"), slug, F.lit("_foam_detections.json"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        labels.long_date(day).alias("long_date"),
        views.is_date(day).alias("is_date"),
        labels.scene_name(slug, F.col("o_orderdate"), (key % 83) / 10, "rgb", "_annotated").alias("file"),
        labels.tide_glyph(state).alias("tide"),
        documents.slug_of(path, "_foam_detections").alias("slug"),
    )


@query(
    with_views(
        "det",
        """, seg_of AS (SELECT DISTINCT spot_id, segment_id FROM det), scene_of AS (SELECT DISTINCT spot_id, scene_date FROM det),
        pair AS (SELECT s.spot_id, s.scene_date, g.segment_id FROM scene_of s JOIN seg_of g USING (spot_id)),
        met AS (SELECT spot_id, scene_date, segment_id, max(foam_fraction) AS foam FROM det GROUP BY ALL)
        SELECT spot_id, scene_date, count(*) AS n_pairs, count(met.segment_id) AS n_seen, count(*) FILTER (foam > 0.05) AS n_foam FROM pair LEFT JOIN met USING (spot_id, scene_date, segment_id) GROUP BY ALL""",
    )
)
def scene_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the pairs of a scene and a segment of its place were seen, and seen with foam.

    A scene has as many pairs as its place has segments: no pair has to be formed to be counted."""
    det = adapters.detections(spark, sf_dir)
    seen = det.groupBy("spot_id", "scene_date", "segment_id").agg(F.max("foam_fraction").alias("foam"))
    scenes = seen.groupBy("spot_id", "scene_date").agg(F.count("*").alias("n_seen"), F.count(F.when(F.col("foam") > 0.05, 1)).alias("n_foam"))
    places = det.groupBy("spot_id").agg(F.countDistinct("segment_id").alias("n_pairs"))
    return scenes.join(places, "spot_id").select("spot_id", "scene_date", "n_pairs", "n_seen", "n_foam")
