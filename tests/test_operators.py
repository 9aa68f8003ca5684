"""Boundary rows, sources, sinks and streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry, labels, rounding, scores
from tidemark.operators import atlas, graph, profiles, ranking, scenes, series, spatial, views
from tidemark.sources import documents, scratch, sinks
from tidemark.streaming import flags


def values(spark, expr, rows, schema="v double"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(expr).collect()]


def test_bins_are_half_open(spark):
    got = values(spark, labels.swell_bin(F.col("v")), [0.0, 0.5, 1.0, 8.0, 9.0, None])
    assert got == ["0.0-0.5m", "0.5-1.0m", "1.0-1.5m", ">8.0m", ">8.0m", None]
    assert values(spark, labels.gallery_bin(F.col("v")), [20.0, 19.9]) == ["xxl", "xxl"]


def test_sectors_and_compass(spark):
    assert values(spark, labels.sector(F.col("v")), [0.0, 45.0, 359.9, 360.0, -10.0, None]) == ["N", "NE", "NW", "N", "NW", None]
    assert values(spark, labels.compass(F.col("v")), [350.0, 11.25, 11.24, None]) == ["N", "NNE", "N", None]


def test_exposure_jump(spark):
    got = values(spark, geometry.swell_exposure(F.col("v") + 170, F.lit(240.0)), [0.0, 30.0, 60.0, 60.0001, 90.0, 91.0])
    assert got == pytest.approx([40, 40, 0, 20, 0, 0], abs=1e-3)


def test_road_access_ends(spark):
    assert values(spark, geometry.road_access(F.col("v")), [0.0, 200.0, 2600.0, 5000.0, 9000.0, None]) == pytest.approx([15, 15, 7.5, 0, 0, 0])


def test_utm_known_point(spark):
    e, n = geometry.utm(F.lit(-63.0), F.col("v"))
    assert values(spark, e, [45.0]) == pytest.approx([500000.0])
    assert values(spark, n, [45.0]) == pytest.approx([4982950.4], abs=0.1)


def test_wave_power_default_period(spark):
    df = spark.createDataFrame([(2.0, 0.0), (2.0, None), (2.0, 8.0)], "h double, t double")
    assert len({round(r[0], 6) for r in df.select(scores.wave_power(F.col("h"), F.col("t"))).collect()}) == 1


def test_composite_weights_over_available_parts(spark):
    row = spark.createDataFrame([(50.0, None, None, 0.0), (50.0, 40.0, 25.0, 0.0), (2.0, None, None, 5.0)], "g double, f double, p double, x double")
    got = [r[0] for r in row.select(scores.composite(F.col("g"), F.col("f"), F.col("p"), penalty=F.col("x"))).collect()]
    assert got == pytest.approx([50.0, 100 * (0.35 * 17.5 + 16 + 6.25) / 34.5, 0.0])
    with pytest.raises(ValueError):
        scores.composite(F.col("g"), F.col("f"), F.col("p"), (0.5, 0.5, 0.5))


def test_best_bin_ties_and_zeros(spark):
    rows = [("a", 0.2, 0.5), ("a", 0.3, 0.5), ("a", 0.6, 0.5), ("a", 0.7, 0.5), ("z", 0.2, 0.0), ("z", 0.3, 0.0), ("n", None, 0.4)]
    df = spark.createDataFrame(rows, "segment_id string, swell_height_m double, foam_fraction double")
    got = {r[0]: r[1] for r in profiles.best_bin(profiles.swell_bins(df, ["segment_id"]), ["segment_id"]).collect()}
    assert got == {"a": "0.0-0.5m", "z": None}


def test_thresholds_are_strict(spark):
    rows = [("a", 1.0, 0.05), ("a", 2.0, 0.0501), ("a", 3.0, 0.80), ("a", 4.0, 0.81), ("b", 1.0, 0.9), ("b", 1.0, None)]
    df = spark.createDataFrame(rows, "segment_id string, swell_height_m double, foam_fraction double")
    got = {r["segment_id"]: r for r in profiles.response(df, ["segment_id"]).collect()}
    assert (got["a"]["turn_on_threshold_m"], got["a"]["blow_out_point_m"], got["a"]["status"]) == (2.0, 4.0, "complete")
    assert got["b"]["status"] == "insufficient_data"


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 11, 12, 23])
def test_tiling_equals_loop(spark, n):
    df = spark.createDataFrame([("c", i) for i in range(n)], "chain string, segment_id int")
    got = {}
    for r in atlas.tiled(df, "chain", ["segment_id"]).collect():
        got.setdefault(r["g"], []).append(r["segment_id"])
    want = {s // 5: list(range(s, min(s + 6, n))) for s in range(0, n, 5) if n - s >= 2}
    assert {g: sorted(v) for g, v in got.items()} == want


def test_ranks_across_cells(spark):
    df = spark.createDataFrame([(i, float(i % 7) * 15) for i in range(50)] + [(99, 120.0)], "id int, s double")
    got = {r["id"]: r for r in ranking.ranked(df, "s", ["id"], n=5).collect()}
    rows = sorted(got, key=lambda i: (-got[i]["s"], i))
    assert [got[i]["rank"] for i in rows] == list(range(1, 52))
    assert all(got[i]["competition_rank"] == 1 + sum(got[j]["s"] > got[i]["s"] for j in rows) for i in rows)


def test_chains_of_degree_two(spark):
    edges = [(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "x", "y"), (5, "m", "n"), (6, "n", "o"), (7, "n", "p"), (8, "q", "r"), (9, "r", "q")]
    got = {r["edge"]: r["chain"] for r in atlas.chains(spark.createDataFrame(edges, "edge int, u string, v string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}


def test_pieces_drop_partial(spark):
    line = spark.createDataFrame([("l", 0, 0.0, 0.0), ("l", 1, 600.0, 0.0), ("l", 2, 600.0, 400.0), ("s", 0, 0.0, 0.0), ("s", 1, 499.0, 0.0)], "line string, i int, x double, y double")
    got = sorted((r["k"], r["ax"], r["ay"], r["bx"], r["by"]) for r in spatial.pieces(spatial.edges(line, "line", "i"), "line", 500.0, 250.0).collect())
    assert got == [(0, 0, 0, 500, 0), (1, 250, 0, 600, 150), (2, 500, 0, 600, 400)]


def test_tide_states(spark):
    rows = [("a", "2024-01-01 14:30:00", 1.0), ("a", "2024-01-01 15:30:00", 2.0), ("b", "2024-01-01 15:00:00", 2.0), ("c", "2024-01-01 13:59:59", 2.0)]
    df = spark.createDataFrame(rows, "station string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    near = series.nearest_in_day(df, ["station"], "ts", "value")
    got = {r[0]: (r[1], r[2]) for r in near.select("station", "value", series.tide_state(F.col("value"), F.col("low"), F.col("high"), F.col("n"))).collect()}
    assert got == {"a": (1.0, "low"), "b": (2.0, "unknown")}


def test_scene_fields_come_from_the_first_row(spark):
    rows = [("d", 1, 0, 9.9, 1.0, 5.0, 90.0, 80.0), ("d", 2, 100, 0.1, 2.0, 6.0, 91.0, 81.0), ("d", 3, 100, 0.3, 3.0, 7.0, 92.0, 82.0), ("e", 1, 10, 0.3, 3.0, 7.0, 92.0, 82.0)]
    df = spark.createDataFrame(rows, "day string, pos int, water_pixel_count int, foam_fraction double, swell_height_m double, swell_period_s double, swell_direction_deg double, quality_score double")
    got = scenes.scene_foam(df, ["day"], "pos").collect()
    assert len(got) == 1 and (got[0]["swell_height_m"], got[0]["median_foam"], got[0]["segment_count"], got[0]["valid_segments"]) == (1.0, 0.3, 3, 2)


def test_upsert_and_slugs(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "slug string, v int")
    assert sorted(map(tuple, views.upsert(old, new, "slug").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    wanted = spark.createDataFrame([("cow",), ("cow-bay",), ("zzz",)], "slug string")
    have = spark.createDataFrame([("cow-bay",), ("cow-hill",)], "slug string")
    assert {tuple(r) for r in views.preferred_slugs(have, wanted).collect()} == {("cow", "cow-bay"), ("cow-bay", "cow-bay"), ("zzz", None)}


def test_json_sources(spark, tmp_path):
    (tmp_path / "spots").mkdir()
    (tmp_path / "spots/x.json").write_text(json.dumps({"name": "X", "slug": "x", "bbox": [0, 1, 2, 3], "point": {"lat": 1, "lon": 2}}))
    row = documents.configs(spark, f"{tmp_path}/spots/*.json").first()
    assert row["slug"] == "x" and row["breaks"] is None and row["_config_path"].endswith("x.json")
    breaks = views.breaks_or_point(documents.configs(spark, f"{tmp_path}/spots/*.json")).collect()
    assert [(b["name"], b["lat"], b["lon"]) for b in breaks] == [("X", 1.0, 2.0)]
    shape = {"type": "FeatureCollection", "features": [{"properties": {"segment_id": "s"}, "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}}, {"properties": {"segment_id": "m"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 1]], [[4, 5], [6, 7]]]}}]}
    (tmp_path / "f.geojson").write_text(json.dumps(shape))
    found = documents.lines(documents.features(spark, f"{tmp_path}/f.geojson")).collect()
    assert sorted((r["segment_id"], r["line"]) for r in found) == [("m", [[4.0, 5.0], [6.0, 7.0]]), ("s", [[0.0, 1.0], [2.0, 3.0]])]


def test_manifests(spark, tmp_path):
    (tmp_path / "a_foam.json").write_text(json.dumps({"spot": "a", "detections": [{"segment_id": "s", "foam_fraction": 0.1}, {"segment_id": ""}, {}]}))
    (tmp_path / "b_foam.json").write_text("{ broken")
    assert [r["segment_id"] for r in documents.foam_detections(spark, f"{tmp_path}/*_foam.json").collect()] == ["s"]
    for name, n in (("1", 5), ("2", 9), ("3", 9)):
        (tmp_path / f"{name}_prof.json").write_text(json.dumps({"profiles": {"s": {"status": "complete", "observation_count": n, "primary_direction": name}, "t": {"status": "insufficient_data"}}}))
    got = documents.swell_profiles(spark, f"{tmp_path}/*_prof.json").collect()
    assert [(r["segment_id"], r["primary_direction"]) for r in got] == [("s", "2")]
    assert documents.optional(spark, f"{tmp_path}/none.json", "a int").count() == 0


def test_hourly_and_stations(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"latitude": 1.0, "longitude": 2.0, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "wave_height": [1.5]}}))
    got = documents.hourly(spark, f"{tmp_path}/h.json").orderBy("ts").collect()
    assert [r["wave_height"] for r in got] == [1.5, None] and got[0]["swell_wave_height"] is None
    (tmp_path / "t.json").write_text(json.dumps({"x": {"station_id": "7", "station_name": "S", "distance_km": 3.5}}))
    assert documents.tide_stations(spark, f"{tmp_path}/t.json").first()["station_id"] == "7"
    (tmp_path / "d.txt").write_text("on 2024-01-02 and 2024-01-01\n2024-01-02 again")
    assert {r["date"] for r in documents.dates_in_text(spark, f"{tmp_path}/d.txt").collect()} == {"2024-01-01", "2024-01-02"}
    arr = spark.createDataFrame([([1.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in arr.select(series.at_hour(F.col("v"), 15)).collect()] == [2.0, None]


def test_flag_rows(spark):
    body = json.dumps([{"id": "1", "section_id": "s", "lat": 1, "lon": 2, "break_type": "reef", "confidence": "maybe"}, {"id": "2"}])
    df = spark.createDataFrame([(body,), ("nonsense",), (None,)], "body string")
    assert [r["id"] for r in documents.flags(df, "body").collect()] == ["1"]


def test_ways_last_tile_wins(spark):
    df = spark.createDataFrame([(1, 0, [1, 2], "a"), (1, 3, [1, 2], "b"), (2, 0, [1], "c")], "osm_id int, tile int, coords array<int>, v string")
    assert [(r["osm_id"], r["v"]) for r in documents.latest_ways(df).collect()] == [(1, "b")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.0, 2.0), ("b", 3, 4.0, 5.0)], "slug string, n int, lon double, lat double")
    sinks.write_documents(df, f"{tmp_path}/docs")
    assert '"n":null' in "".join(r[0] for r in spark.read.text(f"{tmp_path}/docs").collect())
    sinks.write_features(df, f"{tmp_path}/features", ["slug"], "lon", "lat")
    assert {json.loads(r[0])["geometry"]["coordinates"][0] for r in spark.read.text(f"{tmp_path}/features").collect()} == {1.0, 4.0}
    sinks.write_by_key(df, f"{tmp_path}/keyed", "slug")
    assert (tmp_path / "keyed/slug=a").is_dir()
    sinks.write_review(df, f"{tmp_path}/review")
    assert spark.read.option("header", True).csv(f"{tmp_path}/review").columns == list(sinks.REVIEW)
    assert sinks.run_row(spark, "r", "s", {"a": "1"}, {}).first()["parameters"] == {"a": "1"}


def test_empty_results_keep_their_shape(spark):
    none = sinks.empty_view(spark, documents.DETECTION).withColumnRenamed("date", "scene_date")
    got = sinks.empty_summary(none).first()
    assert got["total_detections"] == 0 and got["mean_quality"] == 0.0


def test_galleries(spark):
    schema = "slug string, scenes array<struct<rgb_path:string,annotated_rgb_path:string>>"
    df = spark.createDataFrame([("a", [("data/x.png", "y"), (None, None)]), ("gone", [])], schema)
    shown = sinks.publishable(df, ("gone",)).collect()
    assert [[s["rgb_path"] for s in r["scenes"]] for r in shown] == [["/x.png", None]]
    assert [r["annotated_count"] for r in sinks.with_annotation_counts(df).orderBy("slug").collect()] == [1, 0]


def test_section_config(spark):
    df = spark.createDataFrame([("atlas-0001", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 2, "a,b")], "section_id string, west double, south double, east double, north double, centroid_lat double, centroid_lon double, mean_score double, max_score double, segment_count int, segment_ids string")
    r = views.section_config(df).first()
    assert r["bbox"] == [1.0, 2.0, 3.0, 4.0] and r["atlas_metadata"]["segment_ids"] == ["a", "b"]


def test_flag_stream(spark, tmp_path):
    rows = [("1", "add", 1), ("2", "add", 2), ("1", "delete", 3), ("3", "add", 4), ("3", "add", 5)]
    spark.createDataFrame(rows, "id string, action string, at long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, action string, at long").parquet(f"{tmp_path}/in")
    flags.upsert_flags(stream, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination(120)
    state = flags.current_flags(spark.read.parquet(f"{tmp_path}/log"))
    assert sorted((r["id"], r["at"]) for r in state.collect()) == [("2", 2), ("3", 5)]


def test_chains_of_repeated_and_missing_edges(spark):
    """A long path, numbered at random, is one chain; a repeated id is one edge, edges without ids are ignored."""
    ids = list(range(2000))
    random.Random(1).shuffle(ids)
    rows = [(ids[k], k, k + 1) for k in range(2000)] + [(ids[5], 90_000, 90_001), (None, 7, 8), (5000, 50_000, 50_001), (5001, 60_000, None)]
    got = {r["edge"]: r["chain"] for r in atlas.chains(spark.createDataFrame(rows, "edge long, u long, v long")).collect()}
    assert got == {i: 0 for i in ids} | {5000: 5000, 5001: 5001}
    none = spark.createDataFrame([], "edge long, u long, v long")
    assert atlas.chains(none).count() == 0


def test_chain_lengths_and_places(spark):
    rows = [(1, 1, 2, 2.0), (2, 2, 3, 3.0), (3, 10, 11, 5.0), (4, 20, 21, 1.0), (3, 10, 11, 5.0)]
    got = atlas.measured(spark.createDataFrame(rows, "edge long, u long, v long, length double"), 1.0).orderBy("place").collect()
    assert [(r["chain"], r["n_edges"], r["length"], r["place"]) for r in got] == [(1, 2, 5.0, 1), (3, 1, 5.0, 2)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(7, 7), (None, 3), (1000, 1001), (1001, 1000)] + [(500, 500 + k) for k in range(1, 60)] + [(900, 900)]
    group = {}
    for a, b in edges:
        if a is not None:
            group.setdefault(a, {a}), group.setdefault(b, {b})
            if group[a] is not group[b]:
                group[a] |= group[b]
                for k in group[b]:
                    group[k] = group[a]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: min(v) for k, v in group.items()}


def test_nearest_in_growing_rings(spark):
    rng = random.Random(3)
    targets = [(k, rng.random(), rng.random()) for k in range(80)] + [(200, 50.0, 50.0), (201, 50.0, 50.0)]
    points = [(k, rng.random() * 3, rng.random() * 3) for k in range(60)] + [(100, 49.0, 50.0), (101, None, 0.0), (102, 0.5, 0.5), (102, 0.5, 0.5)]
    t, p = spark.createDataFrame(targets, "t long, x double, y double"), spark.createDataFrame(points, "p long, x double, y double")
    want = {k: min((math.hypot(a - x, b - y), i) for i, a, b in targets) for k, x, y in points if x is not None}
    got = {r["p"]: (r["distance"], r["t"]) for r in spatial.nearest(p, t, "p", "t").collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    near = {r["p"] for r in spatial.nearest(p, t, "p", "t", cap=0.4).collect()}
    assert near == {k for k, (d, _) in want.items() if d <= 0.4}
    assert spatial.nearest(p, t.limit(0), "p", "t").count() == 0 == spatial.nearest(p.limit(0), t, "p", "t").count()


def test_nearest_line_and_fraction(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 10.0), (2, 0, 0.0, 30.0), (2, 1, 20.0, 30.0)], "line long, i int, x double, y double")
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, 12.0, 5.0), (3, 5.0, 28.0), (4, 500.0, 0.0), (5, -3.0, 0.0)], "p long, x double, y double")
    got = {r["p"]: (r["line"], round(r["distance"], 6), round(r["fraction"], 6)) for r in spatial.nearest_line(points, spatial.edges(lines, "line", "i"), "p", "line", 40.0, 1.0).collect()}
    assert got == {1: (1, 2.0, 0.25), 2: (1, 2.0, 0.75), 3: (2, 2.0, 0.25), 5: (1, 3.0, 0.0)}


def test_seaward_side(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1000.0, 0.0)], "line long, i int, x double, y double")
    faced = spatial.edges(lines, "line", "i").withColumn("facing", F.lit(0.0))
    points = spark.createDataFrame([(1, 500.0, 50.0), (2, 500.0, -50.0), (3, 500.0, -150.0), (4, 500.0, 210.0), (5, 500.0, -95.0)], "p long, x double, y double")
    assert {r["p"] for r in spatial.seaward_side(points, faced, "p", "line", "facing", 200.0).collect()} == {1, 2, 5}


def test_depth_profile_at_the_edge(spark):
    raster = spark.createDataFrame([(y, 0, -10.0 * y) for y in range(4)], "iy int, ix int, elevation double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.3), (3, 0.0, -5.0), (4, None, None)], "p long, lon double, lat double")
    got = {r["p"]: (r["n_wet"], r["slope"]) for r in spatial.depth_profile(points, raster, "p", (0.0, 0.0), (1.0, 0.1), (1, 4)).collect()}
    assert got[1] == (4, pytest.approx(20.0 / 2000)) and got[2] == (5, 0.0) and got[3] == got[1]


def test_binary_rounding_prints_as_python(spark):
    rows = [k / 2000 for k in range(-200, 200)] + [0.0125, 2.675, 1e9 + 0.0005, 0.1 + 0.2]
    got = values(spark, F.format_string("%.3f", rounding.binary_rounded(F.col("v"), 3)), rows)
    assert got == [f"{x:.3f}" for x in rows]


def test_display_texts(spark):
    text = ["2024-03-05", "2024-02-30", "n/a", None]
    assert values(spark, labels.long_date(F.col("v")), text, "v string") == ["March 5, 2024", "2024-02-30", "n/a", None]
    assert values(spark, views.is_date(F.col("v")), text, "v string") == [True, False, False, False]
    assert values(spark, labels.head_of(F.col("v")), [["a"], ["a", "b", "c"], ["a", "b", "c", "d", "e"]], "v array<string>") == ["a", "a, b, c", "a, b, c +2 more"]
    assert values(spark, documents.slug_of(F.col("v"), "_scene_inventory"), ["x/y/hell-point_scene_inventory.json", "other.json"], "v string") == ["hell-point", ""]
    assert values(spark, labels.road_text(F.col("v")), [None, 120.5, 4321.0]) == ["No road within 5km", "Road access within 120m", "Road 4321m away"]
    assert values(spark, labels.slope_text(F.col("v"), F.lit(0.0125)), [None, 1, 3], "v int")[1:] == ["Shallow nearshore area", "Nearshore gradient: 0.013 m/m"]


def test_scratch_is_cleared(spark):
    since = scratch.made(spark)
    path = scratch.written(spark.range(3), "x").inputFiles()[0]
    scratch.clear(spark, since)
    assert scratch.made(spark) == since
    with pytest.raises(Exception, match="."):
        spark.read.parquet(path).count()


def test_distribution_interpolates(spark):
    rng = random.Random(4)
    for scores_ in ([3.0], [1.0, 2.0], [rng.choice([rng.uniform(-5, 120), 7.0]) for _ in range(333)]):
        r = ranking.distribution(spark.createDataFrame([(v,) for v in [*scores_, None]], "v double"), "v").first()
        srt = sorted(scores_)
        for p in (50, 75, 90, 95, 99):
            at = p / 100 * (len(srt) - 1)
            low, high = srt[math.floor(at)], srt[math.ceil(at)]
            assert r[f"p{p}"] == pytest.approx(low + (high - low) * (at % 1), abs=1e-4)
        assert (r["n"], r["min_score"], r["max_score"]) == (len(srt), pytest.approx(srt[0], abs=1e-4), pytest.approx(srt[-1], abs=1e-4))
    none = ranking.distribution(spark.createDataFrame([], "v double"), "v").collect()
    assert len(none) == 1 and none[0]["n"] == 0 and none[0]["p50"] is None


def _ring(points):
    return [(*p, *q) for p, q in zip(points, points[1:] + points[:1], strict=True)]


def _inside(x, y, edges):
    return sum((ay <= y < by or by <= y < ay) and x < ax + (y - ay) / (by - ay) * (bx - ax) for ax, ay, bx, by in edges) % 2 == 1


def test_polygon_runs_are_the_pixels_inside(spark):
    from tidemark.operators import raster

    shapes = {
        1: _ring([(1.2, 1.1), (18.7, 2.3), (17.1, 14.9), (9.0, 6.2), (2.2, 17.3)]),
        2: _ring([(0.0, 0.0), (12.0, 0.0), (12.0, 12.0), (0.0, 12.0)]) + _ring([(4.0, 4.0), (8.0, 4.0), (8.0, 8.0), (4.0, 8.0)]),  # a hole
        3: _ring([(-5.5, -5.5), (-5.4, -5.5), (-5.4, -5.4)]),  # between the centres
    }
    edges = spark.createDataFrame([(k, *e) for k, es in shapes.items() for e in es], "zone int, ax double, ay double, bx double, by double")
    runs = raster.polygon_runs(edges, "zone", 1.0)
    found = {(r["zone"], r["row"], c) for r in runs.collect() for c in range(r["low"], r["high"] + 1)}
    assert found == {(k, r, c) for k, es in shapes.items() for r in range(-8, 25) for c in range(-8, 25) if _inside(c + 0.5, r + 0.5, es)}


def test_buffer_runs_are_the_pixels_by_distance(spark):
    from math import cos, hypot, radians, sin

    from tidemark.operators import raster

    lines = {1: (0.0, [(0, 0), (100, 30), (150, 200), (150, 200), (90, 260)]), 2: (137.0, [(-300, 10), (-300, 10)]), 3: (250.0, [(400, 0), (430, 0)])}
    rows = [(k, facing, float(ax), float(ay), float(bx), float(by)) for k, (facing, ps) in lines.items() for (ax, ay), (bx, by) in zip(ps, ps[1:], strict=False)]
    runs = raster.buffer_runs(spark.createDataFrame(rows, "zone int, facing double, ax double, ay double, bx double, by double"), "zone", "facing", 60.0, 10.0).collect()

    def off(x, y, ax, ay, bx, by):
        square = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / square)) if square else 0
        return hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    want = set()
    for k, (facing, ps) in lines.items():
        dx, dy = sin(radians(facing + 180)) * 60, cos(radians(facing + 180)) * 60
        for r in range(-20, 50):
            for c in range(-60, 70):
                x, y = (c + 0.5) * 10, (r + 0.5) * 10
                pairs = list(zip(ps, ps[1:], strict=False))
                if min(off(x, y, *a, *b) for a, b in pairs) <= 60 and min(off(x, y, a[0] + dx, a[1] + dy, b[0] + dx, b[1] + dy) for a, b in pairs) > 30:
                    want.add((k, r, c))
    found = [(r["zone"], r["row"], c) for r in runs for c in range(r["low"], r["high"] + 1)]
    assert len(found) == len(set(found)) and set(found) == want


def test_zonal_join_meets_runs_over_strips_and_leaves_out_dry_pairs(spark):
    from tidemark.operators import raster

    runs = spark.createDataFrame([(1, 0, 3, 130), (2, 0, 100, 101), (3, 5, 0, 0)], "zone int, row int, low long, high long")
    pixels = spark.createDataFrame([(s, 0, c, 700 + 3 * c, 6 if (c + s) % 2 else 8) for s in (0, 1) for c in range(140)], "scene int, row int, col int, b8 int, scl int")
    got = {(r["scene"], r["zone"]): r for r in raster.zonal_join(pixels, runs, "scene", "zone").collect()}
    assert got.keys() == {(0, 1), (1, 1), (0, 2), (1, 2)}
    cols = [c for c in range(3, 131) if c % 2]
    assert (got[0, 1]["water_pixel_count"], got[0, 1]["max_nir"], got[0, 1]["mean_nir"]) == (len(cols), 700 + 3 * cols[-1], sum(700 + 3 * c for c in cols) / len(cols))
    assert got[0, 1]["foam_pixel_count"] == sum(3 * c > 100 for c in cols)


def _crowd():
    import random

    rng = random.Random(7)
    crowd = [(5.0 + rng.random() / 50, 5.0 + rng.random() / 50) for _ in range(1500)]
    same = [(-3.0, 2.0)] * 120  # cannot be told apart
    return [(i, x, y) for i, (x, y) in enumerate(crowd + same + [(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(300)])]


def test_quadtree_splits_crowds_and_leaves_the_rest(spark):
    from tidemark.operators import quadtree

    rows = _crowd()
    points = spark.createDataFrame([*rows, (9999, None, 1.0)], "p int, x double, y double")
    tree = quadtree.build(points, 4.0, 100)
    assert len(tree.split) == quadtree.DEPTH  # down to the equal points
    leaves = tree.place(points).where("cx is not null").groupBy(*quadtree.CELL).count().collect()
    size = {tuple(r[c] for c in quadtree.CELL): r["count"] for r in leaves}
    assert sum(size.values()) == len(rows)
    assert max(n for (level, _, _), n in size.items() if level < quadtree.DEPTH) <= 100  # of 1,500 in one root cell
    assert sum(level == 0 for level, _, _ in size) > 20  # sparse places stay as they began
    # Every box touches each of its points' leaves once.
    boxes = spark.createDataFrame([(k, x - 0.7, x + 0.7, y - 0.7, y + 0.7) for k, x, y in rows[::37]], "b int, x0 double, x1 double, y0 double, y1 double")
    dealt = tree.deal(boxes, *(boxes[c] for c in ("x0", "x1", "y0", "y1")))
    assert dealt.columns == [*boxes.columns, *quadtree.CELL] and dealt.count() == dealt.distinct().count()
    met = tree.place(points).join(dealt, list(quadtree.CELL)).where("x between x0 and x1 and y between y0 and y1").select("b", "p")
    want = {(k, p) for k, bx, by in rows[::37] for p, x, y in rows if abs(x - bx) <= 0.7 and abs(y - by) <= 0.7}
    found = [(r["b"], r["p"]) for r in met.collect()]
    assert len(found) == len(want) and set(found) == want


def test_quadtree_of_few_points_is_a_plain_grid(spark):
    from tidemark.operators import quadtree

    assert quadtree.build(spark.createDataFrame([(1.0, 2.0)] * 100, "x double, y double"), 1.0, 100).split == []


def test_spatial_joins_on_split_cells_equal_brute_force(spark):
    from math import hypot

    rows = _crowd()
    points = spark.createDataFrame(rows[::9], "p int, x double, y double")
    lines = spark.createDataFrame([(k, i, x + i * dx, y + i * dx / 2) for k, (x, y, dx) in enumerate([(5.0, 5.0, 0.004), (-3.2, 1.9, 0.1), (-20.0, -20.0, 8.0)]) for i in range(6)], "line int, i int, x double, y double")
    edges = spatial.edges(lines, "line", "i")
    plain = {(r["p"], r["line"]): r["distance"] for r in spatial.within(points, edges, "p", "line", 1.5).collect()}
    split = {(r["p"], r["line"]): r["distance"] for r in spatial.within(points, edges, "p", "line", 1.5, capacity=10).collect()}
    assert plain == split and len(plain) > 100
    far = spark.createDataFrame([(-1, 400.0, -300.0), (-2, 5.01, 5.01), (-3, 12.0, 12.0)], "p int, x double, y double")
    targets = spark.createDataFrame(rows, "t int, x double, y double")
    for capacity in (20, 10**6):
        got = {r["p"]: (r["t"], r["distance"]) for r in spatial.nearest(far, targets, "p", "t", capacity=capacity).collect()}
        for p, x, y in ((-1, 400.0, -300.0), (-2, 5.01, 5.01), (-3, 12.0, 12.0)):
            best = min((hypot(tx - x, ty - y), t) for t, tx, ty in rows)
            assert got[p] == (best[1], pytest.approx(best[0]))


def test_exposure_by_arcs_equals_rays(spark):
    from math import cos, hypot, radians, sin

    import random

    rng = random.Random(11)
    origins = [(k, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(-400, 400)) for k in range(40)]
    edges = [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(12)]
    edges += [(x, y, x + 3.3, y + 1.7) for _, x, y, _ in origins[:3]] + [(1.0, 1.0, 1.0, 1.0)]  # from an origin on, and without length

    def hits(x, y, direction, radius, skip, edge):
        ax, ay, bx, by = edge
        rx, ry, sx, sy = radius * sin(radians(direction)), radius * cos(radians(direction)), bx - ax, by - ay
        det = rx * sy - ry * sx
        if abs(det) < 1e-12:
            return False
        t, u = ((ax - x) * sy - (ay - y) * sx) / det, ((ax - x) * ry - (ay - y) * rx) / det
        return t * radius > skip and t <= 1 and 0 <= u <= 1

    table = spark.createDataFrame(edges, "ax double, ay double, bx double, by double")
    for step, radius, skip, capacity in ((5, 4.0, 0.5, 10**6), (1, 4.0, 0.5, 5)):  # 181 rays are several words
        found = spatial.exposure_arc(spark.createDataFrame(origins, "o int, x double, y double, facing double"), table, "o", "facing", radius, step, skip, capacity)
        got = {r["o"]: r["exposure_arc_deg"] for r in found.collect()}
        for k, x, y, facing in origins:
            open_ = sum(not any(hits(x, y, facing + turn, radius, skip, e) for e in edges) for turn in range(-90, 91, step))
            assert got[k] == open_ * step, (k, step)


def test_scratch_folder_where_the_setting_is_unset(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark.sources import scratch

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError("spark.checkpoint.dir cannot be set at run time")

    local = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="local[2]", applicationId="unset-1"))
    path = scratch.shared_dir(local)
    assert path and scratch.shared_dir(local) == path
    cluster = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="unset-2"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(cluster)


def test_medians_by_narrowing_equal_sorted_lists(spark):
    import random

    from tidemark.operators import ranking

    rng = random.Random(2)
    rows = [("wide", rng.uniform(-1e6, 1e6)) for _ in range(1500)] + [("near", 5 + rng.random() * 1e-9) for _ in range(600)] + [("ties", float(v)) for v in [1, 1, 1, 2, 2, 7] * 50]
    rows += [("skewed", 10.0 ** rng.uniform(-9, 9)) for _ in range(800)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    want = {}
    for k, x in rows:
        if x is not None and k is not None:
            want.setdefault(k, []).append(x)
    want = {k: sorted(v)[len(v) // 2] for k, v in want.items()}
    for buckets, most in ((1024, 65_536), (8, 40)):
        got = {r["k"]: r["m"] for r in ranking.upper_median(df.where("k is not null"), ["k"], "x", "m", buckets, most).collect()}
        assert got == want
    assert ranking.upper_median(df.limit(0), ["k"], "x", "m").count() == 0


def test_scene_foam_has_no_sort_aggregate_and_counts_missing_quality_as_zero(spark):
    from tidemark.operators import scenes

    rows = [(1, "a", 0.1, 60, 2.0, 9.0, 10.0, None), (2, "a", 0.3, 60, 1.0, 8.0, 20.0, 95.0), (3, "a", 0.9, 10, 1.0, 8.0, 20.0, 95.0), (4, "b", 0.2, 60, None, 8.0, 20.0, 95.0), (5, "c", 0.2, 10, 1.0, 8.0, 20.0, 95.0), (6, "d", 0.5, 50, 1.5, 0.0, None, 80.0)]
    df = spark.createDataFrame(rows, "pos long, day string, foam_fraction double, water_pixel_count int, swell_height_m double, swell_period_s double, swell_direction_deg double, quality_score double")
    found = scenes.scene_foam(df, ["day"], "pos")
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["day"]: r for r in found.collect()}
    assert got.keys() == {"a", "d"}
    assert (got["a"]["segment_count"], got["a"]["valid_segments"], got["a"]["median_foam"], got["a"]["swell_height_m"], got["a"]["quality_score"]) == (3, 2, 0.3, 2.0, 0.0)
    assert (got["d"]["swell_period_s"], got["d"]["swell_direction_deg"], got["d"]["quality_score"]) == (8.0, None, 80.0)


def test_places_of_one_long_chain_over_many_ranges(spark):
    import random

    from tidemark.operators import ordered

    rng = random.Random(4)
    rows = [("long", rng.random(), k) for k in range(4000)] + [("short", rng.random(), k) for k in range(7)] + [(None, 1.0, 1), (None, 0.5, 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "chain string, at double, k int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = ordered.placed(df, ["chain"], ["at"], "pos", "n")
        got = {(r["chain"], r["k"]): (r["pos"], r["n"]) for r in found.collect()}
        total = [r["k"] for r in ordered.placed(df.where("chain = 'long'"), [], ["at", "k"]).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for chain in ("long", "short", None):
        own = sorted((at, k) for c, at, k in rows if c == chain)
        want |= {(chain, k): (i, len(own)) for i, (_, k) in enumerate(own)}
    assert got == want and found.columns == ["chain", "at", "k", "pos", "n"]
    assert total == [k for _, k in sorted((at, k) for c, at, k in rows if c == "long")]
    assert ordered.placed(df.limit(0), ["chain"], ["at"]).count() == 0


def test_sections_do_not_break_at_the_borders_of_ranges(spark):
    df = spark.createDataFrame([("a", k, 40.0 + k, 1.0 * k, float(k % 50)) for k in range(203)] + [("b", 1, 0.0, 0.0, 1.0)], "chain string, segment_id int, lat double, lon double, total_score double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["g"]: r["segment_ids"] for r in atlas.sections(atlas.tiled(df, "chain", ["segment_id"]), "chain").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {g: ",".join(str(k) for k in range(5 * g, min(203, 5 * g + 6))) for g in range(41) if 203 - 5 * g >= 2}


def test_names_in_reading_order(spark):
    from tidemark.operators import scenes

    df = spark.createDataFrame([(1, n) for n in ["Zed", "élan", "Eland", "apple", "Äpfel", "Banana", "eel"]] + [(2, None), (2, "b"), (2, "A")], "day int, name string")
    got = {r["day"]: r["names"] for r in df.groupBy("day").agg(scenes.in_reading_order("name").alias("names")).collect()}
    assert got[2] == "A, b" and got[1].split(", ") == ["Äpfel", "apple", "Banana", "eel", "élan", "Eland", "Zed"]


def test_bad_rows_are_set_aside_in_one_pass(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.operators import rows

    df = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0), (4, 5.0), (None, 1.0)], "id int, value double")
    rules = {"no id": F.col("id").isNotNull(), "no value": F.col("value").isNotNull(), "below zero": F.col("value") >= 0}
    path = str(tmp_path / "run")
    assert rows.isolate(df, rules, path) == {"rows": 5, "good": 2, "no id": 1, "no value": 1, "below zero": 1}
    assert sorted(r["id"] for r in rows.good(spark, path).collect()) == [1, 4]
    assert sorted((r["id"] or 0, r["error"]) for r in rows.rejected(spark, path).collect()) == [(0, "no id"), (2, "no value"), (3, "below zero")]
    assert rows.isolate(df.limit(0), rules, path)["rows"] == 0


def test_a_run_carries_on_after_a_stop(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.operators import resume

    path, asked = str(tmp_path), []

    def make(todo):
        asked.append(sorted(r["k"] for r in todo.collect()))
        return todo.where("k <> 4").select("k", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("v"))

    def broken(todo):
        # Rows are written, the keys are not: the run stops in between.
        make(todo).withColumn("run", F.lit("broken")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("k").parquet(f"{path}/data")
        raise RuntimeError("stopped")

    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    resume.run_missing(keys(1, 2, 2, None), "k", make, path, "a")
    with pytest.raises(RuntimeError, match="stopped"):
        resume.run_missing(keys(1, 2, 3), "k", broken, path, "b")
    resume.run_missing(keys(1, 2, 3, 4), "k", make, path, "c")
    resume.run_missing(keys(1, 2, 3, 4), "k", make, path, "d")
    assert asked == [[1, 2], [3], [3, 4], []]
    rows = sorted((r["k"], r["v"], r["run"]) for r in resume.made(spark, path, "v int, run string, k int").collect())
    assert rows == [(1, 1, "a"), (2, 1, "a"), (2, 2, "a"), (3, 1, "c"), (3, 2, "c"), (3, 3, "c")]
    assert sorted((r["k"], r["run"]) for r in resume.done(spark, path, "k", "int").collect()) == [(1, "a"), (2, "a"), (3, "c"), (4, "c")]


def test_readings_within_a_second(spark):
    """Readings as many whole seconds away tie, and half a second beyond the hour is out of reach."""
    rows = [("a", "2024-01-01 14:59:59.6", 1.0), ("a", "2024-01-01 15:00:00.2", 2.0), ("a", "2024-01-01 16:00:00.5", 9.0), ("a", "2024-01-01 14:00:00", 4.0)]
    df = spark.createDataFrame(rows, "station string, t string, value double").withColumn("ts", F.to_timestamp("t"))
    got = series.nearest_in_day(df, ["station"], "ts", "value").first()
    assert (got["n"], got["value"], got["low"], got["high"]) == (3, 1.0, 1.0, 4.0)


def test_edges_are_dealt_into_few_cells(spark, monkeypatch):
    """An edge five times as long as the radius goes into a few cells, whatever the bound of the search."""
    edges = [(i, 0, i * 400.0, 0.0, i * 400.0 + 140.0, 140.0) for i in range(50)]
    table = spark.createDataFrame(edges, "line long, i int, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(i, i * 400.0 + 70.0, 75.0 + i) for i in range(50)], "p long, x double, y double")
    counts, deal, cells_of = [], spatial.quadtree.Quadtree.deal, spatial.cells_of

    def counted(*args):
        out = deal(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(spatial.quadtree.Quadtree, "deal", counted)
    near = {(r["p"], r["line"]) for r in spatial.within(points, table, "p", "line", 40.0).collect()}
    gap = lambda i: (5.0 + i) / math.sqrt(2)
    assert {(i, i) for i in range(45)} <= near and all(p == line and gap(p) <= 40 or p != line for p, line in near)
    assert counts[0] <= 4 * len(edges)
    sizes = []
    monkeypatch.setattr(spatial, "cells_of", lambda *args: sizes.append(args[-1]) or cells_of(*args))
    sea = spatial.seaward_side(points, table.withColumn("facing", F.lit(315.0)), "p", "line", "facing", 200.0)
    # The line moved by 200 m to the south-east lies further than 100 m from all of these points.
    assert {(i, i) for i in range(50)} <= {(r["p"], r["line"]) for r in sea.collect()}
    assert sizes == [800.0]
