"""Known values, round trips, invariances and quirks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartoflow.config import Config
from cartoflow.functions import geodesy
from cartoflow.functions import pose as se3
from cartoflow.operators import aggregates, filters, joins, mapping, numeric, odometry, projections, scans, sets, windows
from cartoflow.plugins import Filter, Slot, Strategies
from cartoflow.sources import formats, maps


def cloud(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(-5, 5, (n, 3)).round(3))], "id long, x double, y double, z double")


def test_utm_of_a_known_point(spark):
    df = spark.createDataFrame([(1, 0.0, 3.0), (2, -1.0, 177.0)], "id int, lat double, lon double")
    got = geodesy.apply(df, geodesy.utm(), ["utm_zone", "m_east", "m_north"]).collect()
    assert (got[0].utm_zone, got[0].m_east, got[0].m_north) == (31, 500000.0, 0.0)
    assert got[1].utm_zone == 60 and got[1].m_north > 9.8e6  # the false northing follows the sign of the latitude


def test_utm_zone_wraps_at_the_antimeridian(spark):
    zones = spark.createDataFrame([(180.0,), (-180.0,), (6.0,), (5.999,)], "lon double").selectExpr(f"{geodesy.utm_zone()} z")
    assert [r.z for r in zones.collect()] == [1, 1, 32, 31]


def test_mesh_code_example(spark):
    df = spark.createDataFrame([(1,)], "id int")
    # block N C, subdivision 35, 58
    north = 300000 - (13 * 30000 + 3 * 3000 + 5 * 300 + 150)
    east = -160000 + (2 * 40000 + 5 * 4000 + 8 * 400 + 200)
    got = geodesy.apply(df, geodesy.tile_japan(f"CAST({east} AS DOUBLE)", f"CAST({north} AS DOUBLE)"), ["tile"]).first()
    assert got.tile == "08NC3558"


def test_pose_algebra(spark):
    q = se3.from_rpy(10, 20, 30)
    a, b = se3.literal(1, 2, 3, *q), se3.literal(-1, 0.5, 2, *se3.from_rpy(-40, 5, 60))
    identity = se3.compose(a, se3.inverse(a))
    assoc = [x - y for x, y in zip(se3.transform(se3.compose(a, b), *map(F.lit, (1.0, 2.0, 3.0))), se3.transform(a, *se3.transform(b, *map(F.lit, (1.0, 2.0, 3.0)))), strict=True)]
    row = spark.range(1).select(*[c.alias(f"i{k}") for k, c in enumerate(identity)], *[c.alias(f"d{k}") for k, c in enumerate(assoc)]).first()
    assert np.allclose(row[:7], [0, 0, 0, 0, 0, 0, 1]) and np.allclose(row[7:], 0)
    m = spark.range(1).select(se3.pose_to_matrix(a).alias("m")).select(*[c.alias(n) for n, c in zip(se3.Pose._fields, se3.matrix_to_pose(F.col("m")), strict=True)]).first()
    assert np.allclose(m, [1, 2, 3, *q])


def test_distance_band_is_strict_and_crop_box_inclusive(spark):
    p = spark.createDataFrame([(1.0, 0.0, 0.0), (2.0, 0.0, 0.0), (3.0, 0.0, 0.0), (float("nan"), 0.0, 0.0)], "x double, y double, z double")
    assert [r.x for r in filters.distance_band(p, 1, 3).collect()] == [2.0]
    assert sorted(r.x for r in filters.crop_box(p.where("not isnan(x)"), (2, -1, -1), (3, 1, 1)).collect()) == [1.0]
    with pytest.raises(ValueError):
        filters.crop_box(p, (1, 0, 0), (0, 0, 0))


def test_range_join_equals_brute_force(spark):
    p = cloud(spark)
    rows = p.collect()
    want = {(a.id, b.id) for a in rows for b in rows if (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 4}
    for window in (1, 2):
        assert {(r.id, r.r_id) for r in joins.range_join(p, p, 2.0, window=window).collect()} == want


def test_neighbours_survive_a_rigid_move(spark):
    p = cloud(spark, 40, 3)
    moved = projections.move(p, se3.literal(3, -2, 7, *se3.from_rpy(10, 40, 70)))
    a, b = ({r.id: r.neighbours for r in joins.radius_count(x, 3.0, ("id",)).collect()} for x in (p, moved))
    assert a == b


def test_bracket_states(spark):
    q = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 5.0), ("a", 9.0), ("b", 1.0)], "k string, t double")
    s = spark.createDataFrame([("a", 2.0, 20.0), ("a", 6.0, 60.0)], "k string, t double, v double")
    got = {(r.k, r.t): (r.l_t, r.r_t, r.state) for r in joins.bracket(q, s, ("k",), "t", ("v",)).collect()}
    assert got == {("a", 1.0): (None, 2.0, "late"), ("a", 2.0): (2.0, 2.0, "ok"), ("a", 5.0): (2.0, 6.0, "ok"), ("a", 9.0): (6.0, None, "early"), ("b", 1.0): (None, None, "late")}


def test_index_percentiles_and_upper_median(spark):
    v = spark.createDataFrame([(float(i % 7),) for i in range(20)], "v double")
    s = sorted(float(i % 7) for i in range(20))
    got = aggregates.percentile_at(v, "v", (), a=aggregates.rank_floor(0.95), b=aggregates.rank_inner(0.95), m=F.floor(F.col("n") / 2)).first()
    assert (got.a, got.b, got.m) == (s[19], s[18], s[10])


def test_single_row_deviation_is_zero(spark):
    assert aggregates.statistics(spark.createDataFrame([(3.0,)], "v double"), "v").first().sd == 0.0


def test_voxel_merge_is_idempotent(spark):
    p = cloud(spark, 50, 5).withColumns({"intensity": F.col("x"), "range": F.col("y"), "gps_time": F.col("z"), "scanner_id": F.col("id")})
    once = aggregates.voxel_merge(p, 1.0, ("id",)).withColumn("id", F.col("scanner_id"))
    twice = aggregates.voxel_merge(once, 1.0, ("id",))
    assert sorted(map(tuple, once.select("voxel", "intensity", "range").collect())) == sorted(map(tuple, twice.select("voxel", "intensity", "range").collect()))


def test_votes_tie_is_static(spark):
    p = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, is_ground int")
    v = spark.createDataFrame([(1, 2, 2), (2, 1, 2), (3, 0, 9)], "id int, static int, dynamic int")
    assert {r.id: r.is_dynamic for r in scans.dynamic(p, v, ("id",)).collect()} == {1: False, 2: True, 3: False}


def test_blend_is_linear_not_softmax(spark):
    v = spark.createDataFrame([(1, 3.0, 10.0), (1, 1.0, 30.0), (1, 0.5, 1000.0), (1, 0.0, 5.0)], "id int, w double, c double")
    assert scans.blend(v, ("id",), 2, (), ("c",)).first().c == pytest.approx(15.0)


def test_azimuth_wraps_only_when_spinning():
    assert projections.ScanImage(2 * math.pi, 1, 0.01, 0.02).spinning and not projections.ScanImage(3.0, 1, 0.01, 0.02).spinning


def test_keyframes_are_relative_to_the_last_selected():
    pdf = pd.DataFrame({"x": [0, 0.6, 1.2, 1.8, 2.6], "y": 0.0, "z": 0.0})
    assert list(windows.keyframes(pdf, 1.0).index) == [0, 2, 4]
    assert list(windows.time_buckets(pd.DataFrame({"t": [0, 0.9, 1.8, 2.0, 3.0]}), "t", 1.0).bucket) == [0, 0, 1, 1, 2]


def test_plane_normals_point_to_the_sensor(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(-1, 1, (40, 2))
    p = spark.createDataFrame([(i, float(a), float(b), 5.0) for i, (a, b) in enumerate(xy)], "id long, x double, y double, z double")
    knn = joins.knn_within(p, 10, 3.0, ("id",))
    n = numeric.eigen(numeric.moments(knn, ("id",)), ("id",), ("mx", "my", "mz")).toPandas()
    assert np.allclose(n.nz, -1, atol=1e-6) and np.allclose(n.l0, 0, atol=1e-9)


def test_covariance_divisors(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)], "id int, r_x double, r_y double, r_z double")
    assert numeric.moments(p, ("id",)).first().c_xx == 1.0 and numeric.moments(p, ("id",), sample=True).first().c_xx == 2.0


def test_regularisation():
    m = np.diag([0.01, 1.0, 2.0])[None]
    assert np.allclose(np.linalg.eigvalsh(numeric.regularised(m, "plane")[0]), [1e-3, 1, 1])
    assert np.allclose(np.linalg.eigvalsh(numeric.regularised(m, "normalised_min")[0])[2], 1)
    assert np.allclose(numeric.regularised(m, "none"), m)


def test_icp_recovers_a_shift(spark):
    p = cloud(spark, 80, 7)
    moved = p.select("id", (F.col("x") + 0.2).alias("x"), (F.col("y") - 0.1).alias("y"), "z")
    rotation, shift, error = numeric.icp(moved, p, 1.5, 10)
    assert np.allclose(rotation, np.eye(3), atol=1e-3) and np.allclose(shift, [-0.2, 0.1, 0], atol=1e-3) and error < 1e-3


def test_graph_optimisation_closes_a_loop():
    truth = {k: np.eye(4) for k in range(6)}
    for k in truth:
        truth[k][:3, :3] = numeric.so3_exp(np.array([0, 0, k * 0.5]))
        truth[k][:3, 3] = math.cos(k), math.sin(k), 0.1 * k
    edges = [(a, (a + 1) % 6, np.linalg.inv(truth[a]) @ truth[(a + 1) % 6], 0.1) for a in range(6)]
    rng = np.random.default_rng(1)
    start = {}
    for k, t in truth.items():
        noise = np.eye(4)
        noise[:3, :3] = numeric.so3_exp(rng.normal(0, 0.05, 3) * (k > 0))
        noise[:3, 3] = rng.normal(0, 0.1, 3) * (k > 0)
        start[k] = t @ noise
    solved = numeric.optimise_graph(start, edges)
    assert all(np.allclose(solved[k], truth[k], atol=1e-6) for k in truth)


def test_imu_holds_the_last_sample():
    pdf = pd.DataFrame({"stamp": [0.5], "ax": [1.0], "ay": [0.0], "az": [0.0], "wx": [0.0], "wy": [0.0], "wz": [0.0]})
    got = numeric.integrate_imu(pdf, 0.0, 1.0)
    assert got["velocity"][0] == pytest.approx(1.0) and got["position"][0] == pytest.approx(0.5)


def test_ransac_ignores_outliers():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 3))
    r = numeric.so3_exp(np.array([0.1, 0.2, 0.3]))
    b = a @ r.T + [1, 2, 3]
    b[:10] += rng.normal(size=(10, 3)) * 5
    rotation, shift, inlier = numeric.ransac_rigid(a, b, 0.01)
    assert np.allclose(rotation, r, atol=1e-6) and np.allclose(shift, [1, 2, 3], atol=1e-6) and inlier[10:].all()


def test_min_cut_separates_two_blobs():
    rng = np.random.default_rng(0)
    xyz = np.concatenate([rng.normal(0, 0.1, (15, 3)), rng.normal(0, 0.1, (15, 3)) + [3, 0, 0]])
    near = [np.flatnonzero(((xyz - p) ** 2).sum(1) < 1) for p in xyz]
    mask = numeric.min_cut_labels(xyz, near, 0, 2.0)
    assert mask[:15].all() and not mask[15:].any()


def test_calibration_fit():
    x = np.linspace(0, 1, 20)
    got = numeric.fit_levenberg(lambda p: p[0] * np.exp(p[1] * x) - 2 * np.exp(-1.5 * x), np.array([1.0, -1.0]))
    assert np.allclose(got, [2, -1.5], atol=1e-5)


def test_connected_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)], "i long, j long")
    assert {r.id: r.root for r in sets.connected(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}


def test_graph_recovery(spark):
    n = spark.createDataFrame([("s", i) for i in range(5)], "session string, id int")
    e = spark.createDataFrame([(0, 1), (2, 3)], "i int, j int")
    assert {(r.i, r.j) for r in sets.missing_links(n, e).collect()} == {(1, 2), (3, 4)}


def test_nmea_checksum(spark):
    lines = spark.createDataFrame([(1, "$GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*6A"), (2, "$GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*6B"), (3, None), (4, "")], "id int, value string")
    got = formats.parse_rmc(lines).collect()
    assert [r.id for r in got] == [1] and got[0].lat == pytest.approx(48 + 7.038 / 60) and (got[0].hour, got[0].minute, got[0].second) == (12, 35, 19)


def test_point_messages_without_xyz():
    assert formats.decode_points(b"\0" * 8, 4, [("x", 0, 7)]) is None
    pdf = pd.DataFrame({"x": [1.0, 2.0], "y": [0.0, 0.0], "z": [0.0, 0.0], "r": [2.0, 0.5], "g": [0.0, 0.0], "b": [0.0, 0.0], "a": [1.0, 1.0]})
    data, step, fields = formats.encode_points(pdf)
    back = formats.decode_points(data, step, fields)
    assert back.x.tolist() == [1.0, 2.0] and back.r.tolist()[0] == 1.0


def test_map_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0, 1, 1.0, 2.0, 3.0, None), (0, 2, float("nan"), 0.0, 0.0, 5.0)], "session_id int, submap_id int, x double, y double, z double, intensity double")
    s = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "submap_id int, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    maps.save_submaps(p, s, str(tmp_path))
    points, submaps = maps.load_submaps(spark, str(tmp_path))
    assert points.count() == 1 and set(submaps.select("session_id").distinct().toPandas().session_id) == {0}
    world = maps.export_points(points, submaps).first()
    assert (world.x, world.intensity) == (2.0, None)


def test_ply_bytes():
    data = maps.ply(pd.DataFrame({"x": [1.0], "zone": np.array([3], np.int32)}))
    assert data.startswith(b"ply\n") and len(data.split(b"end_header\n")[1]) == 12


def test_config_and_plugins(spark):
    c = Config('{"a": {"b": 1 /* one */, "u": "http://x"}, // end\n "T": [0,0,0,0,0,0,2]}')
    assert c.get("a", "b", default=0) == 1 and c.get("a", "u", default="") == "http://x" and c.get("z", default=5) == 5
    assert c.pose("T")[6] == 1.0
    with pytest.raises(TypeError):
        c.get("a", "b", default="text")
    slot = Slot()
    key = slot.add(lambda v: v + 1)
    assert slot.through(1) == 2
    slot.remove(key)
    assert slot.through(1) == 1
    assert Filter(lambda df: df.id > 1).apply(spark.range(4)).count() == 2
    s = Strategies("simple")
    s.register("simple", int)
    assert s.get("matched") is int


def test_range_image_conventions(spark):
    p = spark.createDataFrame([(0, 10.0, 0.0, 0.0), (0, 5.0, 0.0, 0.0), (0, 1.0, 0.0, 0.0)], "f int, x double, y double, z double")
    assert scans.nearest_image(p, projections.ScanImage(), ("f",)).first().range == 5.0
    assert scans.farthest_image(p, ("f",)).first().range == 10.0


def test_odometry_follows_a_moving_sensor():
    rng = np.random.default_rng(0)
    world = rng.uniform(-8, 8, (700, 3))
    rows = []
    for f in range(5):
        share = np.linspace(0, 1, len(world))
        position = np.array([0.3, 0.1, 0.0]) * (f + share[:, None])  # moves during the scan
        pick = rng.permutation(len(world))[:350]
        seen = world[pick] - position[pick]
        rows.append(pd.DataFrame({"frame_id": f, "stamp": f * 0.1, "t": share[pick] * 0.1, "x": seen[:, 0], "y": seen[:, 1], "z": seen[:, 2]}))
    got = odometry.track(pd.concat(rows))
    steps = np.diff(got[["x", "y", "z"]].to_numpy(), axis=0)
    assert np.allclose(steps[2:], [0.3, 0.1, 0.0], atol=0.08)


def test_voxel_map_finds_the_nearest_of_all_and_in_time():
    """Against all distances; queries by cell, not one by one (100,000 took over ten seconds so)."""
    import time

    rng = np.random.default_rng(3)
    m = odometry.VoxelMap(1.0, apart=0.05)
    m.insert(rng.uniform(-1, 1, (400, 3)))
    held = np.array([p for c in m.cells.values() for p in c[1]])
    asked = rng.uniform(-1.5, 1.5, (100_000, 3))
    since = time.perf_counter()
    target, found = m.nearest(asked, 0.4)
    assert time.perf_counter() - since < 5
    for q, t, f in zip(asked[:500], target, found, strict=False):
        d2 = ((held - q) ** 2).sum(1)
        assert f == (d2.min() <= 0.16) and (not f or np.array_equal(t, held[d2.argmin()]))


def test_voxel_map_is_bounded():
    m = odometry.VoxelMap(1.0, most=2, apart=0.2, horizon=5)
    m.insert(np.array([[0.1, 0.1, 0.1], [0.15, 0.1, 0.1], [0.9, 0.9, 0.9], [0.5, 0.5, 0.5]]))
    assert len(m.cells[(0, 0, 0)][1]) == 2
    for _ in range(19):
        m.insert(np.array([[5.5, 5.5, 5.5]]))
    assert (0, 0, 0) not in m.cells


def test_imu_prediction_falls_freely():
    imu = pd.DataFrame({"stamp": [0.5, 1.0], "ax": 0.0, "ay": 0.0, "az": 0.0, "wx": 0.0, "wy": 0.0, "wz": 0.0})
    pose, velocity = odometry.predict_with_imu(np.eye(4), np.array([1.0, 0, 0]), imu, 0.0, 1.0)
    assert np.allclose(pose[:3, 3], [1, 0, -4.905]) and np.allclose(velocity, [1, 0, -9.81])


def test_evicted_keyframe_is_in_the_crowd():
    xyz = np.array([[0.0, 0, 0], [0.1, 0, 0], [0.2, 0, 0], [9, 0, 0], [10, 0, 0]])
    assert mapping.evicted_keyframe(xyz) in (0, 1, 2)


def test_initial_state_is_upright():
    rotation, size = mapping.initial_state(pd.DataFrame({"ax": [9.81], "ay": [0.0], "az": [0.0]}))
    assert np.allclose(rotation @ [1, 0, 0], [0, 0, 1]) and size == pytest.approx(9.81)


def test_fold_does_not_need_the_rows_in_order(spark):
    df = spark.createDataFrame([(1, i, float(i) * 0.6, 0.0, 0.0) for i in (4, 2, 0, 3, 1)], "k int, id long, x double, y double, z double")
    got = windows.folded(df, ("k",), ("id",), lambda pdf: windows.keyframes(pdf, 1.0), "k int, id long, x double, y double, z double")
    assert sorted(r.id for r in got.collect()) == [0, 2, 4]


def test_layouts_parse(spark):
    from cartoflow import schema
    from pyspark.sql.types import StructType

    for name in ("POSE", "POINTS", "KNN", "FRAMES", "SUBMAPS", "FACTORS", "GRAPH_VALUES", "IMU", "GNSS", "TRAJECTORY", "MATCHES", "GEOID", "CHUNKS"):
        assert isinstance(StructType.fromDDL(getattr(schema, name)), StructType)


def test_operators_take_empty_tables(spark):
    p = spark.createDataFrame([], "id long, k string, t double, x double, y double, z double, intensity double, is_ground int, range double, gps_time double, scanner_id int")
    made = [
        filters.distance_band(p), filters.range_filter(p, 1.0, 5.0, 1.0, 2.0), aggregates.voxel_merge(p, 1.0, ("id",)), aggregates.voxel_gaussians(p, 1.0), aggregates.upper_median(p, "x", "k"),
        windows.travel(p, ("k",), ("t",)), windows.island_sizes(p, ("k",), "t", 1.0), windows.waypoints(p, ("k",), ("t",), 5.0), joins.radius_count(p, 1.0, ("id",)), joins.knn_within(p, 3, 1.0, ("id",)),
        joins.bracket(p.select("k", "t"), p.select("k", "t", "x"), ("k",), "t", ("x",)), joins.close_pairs(p.select("id", "x", "y", "z"), 1.0), scans.nearest_image(p, projections.ScanImage(), ("k",)),
        mapping.grow_region(p.withColumns({f"n{c}": F.col(c) for c in "xyz"}), 1.0, 10.0), numeric.fit_ground(numeric.ground_patches(p, 5.0, 45.0), ("k", "sector", "zone"), ("id",)),
    ]
    assert all(d.count() == 0 for d in made)


def test_single_rows_and_ties(spark):
    p = spark.createDataFrame([(1, "a", 0.0, 1.0, 1.0, 1.0)] * 3 + [(2, "a", 0.0, 1.0, 1.0, 1.0)], "id long, k string, t double, x double, y double, z double")
    assert joins.radius_count(p.distinct(), 0.5, ("id",)).select("neighbours").distinct().collect()[0][0] == 2
    assert windows.travel(p, ("k",), ("t", "id")).agg(F.sum("step")).first()[0] == 0.0
    assert windows.headings(p.limit(1), ("k",), ("t",)).first().heading == 0.0


def test_stream_equals_batch_at_any_file_count(spark, sf):
    from cartoflow.streaming import streams

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    results = []
    for files in (1, 5):
        s = streams.file_stream(spark, streams.replay_folder(e, files, "event_id"), e.schema, 1)
        made = streams.drain(streams.counted_windows(s, "user_id", "event_id", 7, "key long, submap int, n int, total double"))
        results.append(sorted((r.key, r.submap, round(r.total, 6)) for r in made.collect()))
    assert results[0] == results[1]


def test_windowed_and_session_streams_close_by_watermark(spark, sf):
    from cartoflow.streaming import streams

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    s = streams.file_stream(spark, streams.replay_folder(e, 3, "event_id"), e.schema, 1)
    counts = streams.drain(streams.windowed_counts(s, "ts", "1 hour", "6 hours", "event_type"))
    batch = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    closed = {(r.start, r.event_type): r.n for r in counts.collect()}
    whole = {(r.w.start, r.event_type): r.n for r in batch.collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())
    assert streams.drain(streams.silent(s, "ts", "1 hour", "2 hours", "user_id")).count() > 0


def test_edge_information_grows_with_certainty(spark):
    p = cloud(spark, 60, 2)
    a, b = (numeric.edge_information(p, p, np.eye(3), np.zeros(3), 0.5, s) for s in (0.1, 0.2))
    assert np.allclose(a, 4 * b) and (np.linalg.eigvalsh(a) > 0).all()


def test_flat_radius_stops_at_the_step(spark):
    rng = np.random.default_rng(0)
    flat = np.c_[rng.uniform(-10, 10, (400, 2)), rng.normal(0, 0.01, 400)]
    flat[np.linalg.norm(flat[:, :2], axis=1) > 5, 2] += rng.uniform(0, 8, int((np.linalg.norm(flat[:, :2], axis=1) > 5).sum()))
    p = spark.createDataFrame([tuple(map(float, v)) for v in flat], "x double, y double, z double")
    assert mapping.flat_radius(p, (0, 0, 0), [2.0, 4.0, 9.0], 5) == 4.0


def test_trails_are_long_and_slim(spark):
    rows = [(1, float(i), 0.5, 0.5) for i in range(12)] + [(2, float(i % 3), float(i // 3), 0.5) for i in range(9)]
    c = spark.createDataFrame(rows, "root int, x double, y double, z double")
    assert [r.root for r in mapping.trails(c, 1.0, 5.0, 3.0, 0.5).collect()] == [1]


def test_export_dialects(spark):
    cams = spark.createDataFrame([(7, 1.0, 2.0, 3.0)], "cam int, x double, y double, z double")
    assert maps.bundler_lines(cams, 320.0).first().line.endswith("-1.000000 -2.000000 -3.000000")
    import xml.etree.ElementTree as tree

    document = tree.fromstring(maps.blocks_document(maps.blocks_exchange(cams).first().line, 640, 480, 320.0))
    assert document.find(".//Photo/Pose/Center/y").text == "2.000000"
