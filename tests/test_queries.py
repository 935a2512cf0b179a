"""Every query with SQL against DuckDB on the same tables; the others must run and keep their schema."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from cartoflow import plans


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, numbers.Real) and not isinstance(v, bool) and abs(v) < 2**53:
            return repr(float(v))  # a nullable integer column is of doubles in pandas
        return str(v)

    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file.split('.')[0]} as select * from '{sf}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    ours = plans.QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(plans.ORACLES[name]).df()
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_pose_graph_holds_every_submap(spark, sf):
    submaps = {r[0] for r in plans.path_queries.path(spark, sf).select("submap_id").distinct().collect()}
    assert {r.id for r in plans.QUERIES["pose_graph_opt"](spark, sf).collect()} == submaps


def test_odometry_runs_on_every_frame(spark, sf):
    frames = {tuple(r) for r in plans.path_queries.points(spark, sf).select("submap_id", "frame_id").distinct().collect()}
    assert {(r.submap_id, r.frame_id) for r in plans.QUERIES["odometry"](spark, sf).collect()} == frames


def _cloud(spark, sf):
    from cartoflow.plans.path_queries import ORDER, cloud

    return cloud(spark, sf).toPandas().sort_values(list(ORDER)).reset_index(drop=True), list(ORDER)


def test_nearest_neighbours_of_every_point(spark, sf):
    """The expanding search against all distances of each frame, and the moments and normals that follow from it."""
    import numpy as np

    points, order = _cloud(spark, sf)
    want = {}
    for _, frame in points.groupby("frame_id"):
        xyz = frame[["x", "y", "z"]].to_numpy()
        d2 = ((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(2)
        keys = list(frame[order].itertuples(index=False, name=None))
        for i, row in enumerate(np.argsort(d2, axis=1, kind="stable")[:, :10]):
            want[keys[i]] = (d2[i, row], xyz[row])
    got = plans.QUERIES["normals"](spark, sf).toPandas()
    assert len(got) == len(want) == len(points)
    for r in got.itertuples(index=False):
        d2, near = want[tuple(getattr(r, c) for c in order)]
        values = np.linalg.eigvalsh(np.cov(near.T, bias=True))
        assert np.allclose([r.l0, r.l1, r.l2], values, atol=2e-4)
    knn = plans.QUERIES["knn5"](spark, sf).toPandas()
    assert len(knn) == sum(min(5, len(d)) for d, _ in want.values())
    for r in knn.itertuples(index=False):
        assert abs(want[tuple(getattr(r, c) for c in order)][0][r.rank] - r.d2) < 1e-5


def test_nearest_neighbours_of_odd_groups(spark):
    """Fewer points than asked for, all in one place, far apart, and none."""
    from cartoflow.operators import joins

    rows = [(1, "a", 0.0, 0.0, 0.0), (2, "a", 0.0, 0.0, 0.0), (3, "a", 0.0, 0.0, 0.0), (4, "b", 0.0, 0.0, 0.0), (5, "b", 1e6, 0.0, 0.0), (6, "c", 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, z double")
    got = sorted((r.id, r["rank"], r.r_id) for r in joins.nearest(df, 2, ("id",), ("g",)).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 2), (3, 0, 1), (3, 1, 2), (4, 0, 4), (4, 1, 5), (5, 0, 5), (5, 1, 4), (6, 0, 6)]
    assert joins.nearest(df.limit(0), 2, ("id",), ("g",)).count() == 0


def test_outlier_select_by_all_distances(spark, sf):
    import numpy as np

    points, order = _cloud(spark, sf)
    xyz = points[["x", "y", "z"]].to_numpy()
    from_centre = (xyz**2).sum(1)
    context = np.flatnonzero(from_centre < 30.0**2)
    d = np.array([np.sqrt(np.sort(((xyz[context] - xyz[i]) ** 2).sum(1))[:6]).mean() for i in context])
    out = set(context[d > d.mean() + d.std(ddof=1)].tolist())
    want = {tuple(points.loc[i, order]) for i in range(len(points)) if from_centre[i] < 20.0**2 and i in out}
    assert {tuple(r) for r in plans.QUERIES["outlier_select"](spark, sf).select(*order).toPandas().itertuples(index=False, name=None)} == want


def test_trail_clusters_by_union_find(spark, sf):
    points, _ = _cloud(spark, sf)
    cells = {tuple(math.floor(v / 2) for v in p) for p in points[["x", "y", "z"]].itertuples(index=False)}
    left, want = set(cells), []
    while left:
        todo, found = [left.pop()], []
        while todo:
            x, y, z = todo.pop()
            found.append(x)
            near = {(x + i, y + j, z + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)} & left
            left -= near
            todo += near
        want.append((len(found), float(min(found)), float(max(found))))
    got = plans.QUERIES["trail_clusters"](spark, sf).collect()
    assert sorted((r.cells, r.lo_x, r.hi_x) for r in got) == sorted(want)


def test_keyframes_by_hand(spark, sf):
    """Distance over 60 or turn over 1.5 from the last selected row of the session's submap."""
    rows = plans.path_queries.path(spark, sf).select("session", "submap_id", "ts", "id", "x", "y", "z").toPandas().sort_values(["ts", "id"])
    want = set()
    for _, group in rows.groupby(["session", "submap_id"]):
        last = None
        for r in group.itertuples(index=False):
            turn = 0.0 if last is None else abs((r.id % 360 - last.id % 360 + 180) % 360 - 180)
            if last is None or math.dist((r.x, r.y, r.z), (last.x, last.y, last.z)) > 60 or math.radians(turn) > 1.5:
                want.add((r.session, r.submap_id, r.id))
                last = r
    assert {tuple(r) for r in plans.QUERIES["keyframes"](spark, sf).select("session", "submap_id", "id").collect()} == want


def test_feature_search_in_blocks(spark, sf):
    """Queries in several passes find what one pass finds."""
    from cartoflow.operators import joins

    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    few = v.where("vec_id % 20 = 0")
    a, b = (sorted((r["query"], r["rank"], r.vec_id) for r in joins.vector_nearest(v, few, 5, block).select("query", "rank", "vec_id").collect()) for block in (65_536, 3))
    assert a == b and len(a) == 5 * few.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["radius_count", "knn5", "loop_candidates", "nearest_xy", "points_cameras", "overlap_pairs", "asof_bracket", "dynamic_votes"])
def test_joins_are_not_nested_loops(spark, sf, name):
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plans.QUERIES["gnss_gate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,signup)" in plan.split("PushedFilters: ")[1].split("]")[0]
    assert "o_orderpriority" not in plans.QUERIES["travel_dist"](spark, sf)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_geoid_height_of_every_fix(spark):
    """Fixes that share an id, or have none, are rows of their own; the last grid line is inside."""
    from cartoflow.sources import formats

    grid = spark.createDataFrame([(i / 2, j / 2, i / 2 + 10.0 * j) for i in range(3) for j in range(3)], "lat double, lon double, n double")
    fixes = spark.createDataFrame([(1, 0.25, 0.25), (1, 0.75, 0.5), (None, 0.5, 0.5), (2, 1.0, 1.0), (3, 1.2, 0.0)], "id long, lat double, lon double")
    got = sorted((r.id or 0, r.undulation) for r in formats.undulation(fixes, grid, 0.0, 0.0, 0.5).collect())
    assert got == [(0, 10.5), (1, 5.25), (1, 10.75), (2, 21.0)]


@pytest.mark.parametrize("keyed", [True, False])
def test_strips_of_large_groups_hold_every_neighbour(spark, monkeypatch, keyed):
    """Groups cut into strips: copies of places, sparse ends and a far point; no pair is made to count."""
    import numpy as np

    from cartoflow.operators import blocks, joins

    monkeypatch.setattr(blocks, "STRIP", 60)
    rng = np.random.default_rng(5)
    dense = np.round(rng.uniform(0, [4, 20, 2], (500, 3)), 1)
    xyz = np.concatenate([dense, dense[:60], np.repeat(dense[:1], 20, 0), rng.uniform(30, 90, (12, 3)), [[0.0, 900.0, 0.0], [0.0, -0.0, 0.0]]])
    group = rng.integers(0, 2, len(xyz)) * 3 if keyed else np.zeros(len(xyz), int)
    frame = pd.DataFrame({"id": np.arange(len(xyz)), "g": group, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
    lost = pd.DataFrame({"id": [-1, -2], "g": [0, 3], "x": [float("nan"), 1.0], "y": [0.0, float("inf")], "z": [0.0, 0.0]})
    df, keys = spark.createDataFrame(pd.concat([frame, lost])), ("g",) if keyed else ()
    d2 = sum((xyz[:, None, k] - xyz[None, :, k]) ** 2 for k in range(3))
    d2[group[:, None] != group[None, :]] = np.inf
    counts = joins.radius_count(df, 1.5, ("id",), keys)
    assert {r.id: r.neighbours for r in counts.collect()} == dict(enumerate((d2 <= 2.25).sum(1).tolist()))
    order = np.argsort(d2, axis=1, kind="stable")[:, :4]
    got = {(r.id, r["rank"]): (r.r_id, r.d2) for r in joins.nearest(df, 4, ("id",), keys).collect()}
    assert got == {(i, n): (int(j), float(d2[i, j])) for i, row in enumerate(order) for n, j in enumerate(row)}
    for r in joins.neighbourhoods(df, 4, ("id",), keys).collect():
        near = xyz[order[r.id]]
        assert r.k == 4 and np.isclose(r.d, np.sqrt(d2[r.id, order[r.id]]).mean())
        assert np.allclose([r.mx, r.my, r.mz], near.mean(0)) and np.allclose([r.c_xx, r.c_xy, r.c_yz, r.c_zz], np.cov(near.T, bias=True)[[0, 0, 1, 2], [0, 1, 2, 2]])


def test_surroundings_and_nearest_place_by_all_distances(spark, monkeypatch):
    """Zero returns, cameras and path rows against all pairs, over strips, copies, missing places and missing intensities."""
    import numpy as np

    from cartoflow.operators import blocks, joins, mapping

    monkeypatch.setattr(blocks, "STRIP", 50)
    rng = np.random.default_rng(9)
    xyz = np.round(rng.uniform(0, [4, 30, 2], (400, 3)), 1)
    xyz[300:] = xyz[:100]
    frame = pd.DataFrame({"id": np.arange(400), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "intensity": rng.integers(0, 4, 400).astype(float)})
    d2 = sum((xyz[:, None, k] - xyz[None, :, k]) ** 2 for k in range(3))
    lit = frame["intensity"].to_numpy() > 0
    near = (d2 <= 1.0) & lit[None, :]
    with np.errstate(invalid="ignore"):
        mean = np.where(lit, frame["intensity"], (near * frame["intensity"].to_numpy()).sum(1) / near.sum(1))
    rows = [tuple(r) for r in frame.itertuples(index=False)] + [(900, 1.0, 1.0, 1.0, None), (901, None, 1.0, 1.0, 0.0), (902, None, 1.0, 1.0, 2.0)]
    df = spark.createDataFrame([tuple(v if v is None else float(v) if n else int(v) for n, v in enumerate(r)) for r in rows], "id long, x double, y double, z double, intensity double")
    got = {r.id: r.intensity for r in mapping.fill_zero_intensity(df, 1.0, ("id",)).collect()}
    assert len(got) == 403 and (got[900], got[901], got[902]) == (None, None, 2.0)
    assert all((got[i] is None) == bool(np.isnan(m)) and (got[i] is None or abs(got[i] - m) < 1e-12) for i, m in enumerate(mean))
    seen = {r.id: (r.n, r.d2) for r in joins.surroundings(df.where("id < 300"), df.where("id between 300 and 399"), 1.0, ("id",), least=True).where("n > 0").collect()}
    want = {i: (int((d2[i, 300:] <= 1.0).sum()), float(d2[i, 300:].min())) for i in range(300) if (d2[i, 300:] <= 1.0).any()}
    assert seen == want
    path = spark.createDataFrame([(7, 0.0, 0.0), (3, 0.0, 0.0), (5, 9.0, 0.0), (6, 500.0, 0.0)], "id long, x double, y double")
    asked = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 14.0, 0.0), (4, 30.0, 0.0), (5, None, 0.0)], "cam long, x double, y double")
    found = joins.nearest_xy(asked, path, ("cam",), "id", 10.0)
    assert found.columns == ["cam", "x", "y", "r_id", "r_x", "r_y", "d2"]
    assert sorted((r.cam, r.r_id, r.d2) for r in found.collect()) == [(1, 3, 0.0), (2, 3, 0.0), (3, 5, 25.0)]
