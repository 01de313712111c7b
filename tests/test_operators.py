"""Operators that SQL cannot express, on small cases worked out by hand or by brute force."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atlasframe import functions as fn
from atlasframe import sources, streaming
from atlasframe.operators import align, blocks, clean, geometry, lookup, points, quantiles, regions, sections, series, spatial, stats, stencil, tiles, udf
from atlasframe.plans import fixtures as fx
from atlasframe.plans import queries
from conftest import DATA, same


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame(r.uniform(0, 30, (150, 3)), columns=list("xyz")).assign(point_id=range(150))
    return spark.createDataFrame(pdf).cache(), pdf


def test_functions(spark):
    r = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    m = [[F.lit(float(v)) for v in row] for row in r]
    one = spark.range(1)
    a = one.select(fn.axis_angle(m).alias("a"), *(e.alias(f"e{i}") for i, e in enumerate(fn.euler_angles(m)))).first()
    assert (a["a"]["z"], round(a["a"]["angle"], 6)) == (1.0, round(math.pi / 2, 6)) and round(a["e2"], 6) == 90
    half = [[F.lit(float(v)) for v in row] for row in np.diag([-1.0, 1.0, -1.0])]
    h = one.select(fn.axis_angle(half).alias("a")).first()["a"]
    assert round(abs(h["y"]), 6) == 1 and round(h["angle"], 6) == round(math.pi, 6)
    x = one.select(
        fn.linspace(0, 1, 5).alias("l"), fn.cumulative(F.array(*map(F.lit, (1.0, 2.0, 3.0)))).alias("c"), fn.differences(F.array(*map(F.lit, (1, 4, 9)))).alias("d"),
        fn.channel_number(F.lit("chan_07_x.tif")).alias("n"), fn.channel_number(F.lit("x.tif")).alias("no"), fn.channel_file(F.lit(3), "counts.csv").alias("f"),
        fn.plain_name(F.lit("Field, CA1_x")).alias("p"), fn.code_of(F.lit("b"), {"a": 1, "b": 2}).alias("k"), F.array(*fn.plane_basis(0.0, 0.0, 1.0)).alias("b"),
        F.array(*fn.ind2sub((4, 3, 2), 24)).alias("s"), fn.matmul(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), F.array(*map(F.lit, (0.0, 1.0, 1.0, 0.0))), 2).alias("mm"), F.get(fn.rigid_3d_to_2d(m, [1.0, 2.0, 3.0]), F.lit(1)).alias("r2"),
    ).first()
    assert x["l"] == [0, 0.25, 0.5, 0.75, 1] and x["c"] == [1, 3, 6] and x["d"] == [3, 5] and (x["n"], x["no"], x["f"]) == (7, None, "chan03_counts.csv")
    assert x["p"] == "field ca1 x" and x["k"] == 2 and x["s"] == [4, 3, 2] and x["mm"] == [2, 1, 4, 3] and round(x["r2"], 6) == 1
    u, v = np.array(x["b"][:3]), np.array(x["b"][3:])
    assert abs(u @ v) < 1e-9 and abs(u[2]) < 1e-9


def test_affine_round_trip(cloud):
    df, pdf = cloud
    m = [[0.9, 0.1, 0, 3], [-0.1, 1.1, 0, 2], [0, 0.2, 1, 1], [0, 0, 0, 1]]
    back = geometry.apply_affine(geometry.apply_affine(df, m), m, inverse=True).toPandas().sort_values("point_id")
    assert np.abs(back[list("xyz")].to_numpy() - pdf[list("xyz")].to_numpy()).max() < 1e-9


def test_knn_and_thinning_equal_brute_force(cloud):
    df, pdf = cloud
    p = pdf[list("xyz")].to_numpy()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    got = spatial.knn_join(df, df, 3, 1.0, "point_id", "point_id", same=False).toPandas()
    for i, g in got.groupby("point_id"):
        order = [k for k in np.argsort(d[i], kind="stable") if k != i][:3]
        assert g.sort_values("rank")["_right"].tolist() == order
    kept: list[int] = []
    for i in range(len(p)):
        if all(d[i, k] >= 6 for k in kept):
            kept.append(i)
    assert sorted(r[0] for r in spatial.thin_points(df, 6.0).select("point_id").collect()) == kept
    far = spatial.keep_by_distance(df, 0.8).count()
    assert far == 120
    label = {i: i for i in range(len(p))}
    for _ in range(len(p)):
        for a, b in zip(*np.nonzero(d < 4)):
            label[a] = label[b] = min(label[a], label[b])
    assert {r["point_id"]: r["component"] for r in spatial.cluster_points(df, 4.0).collect()} == label
    matched = spatial.match_clouds(df, df, 50, 20, 40, 5.0)
    assert matched.where("point_id = _right").count() == 150



def test_point_queries_take_all_points(spark):
    p = fx.points(spark, DATA).toPandas().sort_values("point_id")
    ids, xyz = p["point_id"].tolist(), p[list("xyz")].to_numpy()
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    kept: list[int] = []
    for i in range(len(ids)):
        if (d[i, kept] >= 3).all():
            kept.append(i)
    assert sorted(r["point_id"] for r in queries.QUERIES["k5_thin_points"](spark, DATA).collect()) == [ids[i] for i in kept]
    label = np.arange(len(ids))
    while ((least := np.where(d < 2, label[None], len(ids)).min(1)) < label).any():
        label = least
    got = {r["point_id"]: r["component"] for r in queries.QUERIES["d14_cluster_points"](spark, DATA).collect()}
    assert got == {i: ids[k] for i, k in zip(ids, label)}


def test_fits(spark, cloud):
    df, pdf = cloud
    a = 0.3
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    q = 1.3 * pdf[list("xyz")].to_numpy() @ r.T + [1, 2, 3]
    pairs = spark.createDataFrame(pdf.assign(u=q[:, 0], v=q[:, 1], w=q[:, 2]))
    assert np.allclose(stats.fit_similarity(pairs)[:3, :3], 1.3 * r) and np.allclose(stats.fit_affine(pairs)[:3, 3], [1, 2, 3])
    assert stats.transform_mse(pairs, stats.fit_affine(pairs)).first()[0] < 1e-12
    rigid = stats.fit_rigid(spark.createDataFrame(pdf.assign(u=pdf.x, v=pdf.y, w=-pdf.z)))
    assert np.linalg.det(rigid[:3, :3]) > 0
    line = stats.fit_lines(spark.createDataFrame(pd.DataFrame({"probe_id": 1, "x": [0.0, 0, 0], "y": [1.0, 2, 3], "z": [2.0, 4, 6]}))).first()
    assert np.allclose([line["dx"], line["dy"], line["dz"]], np.array([0, 1, 2]) / math.sqrt(5))


def _side(axis, n, length, radius, centre=(10.0, 20.0, 30.0), seed=3, arc=2 * math.pi):
    """Points on a cylinder's side, its middle at centre, and its bottom face's centre."""
    r = np.random.default_rng(seed)
    axis = np.array(axis, float) / np.linalg.norm(axis)
    u = np.cross(axis, [0.3, 0.2, -0.9])
    u /= np.linalg.norm(u)
    t, a = np.linspace(-length / 2, length / 2, n), r.uniform(0, arc, n)
    return np.array(centre) + t[:, None] * axis + radius * (np.cos(a)[:, None] * u + np.sin(a)[:, None] * np.cross(axis, u))


def _cylinder_by_hand(p):
    """The fit once more in numpy: (bottom, axis, radius)."""
    mean = p.mean(0)
    axis = np.linalg.eigh(np.cov((p - mean).T))[1][:, -1]
    e1 = np.cross(axis, [1.0, 0, 0] if abs(axis[0]) <= 0.9 else [0, 1.0, 0])
    e1 /= np.linalg.norm(e1)
    e2 = np.cross(axis, e1)
    a, b = (p - mean) @ e1, (p - mean) @ e2
    g, h, d = np.linalg.lstsq(np.column_stack([2 * a, 2 * b, np.ones(len(a))]), a**2 + b**2, rcond=None)[0]
    along = p @ axis
    if np.median(p[along > np.quantile(along, 0.95), 1]) < mean[1]:
        axis = -axis
    centre = mean + g * e1 + h * e2
    return centre + np.quantile((p - centre) @ axis, 0.99) * axis, axis, math.sqrt(d + g * g + h * h)


def test_cylinders(spark):
    """Long cylinders, a short one, a slanted one marked on half its side, one whose y hardly changes; collinear and too few points."""
    made = {1: _side([0, 1, 0], 60, 50, 4), 2: _side([0.2, -1, 0.5], 400, 80, 6, seed=5), 3: _side([1, 0.1, 0], 200, 30, 3, seed=6, arc=math.pi), 4: _side([0.4, 0.5, 0.8], 100, 25, 5, seed=7)}
    rows = [(k, *map(float, p)) for k, ps in made.items() for p in ps]
    rows += [(5, 1.0 * i, 2.0 * i, 3.0 * i) for i in range(10)] + [(6, 1.0, 2.0, 3.0)] * 3 + [(1, None, 1.0, 2.0), (1, float("nan"), 1.0, 2.0), (None, 1.0, 1.0, 1.0)]
    got = {r["implant_id"]: r for r in stats.fit_cylinders(spark.createDataFrame(rows, "implant_id int, x double, y double, z double").repartition(5), radius=2.5).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for k, p in made.items():
        bottom, axis, radius = _cylinder_by_hand(p)
        r = got[k]
        assert np.allclose([r["cx"], r["cy"], r["cz"]], bottom, atol=1e-6) and np.allclose([r["nx"], r["ny"], r["nz"]], axis, atol=1e-8) and math.isclose(r["radius"], radius, rel_tol=1e-6) and r["n"] == len(p)
    assert abs(got[1]["ny"]) > 0.99 and abs(got[1]["radius"] - 4) < 0.5 and got[1]["cy"] > 20 + 50 / 2 - 3
    assert got[5]["radius"] == 2.5 and np.allclose([got[5]["nx"], got[5]["ny"], got[5]["nz"]], np.array([1, 2, 3]) / math.sqrt(14))


def test_points_are_moved_whatever_their_keys(spark):
    """Repeated and null ids, null places, the last grid place and places outside."""
    field = spark.createDataFrame([(i, j, k, 1.0, 0.0, float(i)) for i in range(1, 5) for j in range(1, 4) for k in range(1, 4)], "i int, j int, k int, dx double, dy double, dz double")
    rows = [(1, 2.0, 2.0, 2.0), (1, 2.5, 1.5, 1.0), (1, 2.0, 2.0, 2.0), (None, 3.25, 3.0, 3.0), (2, 4.0, 3.0, 3.0), (3, 4.5, 3.0, 3.0), (4, None, 1.0, 1.0), (5, 40.0, 1.0, 1.0)]
    got = sorted(map(str, (tuple(r) for r in lookup.displace_points(spark.createDataFrame(rows, "point_id int, x double, y double, z double"), field).collect())))
    want = [(1, 1.0, 2.0, 0.0), (1, 1.5, 1.5, -1.5), (1, 1.0, 2.0, 0.0), (None, 2.25, 3.0, -0.25), (2, 3.0, 3.0, -1.0), (3, 4.5, 3.0, 3.0), (4, None, 1.0, 1.0), (5, 40.0, 1.0, 1.0)]
    assert got == sorted(map(str, want))
    flat = spark.createDataFrame([(s, i, j, 1.0 * s, 2.0) for s in (1, 2) for i in range(1, 4) for j in range(1, 4)], "slice int, i int, j int, dx double, dy double")
    two = [(7, 1, 2.0, 2.0), (7, 2, 2.0, 2.0), (None, 2, 1.5, 3.0), (8, None, 2.0, 2.0), (9, 3, 2.0, 2.0)]
    got = {(r["point_id"], r["slice"]): (r["x"], r["y"]) for r in lookup.displace_points_2d(spark.createDataFrame(two, "point_id int, slice int, x double, y double"), flat).collect()}
    assert got == {(7, 1): (1.0, 0.0), (7, 2): (0.0, 0.0), (None, 2): (-0.5, 1.0), (8, None): (2.0, 2.0), (9, 3): (2.0, 2.0)}


def test_warps_fill_what_they_do_not_hit(spark):
    v = spark.createDataFrame([("S", 1, 1, 1, 1, 5.0)], "sample_id string, channel int, y int, x int, z int, value double")
    move = [[1.0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 1], [0, 0, 0, 1]]
    for mode in ("nearest", "linear"):
        got = {r["z"]: r["value"] for r in lookup.warp_volume(v, move, (1, 1, 3), mode, 7.0).collect()}
        assert got == {1: 7.0, 2: 5.0, 3: 7.0}, mode
        assert {r["z"]: r["value"] for r in lookup.warp_volume(v, move, (1, 1, 3), mode).collect()} == {2: 5.0}
    field = spark.createDataFrame([(1, 1, k, 0.0, 0.0, 1.0) for k in range(1, 4)], "i int, j int, k int, dx double, dy double, dz double")
    one = np.eye(4).tolist()
    assert {r["z"]: r["value"] for r in lookup.warp_volume_field(v, field, one, (1, 1, 3), "nearest", 7.0).collect()} == {1: 7.0, 2: 5.0, 3: 7.0}


def test_distance_joins_at_and_below_zero(spark):
    p = spark.createDataFrame([(1, 0.0, 1.0), (2, -0.0, 1.0), (3, 2.0, 1.0), (4, None, 1.0), (5, float("nan"), 1.0)], "point_id int, x double, y double")
    pairs = lambda d: {(r[0], r[1]) for r in spatial.pairs_within(p, p, d, "point_id", "point_id", ("x", "y")).collect()}
    assert pairs(0) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)} and pairs(-1.0) == set() and pairs(2.0) >= {(1, 3), (3, 2)}
    assert {(r["point_id"], r["_right"]) for r in spatial.knn_join(p, p, 1, 1.0, "point_id", "point_id", ("x", "y"), same=False).collect()} == {(1, 2), (2, 1), (3, 1)}
    assert {r["point_id"] for r in spatial.anti_join_within(p, p.where("point_id = 1"), 0.0, cols=("x", "y")).collect()} == {3, 4, 5}
    with pytest.raises(ValueError, match="undecided"):
        spatial.knn_join(p, p, 3, 1e-6, "point_id", "point_id", ("x", "y"), rounds=2)


def test_raw_planes_in_natural_order_and_whole(spark, tmp_path):
    for n in (10, 2, 1):
        (tmp_path / f"plane{n}.raw").write_bytes(np.full((2, 3), n, "<u2").tobytes())
    got = {r["z"]: np.frombuffer(r["data"], "<u2")[0] for r in sources.read_raw_planes(spark, str(tmp_path / "*.raw"), 2, 3).collect()}
    assert got == {1: 1, 2: 2, 3: 10}
    (tmp_path / "plane3.raw").write_bytes(b"\0" * 13)
    with pytest.raises(ValueError, match="plane3.raw has 13 bytes"):
        sources.read_raw_planes(spark, str(tmp_path / "*.raw"), 2, 3)


def test_icp_finds_a_small_shift(cloud):
    df, pdf = cloud
    moved = df.withColumns({"x": F.col("x") + 0.4, "y": F.col("y") - 0.3})
    m, error = align.icp(df, moved, rounds=6, width=4.0)
    assert np.abs(m[:2, 3] - [-0.4, 0.3]).max() < 0.2 and error < 0.6
    slices = df.select(F.lit(1).alias("slice"), "x", "y")
    found = align.refine_per_slice(slices.withColumn("x", F.col("x") + 0.2), slices).first()
    assert found["error"] < 0.1
    assert align.flip_decision(slices, slices, 30).first()["flipped"] is False


def _volume(spark, a, **more):
    z, y, x = np.indices(a.shape)
    pdf = pd.DataFrame({"z": z.ravel() + 1, "y": y.ravel() + 1, "x": x.ravel() + 1, "value": a.ravel().astype(float)})
    return spark.createDataFrame(pdf.assign(sample_id="S", channel=1, **more))


def test_components_and_stats(spark):
    a = np.zeros((6, 6, 6))
    a[0:3, 0:3, 0:3] = 2
    a[5, 5, 5] = 4
    mask = _volume(spark, a).where("value > 0")
    c = stencil.connected_components(mask, ["sample_id"])
    got = stats.component_stats(c).orderBy("n").toPandas()
    assert got["n"].tolist() == [1, 27] and np.allclose(got["cx"], [6, 2]) and np.allclose(got["elongation"], 1)
    assert stencil.largest_component(c, ["sample_id"]).count() == 27
    assert stencil.dilate_ellipsoid(_volume(spark, a).where("value = 4"), (1, 1, 1), ["sample_id"]).count() == 7
    smooth = stencil.gaussian_smooth(_volume(spark, np.full((3, 3, 3), 5.0)), 1.0, ["sample_id"]).toPandas()
    assert np.allclose(smooth["value"], 5)
    ramp = stencil.gradient_magnitude(_volume(spark, np.indices((3, 3, 3))[2].astype(float)), ["sample_id"]).toPandas()
    assert np.allclose(ramp["gradient"], 1)


def test_neighbourhoods_of_volumes_with_holes(spark):
    r = np.random.default_rng(8)
    a = np.where(r.random((5, 9, 8)) < 0.25, np.round(r.random((5, 9, 8)) * 50) + 1e6, np.nan)
    voxels = _volume(spark, a).where("not isnan(value)")
    at = np.argwhere(~np.isnan(a))
    box = {tuple(p): a[tuple(slice(max(0, c - 2), c + 3) for c in p)] for p in at}
    key = lambda row: (row["z"] - 1, row["y"] - 1, row["x"] - 1)
    assert {key(x): x["extreme"] for x in stencil.local_max(voxels, 2, ["sample_id"]).collect()} == {p: np.nanmax(b) for p, b in box.items()}
    assert {key(x): x["extreme"] for x in stencil.local_min(voxels, 2, ["sample_id"]).collect()} == {p: np.nanmin(b) for p, b in box.items()}
    assert {key(x) for x in stencil.find_peaks(voxels, 2, 1e6 + 20, ["sample_id"]).collect()} == {p for p, b in box.items() if a[p] == np.nanmax(b) and a[p] > 1e6 + 20}
    got = {key(x): x["std"] for x in stencil.local_std(voxels, 2, ["sample_id"]).collect()}
    assert got.keys() == box.keys() and all(abs(got[p] - (np.nanstd(b, ddof=1) if (~np.isnan(b)).sum() > 1 else 0)) < 1e-6 for p, b in box.items())
    near = stencil.dilate(voxels.where("value > 1e6 + 45"), 2, voxels, ["sample_id"], 1e6 + 10)
    assert near.columns == voxels.columns
    assert {key(x) for x in near.collect()} == {p for p, b in box.items() if np.nanmax(b) > 1e6 + 45 and a[p] > 1e6 + 10}


def test_cells_without_band_pass_equal_brute_force(spark):
    r = np.random.default_rng(9)
    a = r.random((9, 14, 13)) * 0.5
    for z, y, x in ((2, 4, 4), (2, 4, 7), (6, 9, 8), (5, 2, 11)):
        a[z, y, x] = 2
        a[z - 1 : z + 2, y, x] += 1
    got = tiles.detect_cells_sql(_volume(spark, a), 2, 0.8, (14, 13), ["sample_id"], cube=1).toPandas().sort_values(["x", "y"])
    wide = np.pad(a, ((0, 0), (2, 2), (2, 2)), constant_values=-1)
    top = np.max([wide[:, i : i + 14, k : k + 13] for i in range(5) for k in range(5)], axis=0)
    peaks = np.pad((a > top - 1e-3) & (a > 0.8), 1)
    mask = np.any([peaks[h : h + 9, i : i + 14, k : k + 13] for h in range(3) for i in range(3) for k in range(3)], axis=0) & (a > 0.64)
    left, want = set(map(tuple, np.argwhere(mask))), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            p = todo.pop()
            part.append(p)
            near = {q for q in left if max(abs(i - k) for i, k in zip(p, q)) <= 1}
            left -= near
            todo += near
        w = np.array([a[p] for p in part])
        z, y, x = (np.array(part).T * w).sum(1) / w.sum() + 1
        if 2.7 <= len(part) <= 270 and 0.14 < y < 13.86 and 0.13 < x < 12.87:
            want.append((x, y, z, len(part), w.mean()))
    want.sort(key=lambda v: (v[0], v[1]))
    assert len(want) >= 3 and np.allclose(got[["x", "y", "z", "n", "intensity"]].to_numpy(float), want)


def test_cells_from_planes_equal_cells_from_voxels(spark, tmp_path):
    a = np.full((16, 40, 44), 10, "<u2")
    for z, y, x in ((8, 10, 10), (8, 30, 28), (12, 20, 40)):
        a[z - 2 : z + 2, y - 2 : y + 2, x - 2 : x + 2] = 200
    (tmp_path / "a.raw").write_bytes(a[:9].tobytes())
    (tmp_path / "b.raw").write_bytes(a[9:].tobytes())
    planes = sources.read_raw_planes(spark, str(tmp_path / "*.raw"), 40, 44, "S")
    options = tiles.Detection(2.0, 0.5, 0.25, 16, 24)
    flat = tiles.plane_voxels(planes).toPandas()
    assert len(flat) == a.size and (flat["value"].to_numpy() == a[flat["z"] - 1, flat["y"] - 1, flat["x"] - 1]).all()
    order = ["x", "y", "z"]
    one, two = (df.toPandas().sort_values(order)[order].to_numpy() for df in (tiles.detect_cells_in_planes(planes, options), tiles.detect_cells_3d(_volume(spark, a), options)))
    assert len(one) == len(two) >= 3 and np.allclose(one, two)
    small, full = tiles.preprocess_volume(planes, str(tmp_path / "out"), 2, options)
    assert small.count() == 16 and small.first()["ny"] == 20 and full.where("tz = 0 and ty = 0 and tx = 0").count() == 16
    part = full.where("z = 3 and ty = 1 and tx = 0").first()
    assert (part["y0"], part["x0"], part["ny"], part["nx"]) == (17, 1, 24, 32)


def test_samples_by_hash(spark):
    df = spark.range(5000).withColumn("k", F.col("id") % 7)
    one, two = (sorted(r[0] for r in stats.sample_n(df.repartition(n), 100, "id").select("id").collect()) for n in (1, 5))
    assert one == two and len(set(one)) == 100
    part = {r[0] for r in stats.sample_fraction(df, 0.3, "id").select("id").collect()}
    assert part == {r[0] for r in stats.sample_fraction(df.repartition(3), 0.3, "id").select("id").collect()} and 1300 < len(part) < 1700
    assert part <= {r[0] for r in stats.sample_fraction(df, 0.5, "id").select("id").collect()}
    capped = stats.cap_per_class(df, 50, "k", "id").groupBy("k").count().collect()
    assert {(r["k"], r["count"]) for r in capped} == {(k, 50) for k in range(7)}
    user, auto = (spark.createDataFrame(rows, "point_id int, x double, y double, z double") for rows in ([(1, 0.0, 0.0, 0.0)], [(2, 0.5, 0.0, 0.0), (3, 9.0, 0.0, 0.0), (4, 9.5, 0.0, 0.0), (5, 20.0, 0.0, 0.0)]))
    assert {(r["point_id"], r["weight"]) for r in spatial.augment_controls(user, auto, 2.0).collect()} == {(1, 1.0), (3, 1.0), (5, 1.0)}
    assert {(r["point_id"], r["weight"]) for r in spatial.augment_controls(user.where("false"), auto, 2.0).collect()} == {(2, 0.5), (3, 0.5), (5, 0.5)}


def test_nearest_slice_across_blocks_and_groups(spark):
    r = np.random.default_rng(2)
    atlas = spark.createDataFrame([(int(g), float(p)) for g in (0, 1) for p in np.round(r.normal(0, 9, 20), 1)], "g int, pos double")
    rows = [(i, int(i % 3), float(p)) for i, p in enumerate(np.round(r.normal(0, 15, 200), 1))] + [(900, 0, None)]
    samples = spark.createDataFrame(rows, "i int, g int, pos double")
    places = {g: sorted(x["pos"] for x in atlas.collect() if x["g"] == g) for g in (0, 1, 2)}
    every = sorted(places[0] + places[1])
    near = lambda p, all_: min(all_, key=lambda a: (abs(a - p), a)) if p is not None and all_ else None
    for blocks in (1, 7, 4096):
        assert {x["i"]: x["nearest"] for x in spatial.nearest_slice(samples, atlas, blocks=blocks).collect()} == {i: near(p, every) for i, g, p in rows}
        assert {x["i"]: x["nearest"] for x in spatial.nearest_slice(samples, atlas, group="g", blocks=blocks).collect()} == {i: near(p, places[g]) for i, g, p in rows}
    assert {x["nearest"] for x in spatial.nearest_slice(samples, atlas.where("false")).collect()} == {None}


def test_names_that_lie_in_each_other(spark):
    terms = spark.createDataFrame([(1, "CA1"), (2, "Layer 2, outer"), (3, "ab"), (4, "none"), (5, None), (6, "")], "region_id int, name string")
    other = spark.createDataFrame([("field CA1sp", 10), ("layer 2", 20), ("xaby", 30), ("b", 31), ("", 40), (None, 50)], "ext_name string, ext_value int")
    got = {r["region_id"]: r["ext_value"] for r in regions.join_by_name_unique(terms, other).collect()}
    assert got == {1: 10, 2: 20, 3: None, 4: None, 5: None, 6: None}


def test_divisions_that_are_missing_stay(spark):
    df = spark.createDataFrame([("Fiber tracts",), ("Cortex",), (None,)], "name string")
    from atlasframe.operators import clean

    assert {r[0] for r in clean.exclude_divisions(df).collect()} == {"Cortex", None}


def test_lines_beyond_the_ends(spark):
    rows = [("a", i, {2: 4.0, 4: 8.0, 7: 8.0, 8: 10.0}.get(i)) for i in range(11)] + [("b", 1, 5.0), ("b", 2, None)]
    got = {(r["k"], r["i"]): r["v"] for r in series.interpolate_slices(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v").collect()}
    assert [got["a", i] for i in range(11)] == [0, 2, 4, 6, 8, 8, 8, 8, 10, 12, 14] and got["b", 2] is None


def test_detection_does_not_depend_on_tiles_for_separate_blobs(spark):
    a = np.full((16, 40, 40), 10.0)
    for z, y, x in ((8, 10, 10), (8, 30, 28)):
        a[z - 2 : z + 2, y - 2 : y + 2, x - 2 : x + 2] = 200
    v = _volume(spark, a)
    for nxy in (64, 20):
        got = tiles.detect_cells_3d(v, tiles.Detection(2.0, 0.5, 0.25, 32, nxy)).toPandas().sort_values("x")
        assert len(got) == 2 and np.abs(got[["x", "y"]].to_numpy() - [[9.5, 9.5], [27.5, 29.5]]).max() < 1.6
    flat = tiles.detect_cells_2d(v.where("z = 8"), tiles.Detection(2.0, 0.5, 0.25)).toPandas()
    assert len(flat) == 2
    views = tiles.candidate_views(spark.createDataFrame([(1, "S", 1, 10, 10, 8)], "cell_id int, sample_id string, channel int, x int, y int, z int"), v, 2)
    assert views.count() == 75 and views.agg(F.max("value")).first()[0] == 200
    assert tiles.tile_bounds(tiles.make_tiles(v, tiles.Detection(2.0, nz=32, nxy=20)), tiles.Detection(2.0, nz=32, nxy=20)).count() >= 4


def test_planes(spark, tmp_path):
    raw = np.arange(2 * 4 * 6, dtype="<u2").reshape(2, 4, 6)
    (tmp_path / "a.raw").write_bytes(raw.tobytes())
    planes = sources.read_raw_planes(spark, str(tmp_path / "*.raw"), 4, 6, "S")
    assert [bytes(r["data"]) for r in planes.orderBy("z").collect()] == [p.tobytes() for p in raw]
    assert sources.plane_catalog(spark, str(tmp_path), 4, 6).first()["planes"] == 2
    small = tiles.preprocess_planes(planes).orderBy("z").first()
    assert (small["ny"], small["nx"]) == (2, 3)
    stack = sections.build_slice_stack(planes, buffer=1).collect()
    assert {(r["ny"], r["nx"]) for r in stack} == {(4, 6)}
    with pytest.raises(ValueError):
        sources.assert_uniform_shape(planes.withColumn("ny", F.col("z")), ["sample_id"])


def test_text_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a = 1 % note\n# b = 2\nc = [1 2]\na = 3\n")
    got = {r["key"]: r["value"] for r in sources.settings_table(spark, str(tmp_path / "s.txt"), {"a": "0", "d": "9"}).collect()}
    assert got == {"a": "3", "c": "[1 2]", "d": "9"}
    (tmp_path / "t.txt").write_text('(Transform "EulerTransform")\n(TransformParameters 0 0 0 1 2 3)\n(CenterOfRotationPoint 5 5 5)\n')
    assert sources.transforms_from_text(spark, str(tmp_path / "t.txt")).first()["m"] == [1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1]
    (tmp_path / "x.xml").write_text("<D><Cell><ID>1</ID><X>2</X><Y>3</Y><HS_0>1 2 3</HS_0><HS_1>4 5 6</HS_1></Cell></D>")
    assert sources.read_tile_xml(spark, str(tmp_path / "x.xml")).where("level = 1").first()["values"] == [4, 5, 6]
    files = spark.createDataFrame([("img10",), ("img9",), ("Img1",)], "f string")
    assert [r[0] for r in sources.natural_sort(files, "f").collect()] == ["Img1", "img9", "img10"]
    assert sources.read_slice_decisions(spark, None, 3).count() == 3
    p = spark.createDataFrame([(1.0, 2.0, 3.5)], "x double, y double, z double")
    sources.write_points(p, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).first()[0] == "1.0000000000 2.0000000000 3.5000000000"
    v = _volume(spark, np.ones((2, 2, 2)))
    sources.write_volume(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).where("z_block = 0").count() == 8


def test_tree_with_text_children_and_cycle_free_levels(spark):
    t = spark.createDataFrame([(1, None, "2;3"), (2, 1, None), (3, None, None), (4, 2, None)], "id long, parent_id long, children string")
    got = {(r[0], r[1]) for r in regions.descendants(t).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 4), (3, 3), (4, 4)}


def test_series(spark):
    eye = [1.0, 0, 1, 0, 1, 0, 0, 0, 1.0]
    m = spark.createDataFrame([("a", i, [float(v) for v in eye]) for i in range(3)], "k string, i int, m array<double>")
    assert [r["m"][2] for r in series.compose_along(m, ["k"], "i", n=3).orderBy("i").collect()] == [1, 2, 3]
    path = spark.createDataFrame([("a", i, float(i) if i in (0, 9) else None) for i in range(10)], "k string, i int, v double")
    assert np.allclose([r["v"] for r in series.smooth_path(path, "k", "i", ["v"], 1e-3).orderBy("i").collect()], range(10), atol=1e-2)
    turn = spark.createDataFrame([("a", i, 1.0, 0.1) for i in range(5)], "k string, i int, dx double, a double")
    assert np.allclose([r["a"] for r in series.smooth_transforms(turn, 1, ["k"], "i", ["dx"], "a").collect()], 0.1)
    assert spark.range(1).select(stats.midpoint_quantile(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), 0.5)).first()[0] == 2.5


def test_models(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 6))
    rows = [(i, [float(v) for v in x[i]], int(x[i, 0] > 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "cell_id int, view array<double>, label int")
    scored = points.ArtifactClassifier().fit(df).score(df)
    assert scored.where("label = predicted").count() > 190
    assert points.augment_views(df).count() == 200
    counts = spark.createDataFrame([(int(i % 4), float(v), int(np.exp(1 + 0.5 * v))) for i, v in enumerate(r.normal(size=120))], "fold int, x double, n int")
    got = stats.poisson_cross_validated(counts, ["x"], "n", "fold").toPandas()
    assert len(got) == 4 and (got["r2"] > 0.5).all()
    mat = spark.createDataFrame([(a, s, float(a * w)) for a in (1, 2, 3) for s, w in (("p", 1.0), ("q", 2.0))], "k int, sample_id string, value double")
    assert {r_["k"]: round(r_["strength"], 6) for r_ in stats.projection_strength(mat, "k").collect()} == {1: 0.5, 2: 1.0, 3: 1.5}
    assert stats.class_balance(df, "label", "cell_id").groupBy("label").count().select("count").distinct().count() == 1


def test_user_functions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    frame = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    for how, want in (("sum", [4, 5, 0]), (lambda v: v.max(), [3, 5, 0]), ("robust_std", [1.4826, 0, 0])):
        assert [round(r["value"], 4) for r in udf.grouped_reduce(df, ["k"], "v", how, frame).orderBy("k").collect()] == want
    assert udf.map_batches(df, lambda p: p.assign(v=p.v + 1), "k string, v double").agg(F.sum("v")).first()[0] == 12
    assert udf.map_tiles(df, ["k"], lambda p: p.head(1), "k string, v double").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from conftest import DATA

    from atlasframe.plans import fixtures as fx

    e = fx.events(spark, DATA)
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    q = streaming.running_total(stream).writeStream.format("memory").queryName("totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("totals").select("sample_id", "n").collect())) == sorted(map(tuple, streaming.running_total(e).select("sample_id", "n").collect()))
    for name, job in (("counts", streaming.detection_counts), ("slides", streaming.sliding_background), ("sessions", streaming.sample_sessions)):
        q = job(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        done = spark.table(name).drop("mean", "background", "relative")
        assert done.count() > 0 and done.exceptAll(job(e).drop("mean", "background", "relative")).count() == 0
    cells = fx.cells(spark, DATA).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    cells.write.parquet(str(tmp_path / "cells"))
    once = streaming.dedupe(spark.readStream.schema(cells.schema).parquet(str(tmp_path / "cells"))).writeStream.format("memory").queryName("once").start()
    once.processAllAvailable()
    once.stop()
    assert spark.table("once").count() == streaming.dedupe(cells).count()
    q = streaming.stream_planes(stream.select("event_id"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()


def test_planes_are_streamed_from_files(spark, tmp_path):
    raw = np.arange(5 * 4 * 6, dtype="<u2").reshape(5, 4, 6)
    (tmp_path / "in").mkdir()
    for z, plane in enumerate(raw):
        (tmp_path / "in" / f"chan1_{z + 1:03d}.raw").write_bytes(plane.tobytes())
    (tmp_path / "in" / "chan1_099.raw").write_bytes(b"half")
    stream = streaming.plane_files(spark, str(tmp_path / "in"), 4, 6, "S", per_batch=2)
    q = streaming.stream_planes(stream, tiles.preprocess_planes, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    (tmp_path / "all.raw").write_bytes(raw.tobytes())
    want = tiles.preprocess_planes(sources.read_raw_planes(spark, str(tmp_path / "all.raw"), 4, 6, "S")).orderBy("z").collect()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").orderBy("z").collect()
    assert len(got) == 5 and got == want


def test_components_query_equals_brute_force(spark):
    v = fx.voxels(spark, DATA).where("value > 700").toPandas()
    got = queries.QUERIES["w7_connected_components"](spark, DATA).toPandas()
    want = []
    for (sample, channel), g in v.groupby(["sample_id", "channel"]):
        left = {(y, x, z): w for y, x, z, w in g[["y", "x", "z", "value"]].itertuples(index=False)}
        while left:
            todo, part = [left.popitem()], []
            while todo:
                p = todo.pop()
                part.append(p)
                near = [q for q in left if max(abs(i - k) for i, k in zip(q, p[0])) <= 1]
                todo += [(q, left.pop(q)) for q in near]
            w = np.array([x for _, x in part])
            want.append((sample, channel, len(part), *np.round((np.array([p for p, _ in part]) * w[:, None]).sum(0) / w.sum(), 6)))
    assert sorted(want) == sorted((r.sample_id, r.channel, r.n, round(r.cy, 6), round(r.cx, 6), round(r.cz, 6)) for r in got.itertuples())


def test_point_jobs_equal_brute_force(spark):
    p = fx.points(spark, DATA).toPandas().sort_values("point_id")
    xyz = p[list("xyz")].to_numpy()
    off = xyz - xyz.mean(0)
    far = np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(xyz.T)), off)
    keep = p["point_id"].to_numpy()[np.lexsort((p["point_id"], -np.round(far, 9)))][: int(0.8 * len(p))]
    got = {r[0] for r in queries.QUERIES["k6_keep_by_distance"](spark, DATA).collect()}
    assert len(got ^ set(keep.tolist())) <= 2  # ties within rounding
    for r in queries.QUERIES["g26_fit_lines"](spark, DATA).collect():
        own = p[p["slice"] == r["probe_id"]][list("xyz")].to_numpy()
        v = np.linalg.svd(own - own.mean(0))[2][0]
        assert abs(abs(v @ [r["dx"], r["dy"], r["dz"]]) - 1) < 1e-6 and r["dy"] >= 0
    cells = fx.cells(spark, DATA).toPandas()
    m = cells.assign(row=np.floor(cells["y"]).astype(int)).pivot_table(index="row", columns="sample_id", values="intensity", aggfunc="sum").dropna()
    u, d, vt = np.linalg.svd(m.to_numpy())
    first = pd.Series(np.abs(u[:, 0]) / np.median(np.abs(u[:, 0])), m.index)
    got = {r["row"]: r["strength"] for r in queries.QUERIES["g33_projection_strength"](spark, DATA).collect()}
    assert got.keys() == set(first.index) and all(abs(got[k] - first[k]) < 1e-3 for k in got)


def test_slice_samples_are_the_strongest_gradients(spark):
    v = stencil.gradient_magnitude(fx.voxels(spark, DATA), [*queries.BY, "z"], ("y", "x")).toPandas()
    got = queries.QUERIES["d12_extract_points_slices"](spark, DATA).toPandas()
    sizes = got.groupby(["sample_id", "channel", "z"]).size()
    rows = set(got[["sample_id", "channel", "y", "x", "z"]].itertuples(index=False, name=None))
    for key, g in v.groupby(["sample_id", "channel", "z"]):
        strong = g[g["gradient"] > np.quantile(g["gradient"], 0.9)]
        own = set(strong[["sample_id", "channel", "y", "x", "z"]].itertuples(index=False, name=None))
        assert sizes.get(key, 0) == min(20, len(own)) == len(own & rows)


def test_tracing(spark):
    a = np.zeros((20, 20, 20))
    a[4:10] = 1
    a[12:16] = 2
    labels = _volume(spark, a).select("y", "x", "z", F.col("value").cast("int").alias("region_id"))
    terms = spark.createDataFrame([(1, "substructure", "one", "o", 1, 2, 3)], "region_id int, term_set string, name string, acronym string, red int, green int, blue int")
    marks = spark.createDataFrame([(7, 10.0, 10.0, float(z)) for z in (2, 9, 18)], "probe_id int, x double, y double, z double")
    got = align.trace_probes(marks, labels, terms, (20, 20, 20), 30).orderBy("run").toPandas()
    assert got["region_id"].tolist() == [1, 2] and got["substructure"].tolist() == ["one", "2"] and got["n"].tolist() == [60, 40] and got["d0"].iloc[0] == 0
    t = np.linspace(0, 2 * math.pi, 8, endpoint=False)
    ring = spark.createDataFrame([(1, float(10 + 3 * math.cos(v)), float(10 + 3 * math.sin(v)), 7.0) for v in t], "implant_id int, x double, y double, z double")
    under, profile = align.trace_implants(ring, labels, _volume(spark, a), (20, 20, 20), [0.0])
    assert under.first()["region_id"] == 1 and profile.first()["median"] == 1
    warped = lookup.warp_volume(_volume(spark, a), np.eye(4).tolist(), (20, 20, 20)).toPandas()
    assert warped["value"].sum() == a.sum()


def test_empty_inputs_keep_their_schema(spark, cloud):
    df, _ = cloud
    none = df.where("false")
    assert spatial.knn_join(none, df, 1, 5.0, "point_id", "point_id").count() == 0
    assert spatial.thin_points(none, 1.0).count() == 0 and spatial.cluster_points(none, 1.0).count() == 0
    assert tiles.detect_cells_3d(_volume(spark, np.zeros((2, 2, 2))).where("false")).columns == ["sample_id", "channel", "x", "y", "z", "intensity", "diameter", "elongation"]


def test_segment_join_takes_any_number_of_segments(spark):
    segments = spark.range(1500).selectExpr("concat('C', id) as segment", "cast(id as double) as start_z", "cast(id + 1 as double) as end_z")
    got = regions.segment_join(spark.range(1501).selectExpr("cast(id as double) as z"), segments).collect()
    assert sorted((r["z"], r["segment"]) for r in got) == sorted([(float(i), f"C{i}") for i in range(1500)] + [(1500.0, "C1499")])


def _mask(spark, present, by=("S", 1)):
    rows = [(*by, *map(int, p + 1), float(i)) for i, p in enumerate(np.argwhere(present))]
    return spark.createDataFrame(rows, "sample_id string, channel int, y int, x int, z int, value double")


@pytest.mark.parametrize("connectivity", [18, 26])
def test_components_of_tiles_equal_those_of_voxels(spark, connectivity):
    """Volumes with holes: noise, a shell with a hollow, a winding line over many tiles; two groups; tiles of 4, 7 and 64."""
    r = np.random.default_rng(11)
    noise = r.random((13, 11, 12)) < 0.16
    y, x, z = np.indices((13, 13, 13)) - 6
    shell = (np.abs(np.sqrt(y**2 + x**2 + z**2) - 5) < 0.8) & ~((y == 0) & (x > 0))
    line = np.zeros((13, 13, 13), bool)
    for k in range(13):
        line[k, :, 0 if k % 4 == 0 else 0] = k % 2 == 0
        line[k, 0 if k % 4 == 3 else 12, 0] = True
    mask = _mask(spark, noise).unionByName(_mask(spark, shell, ("S", 2))).unionByName(_mask(spark, line, ("T", 1)))
    want = {tuple(r)[:6]: tuple(r["component"]) for r in stencil.connected_components(mask, ["sample_id", "channel"], connectivity).collect()}
    for edge in (4, 64) if connectivity == 26 else (7,):
        got = blocks.connected_components(mask.repartition(5), ["sample_id", "channel"], connectivity, edge=edge)
        assert got.columns == [*mask.columns, "component"]
        assert {tuple(r)[:6]: tuple(r["component"]) for r in got.collect()} == want
    if connectivity == 18:
        return
    flat = mask.where("z = 1 and sample_id = 'T'").select("sample_id", "y", "x")
    plane = {tuple(r)[:3]: tuple(r["component"]) for r in stencil.connected_components(flat, ["sample_id"], 8, ("y", "x")).collect()}
    assert {tuple(r)[:3]: tuple(r["component"]) for r in blocks.connected_components(flat, ["sample_id"], 8, ("y", "x"), 3).collect()} == plane
    assert blocks.connected_components(mask.where("false"), ["sample_id", "channel"]).count() == 0


def test_only_faces_leave_their_tiles(spark):
    """A solid cube of 16^3 in tiles of 8: the voxels that meet others are the outer ones."""
    met = []
    def cut(df):
        out = df.checkpoint()
        met.append((out.columns, out.count()))
        return out
    solid = _mask(spark, np.ones((16, 16, 16), bool))
    found = blocks.connected_components(solid, ["sample_id", "channel"], edge=8, checkpoint=cut)
    assert found.select("component").distinct().count() == 1 and found.count() == 16**3
    faces = next(n for c, n in met if "_label" in c)
    assert faces == 8 * (8**3 - 6**3)
    assert max(n for c, n in met if c == ["a", "b"]) <= 2 * 8 * 7


def _same_rows(a, b):
    key = lambda df: {tuple(r[c] for c in ("sample_id", "channel", "y", "x", "z")): r["value"] for r in df.collect()}
    a, b = key(a), key(b)
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9) for k in a)
    return len(a)


@pytest.mark.parametrize("mode", ["linear", "nearest"])
@pytest.mark.parametrize("fill", [0.0, 7.0])
def test_warps_of_cubes_equal_those_of_voxels(spark, mode, fill):
    r = np.random.default_rng(4)
    v = _mask(spark, r.random((11, 9, 10)) < 0.6).unionByName(_mask(spark, r.random((11, 9, 10)) < 0.05, ("T", 2)))
    turn = [[0.9, 0.2, 0.0, 1.5], [-0.2, 0.8, 0.1, 2.25], [0.0, 0.0, 1.5, -3.0], [0, 0, 0, 1]]
    shrink = [[0.25, 0, 0, 0.5], [0, 0.3, 0, 0.25], [0, 0, 0.5, 1], [0, 0, 0, 1]]
    field = spark.createDataFrame([(i, j, k, (i * j % 5) / 4 - 0.5, (j + k) % 3 / 2, (i - k) % 4 / 3) for i in range(1, 10) for j in range(1, 8) for k in range(1, 11)], "i int, j int, k int, dx double, dy double, dz double")
    for edge, size in ((4, (11, 9, 10)), (64, (6, 12, 5))):
        cubes = blocks.volume(v, edge)
        for m in (turn, shrink) if edge == 4 else (turn,):
            n = _same_rows(lookup.warp_volume(v, m, size, mode, fill), blocks.warp(cubes, m, size, mode, fill).voxels())
            assert n > 0 and (fill == 0 or n == 2 * size[0] * size[1] * size[2])
        _same_rows(lookup.warp_volume_field(v, field, turn, size, mode, fill), blocks.warp(cubes, turn, size, mode, fill, field).voxels())
    assert _same_rows(v, blocks.volume(v, 4).voxels()) == v.count()
    assert blocks.warp(blocks.volume(v.where("false")), turn, (3, 3, 3)).voxels().count() == 0


def _thinned(ids, xyz, d):
    kept: list[int] = []
    for i in np.argsort(ids):
        if all(math.dist(xyz[i], xyz[k]) >= d for k in kept):
            kept.append(int(i))
    return sorted(int(ids[k]) for k in kept)


def test_thinning_by_tiles_equals_the_loop(spark):
    """Random order, a line in id order, a dense place; tiles of few points and one tile; two and three axes."""
    r = np.random.default_rng(8)
    cases = [(r.permutation(300), r.uniform(0, 30, (300, 3))), (np.arange(120), np.column_stack([np.arange(120) * 0.9, np.zeros(120), np.zeros(120)])), (r.permutation(200), np.concatenate([r.normal(0, 0.4, (150, 3)), r.uniform(-6, 6, (50, 3))]))]
    for n, (ids, xyz) in enumerate(cases):
        df = spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, xyz)], "point_id long, x double, y double, z double").repartition(4)
        want = _thinned(ids, xyz, 1.0)
        for most in (50_000, 40):
            rounds = []

            def cut(frame):
                rounds.append(1)
                return frame.checkpoint()

            got = sorted(x["point_id"] for x in spatial.thin_points(df, 1.0, checkpoint=cut, tile_points=most).collect())
            assert got == want
            assert most == 40 or len(rounds) == 2, (n, len(rounds))
    flat = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.5, 0.0), (3, 1.0, 0.0), (4, None, 1.0), (5, float("nan"), 0.0), (6, -0.0, 0.0)], "point_id int, x double, y double")
    assert sorted(x["point_id"] for x in spatial.thin_points(flat, 1.0, cols=("x", "y")).collect()) == [1, 1, 3, 4, 5]


def test_existence_joins_equal_pairs(spark):
    r = np.random.default_rng(9)
    make = lambda n, s: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(r.normal(0, s, (n, 3)))], "point_id long, x double, y double, z double")
    a, b = make(200, 5), make(150, 3)
    for d in (0.5, 2.0):
        want = {x[0] for x in spatial.pairs_within(a, b, d, "point_id", "point_id").collect()}
        assert {x[0] for x in spatial.any_within(a, b, d, "point_id").collect()} == want
    plan = spatial.any_within(a, b, 2.0, "point_id")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Cartesian" not in plan


def test_nearest_slice_beyond_the_ends(spark):
    atlas = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 10.0), ("c", None)], "g string, pos double")
    samples = spark.createDataFrame([(1, "a", -3.0), (2, "a", 1.0), (3, "a", 3.0), (4, "a", 3.1), (5, "a", 99.0), (6, "b", 3.0), (7, "b", 10.0), (8, "c", 1.0), (9, "d", 1.0), (10, "a", None), (11, "b", 11.0)], "k int, g string, pos double")
    got = {r["k"]: r["nearest"] for r in spatial.nearest_slice(samples, atlas, group="g").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 5.0, 5: 5.0, 6: 10.0, 7: 10.0, 8: None, 9: None, 10: None, 11: 10.0}
    plain = {r["k"]: r["nearest"] for r in spatial.nearest_slice(samples, atlas.select("pos")).collect()}
    assert plain == {1: 1.0, 2: 1.0, 3: 1.0, 4: 5.0, 5: 10.0, 6: 1.0, 7: 10.0, 8: 1.0, 9: 1.0, 10: None, 11: 10.0}


def test_table_quantiles_equal_numpy(spark):
    r = np.random.default_rng(2)
    values = np.concatenate([r.normal(0, 1e-3, 700), r.normal(5e6, 1, 200), np.full(400, 0.25), [-1e12, 1e12]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
    for most, bins in ((100_000, 4096), (3, 5)):
        for q in (0.0, 0.01, 0.31, 0.5, 0.777, 0.99, 1.0):
            assert math.isclose(quantiles.table_quantiles(df, "v", [q], most, bins)[0], np.quantile(values, q), rel_tol=1e-12, abs_tol=1e-15), (q, most)
    assert quantiles.table_quantiles(df.where("v > 1e13"), "v", [0.5, 0.1]) == [None, None]
    two = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert quantiles.table_quantiles(two, "v", [0.5], 1, 2) == [1.5]


def test_quantiles_of_cubes_equal_numpy(spark):
    a = np.random.default_rng(5).normal(size=(9, 8, 7)) * 10.0 ** np.random.default_rng(6).integers(-3, 4, (9, 8, 7))
    a[:3, 0, 0] = 0.0
    cubes = blocks.volume(_volume(spark, a.transpose(2, 0, 1)), 4).cubes
    for q in (0.0, 0.013, 0.5, 0.99, 1.0):
        assert math.isclose(blocks.cube_quantile(cubes, q), np.quantile(a, q), rel_tol=1e-12, abs_tol=1e-300)
    assert blocks.cube_quantile(cubes.where("false"), 0.5) is None


def test_filters_over_halo_cubes_equal_the_whole_volume(spark):
    """A filter that reaches no farther than the halo gives what it gives on the whole volume."""
    r = np.random.default_rng(7)
    a = r.uniform(1, 9, (10, 9, 11))  # y, x, z
    v = blocks.volume(_volume(spark, a.transpose(2, 0, 1)), 4, size=a.shape)
    box = lambda x: tiles._moving(x, 2, np.maximum)
    got = {(x["y"], x["x"], x["z"]): x["value"] for x in blocks.filtered(v, 2, box).voxels().collect()}
    assert len(got) == a.size and all(np.isclose(got[p[0] + 1, p[1] + 1, p[2] + 1], w) for p, w in np.ndenumerate(box(a)))
    with pytest.raises(ValueError, match="halo"):
        blocks.halo_cubes(v, 5)


def test_highpass_points_equal_brute_force(spark):
    r = np.random.default_rng(12)
    a = r.uniform(0, 1, (16, 14, 12))
    a[5:7, 5:7, 5:7] += 20
    a[0, 3, 3] += 40
    v = blocks.volume(_volume(spark, a.transpose(2, 0, 1)), 16, size=a.shape)
    band = tiles.bandpass(a, 6 * math.pi / 2, math.pi / 6)
    want = {(y + 1, x + 1, z + 1) for y, x, z in zip(*np.nonzero(band > np.quantile(band, 0.99) / 2)) if 0 < y < 15}
    got = points.extract_points_highpass(v, 1.0, share=1.0).collect()
    assert {(p["y"], p["x"], p["z"]) for p in got} == want and len(got) == len(want) > 8
    part = points.extract_points_highpass(v, 1.0, share=0.4).collect()
    assert 0 < len(part) < len(got) and {(p["y"], p["x"], p["z"]) for p in part} <= want
    assert points.extract_points_highpass(blocks.volume(_volume(spark, a[:2, :2, :2]).where("false"), 16, size=a.shape), 1.0).count() == 0


def _planes(spark, made):
    return spark.createDataFrame([("S", c, z, *p.shape, p.astype("<u2").tobytes()) for (c, z), p in made.items()], "sample_id string, channel int, z int, ny int, nx int, data binary").repartition(3)


def _section(shape, box, level, seed, dust=()):
    p = np.random.default_rng(seed).integers(8, 13, shape).astype(float)
    p[box[0] : box[1], box[2] : box[3]] += level
    for y, x in dust:
        p[y : y + 2, x : x + 2] += level
    return p


def test_section_stacks_share_one_crop(spark):
    """Channels of a section lie on each other; dust away from the tissue is no tissue; crops are centred and the shared margin goes."""
    made = {}
    for z, box in ((1, (20, 60, 30, 80)), (2, (25, 55, 20, 90))):
        made[1, z] = _section((100, 120), box, 200, z, [(5, 110)])
        second = np.full((100, 120), 10.0)
        second[box[0], box[2]] = 900  # a pixel of the second channel in the tissue's corner
        made[2, z] = second
    made[2, 2][0, 0] = 0
    stack = {(r["channel"], r["z"]): np.frombuffer(r["data"], "<u2").reshape(r["ny"], r["nx"]) for r in sections.build_slice_stack(_planes(spark, made), median=0, buffer=4, neighbours=20).collect()}
    assert {p.shape for p in stack.values()} == {(48, 78)} and len(stack) == 4
    for z, box in ((1, (20, 60, 30, 80)), (2, (25, 55, 20, 90))):
        y, x = (int(v[0]) for v in np.nonzero(stack[2, z] == 900))
        inside = stack[1, z] > 100
        ys, xs = np.nonzero(inside)
        assert (ys.min(), xs.min()) == (y, x) and (ys.max() - ys.min() + 1, xs.max() - xs.min() + 1) == (box[1] - box[0], box[3] - box[2])
        assert y == (48 - (box[1] - box[0])) // 2 and x == (78 - (box[3] - box[2])) // 2
    roomy = sections.build_slice_stack(_planes(spark, made), median=0, buffer=4, neighbours=20, size=(90, 100)).collect()
    assert {(r["ny"], r["nx"]) for r in roomy} == {(90 - (90 - 48) // 4 * 2, 100 - (100 - 78) // 4 * 2)}
    half = sections.build_slice_stack(_planes(spark, made), scale=0.5, median=1, buffer=2, neighbours=0).collect()
    assert {(r["ny"], r["nx"]) for r in half} == {(24, 39)}
    assert sections.build_slice_stack(_planes(spark, made).where("false")).count() == 0


def test_resize_is_the_mean_of_what_a_pixel_covers():
    a = np.random.default_rng(3).uniform(0, 9, (6, 8))
    assert np.allclose(sections.resize(a, 0.5), a.reshape(3, 2, 4, 2).mean((1, 3)))
    fine = np.repeat(np.repeat(a, 20, 0), 20, 1)  # 20 x 20 parts of each pixel
    assert np.allclose(sections.resize(a, 0.4)[:2, :3], fine[:100, :150].reshape(2, 50, 3, 50).mean((1, 3)))
    assert sections.resize(a, 0.4).shape == (3, 4) and np.allclose(sections.resize(a, 2.0)[::2, ::2], a) and sections.resize(a, 1.0) is a


def test_single_linkage_equals_brute_force():
    r = np.random.default_rng(4)
    for n, d, spread in ((150, 2.0, 20), (120, 5.0, 30), (200, 1.5, 8)):
        xy = r.integers(0, spread, (n, 2))
        near = ((xy[:, None] - xy[None]) ** 2).sum(2) < d * d
        label = np.arange(n)
        while (least := np.where(near, label[None], n).min(1)).tolist() != label.tolist():
            label = least
        assert sections.single_linkage(xy, d).tolist() == label.tolist()


def test_section_points(spark):
    made = {(1, 1): _section((60, 70), (20, 40, 25, 50), 300, 1, [(2, 2)]), (1, 2): np.zeros((10, 10))}
    got = sections.section_points(_planes(spark, made), border=3, neighbours=10).toPandas()
    assert set(got["z"]) == {1} and got["x"].between(26, 50).all() and got["y"].between(21, 40).all() and 300 < len(got) <= 500
    few = sections.section_points(_planes(spark, made), most=50, neighbours=5).toPandas()
    assert 30 < len(few) <= 50


def test_classes_are_balanced_by_hash(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 3 == 0, "b").alias("label"))
    got = stats.class_balance(df, "label", "k").toPandas()
    want = df.toPandas()
    assert got.groupby("label", dropna=False).size().tolist() == [300, 300, 300] and got["k"].is_unique
    h = {r["k"]: r["h"] for r in df.select("k", F.xxhash64("k", F.lit(1)).alias("h")).collect()}
    for label, rows in want.groupby("label", dropna=False):
        first = sorted(rows["k"], key=lambda k: (h[k], k))[:300]
        mine = got[got["label"].isna()] if pd.isna(label) else got[got["label"] == label]
        assert sorted(mine["k"]) == sorted(first)
    assert stats.class_balance(df.where("false"), "label", "k").count() == 0


def test_nearest_in_the_plane_equals_brute_force():
    r = np.random.default_rng(1)
    for q, p in ((r.normal(size=(300, 2)), r.normal(size=(200, 2)) * 3), (np.repeat(r.integers(0, 4, (50, 2)), 3, 0).astype(float), r.uniform(-50, 50, (40, 2))), (np.array([[1.0, 2.0]]), r.normal(size=(5, 2))), (np.column_stack([np.arange(90.0), np.zeros(90)]), r.uniform(0, 90, (60, 2)))):
        d, row = align.Nearest(q).query(p)
        all_d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
        assert np.allclose(d, all_d.min(1)) and (row == all_d.argmin(1)).all()


def _outline(n, seed, noise=0.0):
    """Noisy points of an outline without symmetry."""
    r = np.random.default_rng(seed)
    t = r.uniform(0, 2 * math.pi, n)
    rad = 20 + 5 * np.cos(t) + 3 * np.sin(2 * t) + 2 * np.cos(3 * t + 1)
    return np.column_stack([rad * np.cos(t) * 1.4, rad * np.sin(t)]) + r.normal(0, noise, (n, 2))


def test_slices_are_refined_from_disjoint_noisy_samples(spark):
    """A turn, a shift of several widths between points, and a stretch, from other points of the same outline."""
    a = 0.2
    turn = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    stretch = turn @ np.diag([1.1, 0.95])
    rows, atlas, want = [], [], {}
    for k, (m, shift) in enumerate(((turn, [30.0, -12.0]), (np.eye(2), [0.0, 0.0]), (stretch, [5.0, 3.0]))):
        p = _outline(900, 10 + k, 0.1)
        q = _outline(700, 20 + k, 0.1) @ m.T + shift
        rows += [(k, *map(float, x)) for x in p]
        atlas += [(k, *map(float, x)) for x in q]
        want[k] = (m, shift)
    rows += [(7, 1.0, 2.0)] * 30 + [(0, None, 1.0), (0, float("nan"), 1.0)]
    s, t = (spark.createDataFrame(x, "slice int, x double, y double").repartition(4) for x in (rows, atlas))
    for affine in (False, True):
        got = {r["slice"]: r for r in align.refine_per_slice(s, t, affine=affine).collect()}
        assert set(got) == {0, 1, 2}
        for k, (m, shift) in want.items():
            if k == 2 and not affine:
                continue
            own = np.array(got[k]["m"]).reshape(3, 3)
            probe = _outline(50, 99)
            off = np.abs(probe @ own[:2, :2].T + own[:2, 2] - (probe @ m.T + shift)).max()
            assert off < 0.7 and got[k]["error"] < 0.4 and got[k]["back"] < 0.4, (k, affine, off)
    assert got[2]["error"] < 0.4 < {r["slice"]: r for r in align.refine_per_slice(s, t).collect()}[2]["error"]
    few = align.refine_per_slice(s, t, most=200, most_atlas=150).first()
    assert few["n"] <= 200 and few["n_atlas"] <= 150


def test_offsets_are_found_by_residuals_both_ways(spark):
    """An atlas whose outline grows along z: each slice fits the slab it was cut from."""
    atlas = [(*map(float, p * (1 + z / 10)), float(z)) for z in range(8) for p in _outline(300, 40 + z, 0.05)]
    slices = [(f"s|{z}", float(z - 2), *map(float, p * (1 + z / 10))) for z in (3, 5) for p in _outline(400, 60 + z, 0.05)]
    at = spark.createDataFrame(atlas, "x double, y double, z double")
    sl = spark.createDataFrame(slices, "slice string, pos double, x double, y double")
    grid = align.offset_errors(sl, at, [0.0, 1.0, 2.0, 3.0], 0.5).collect()
    assert len(grid) == 8 and all(r["error"] >= 0 and r["back"] >= 0 for r in grid)
    got = {r["slice"]: r["offset"] for r in align.best_offset(sl, at, [0.0, 1.0, 2.0, 3.0], 0.5).collect()}
    assert got == {"s|3": 2.0, "s|5": 2.0}
    assert align.offset_errors(sl, at, [0.0], 0.5, least=301).count() == 0


def test_placed_slices_are_mapped_at_the_end(spark):
    v = spark.createDataFrame([(s, y, x, 10.0 * s + y) for s in (1, 2) for y in (1, 2, 3) for x in (1, 2)], "slice int, y int, x int, value double")
    at = spark.createDataFrame([(1, 2), (2, 5)], "slice int, position int")
    placed = {(r["z"], r["y"], r["x"]): r["value"] for r in align.place_slices(v, at).collect()}
    assert {z: placed[z, 1, 1] for z in range(2, 6)} == {2: 11.0, 3: 11.0, 4: 21.0, 5: 21.0}
    move = [[1.0, 0, 0, 1.0], [0, 1, 0, 0], [0, 0, 1, -1.0], [0, 0, 0, 1]]
    got = {(r["z"], r["y"], r["x"]): r["value"] for r in align.place_slices(v, at, move, (4, 2, 6)).collect()}
    assert got == {(z - 1, y + 1, x): w for (z, y, x), w in placed.items() if y + 1 <= 4}


def test_tracing_from_display_space(spark):
    """Points of a probe and an implant, taken back to the display by hand, are traced as in the atlas."""
    size = (60, 40, 50)  # y, x, z
    perm, shown, voxel, native, av = [2, -1, 3], (50, 60, 40), [2.0, 3.0, 4.0], (60, 50, 40), 1.0
    field = spark.createDataFrame([], "i int, j int, k int, dx double, dy double, dz double")
    matrix = [[1.0, 0, 0, 3.0], [0, 1.0, 0, -2.0], [0, 0, 2.0, 1.0], [0, 0, 0, 1]]
    place = align.Placement(shown, perm, 1.0, voxel, native, field, av, matrix, (2, 1, 0))
    r = np.random.default_rng(3)
    display = np.column_stack([r.uniform(1, n, 12) for n in shown])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(display)], "point_id int, x double, y double, z double")
    got = {q["point_id"]: (q["x"], q["y"], q["z"]) for q in place.to_atlas(df).collect()}
    for i, p in enumerate(display):
        back = [0.0] * 3
        for a, (c, n, k) in enumerate(zip(p, shown, perm)):
            back[abs(k) - 1] = n + 1 - c if k < 0 else c
        mm = [(c - 1) * v for c, v in zip(back, voxel)]
        reg = [((native[abs(k) - 1] - 1) * voxel[abs(k) - 1] - mm[abs(k) - 1] if k < 0 else mm[abs(k) - 1]) / 2 for k in perm]
        atlas = np.linalg.solve(np.array(matrix), [*reg, 1.0])[:3]
        assert np.allclose(got[i], [atlas[2], atlas[1], atlas[0]])
    probe = df.withColumn("probe_id", F.lit(1))
    labels = spark.range(size[0] * size[1] * size[2]).select((F.col("id") % 60 + 1).cast("int").alias("y"), (F.floor(F.col("id") / 60) % 40 + 1).cast("int").alias("x"), (F.floor(F.col("id") / 2400) + 1).cast("int").alias("z")).withColumn("region_id", (1 + F.floor(F.col("y") / 20) + F.floor(F.col("x") / 20)).cast("int"))
    terms = spark.createDataFrame([(k, "substructure", f"r{k}", f"a{k}", 1, 2, 3) for k in range(1, 6)], "region_id int, term_set string, name string, acronym string, red int, green int, blue int")
    line = np.column_stack([np.full(9, 20.0), np.linspace(5, 55, 9), np.full(9, 25.0)])
    on = spark.createDataFrame([(1, *map(float, p)) for p in line], "probe_id int, x double, y double, z double")
    runs = sorted((q["region_id"], q["acronym"]) for q in align.trace_probes(on, labels, terms, size, 60).collect())
    assert runs == [(2, "a2"), (3, "a3"), (4, "a4"), (5, "a5")]
    assert align.trace_probes(probe, labels, terms, size, 60, place).count() > 0
    ring = spark.createDataFrame([(1, *map(float, p)) for p in _side([0, 1, 0.02], 80, 30, 3, centre=(20.0, 25.0, 25.0))], "implant_id int, x double, y double, z double")
    voxels = labels.select(F.lit(1).alias("channel"), "y", "x", "z", F.col("y").cast("double").alias("value"))
    under, depth = align.trace_implants(ring, labels, voxels, size, [0.0, 5.0])
    # The bottom lies at y = 40: depth 0 and 5 are planes y = 40 and 45, give or take the fit.
    got = {q["depth"]: q["median"] for q in depth.collect()}
    assert abs(got[0.0] - 40) < 1.5 and abs(got[5.0] - 45) < 1.5
    assert {q["region_id"] for q in under.collect()} >= {4}


def test_views_from_cubes_equal_those_of_voxels(spark):
    r = np.random.default_rng(6)
    v = _mask(spark, r.random((9, 8, 10)) < 0.5).unionByName(_mask(spark, r.random((9, 8, 10)) < 0.03, ("T", 2)))
    rows = [(i, s, c, float(r.uniform(0.6, 9)), float(r.uniform(0.6, 8)), float(r.uniform(0.6, 10))) for i, (s, c) in enumerate([("S", 1)] * 25 + [("T", 2)] * 25 + [("U", 1)] * 2)] + [(90, "S", 1, None, 1.0, 1.0), (91, "S", 1, -30.0, 4.0, 4.0)]
    cells = spark.createDataFrame(rows, "cell_id int, sample_id string, channel int, y double, x double, z double")
    long = {(q["cell_id"], q["view"], q["u"], q["v"]): q["value"] for q in tiles.candidate_views(cells.where("y is not null"), v, 2).collect()}
    for edge in (4, 16):
        got = {}
        for q in blocks.candidate_views(cells.repartition(3), blocks.volume(v, edge, size=(9, 8, 10)), 2).collect():
            for view in ("yx", "zx", "zy"):
                for k, value in enumerate(q[f"view_{view}"]):
                    got[q["cell_id"], view, k // 5 - 2, k % 5 - 2] = value
        assert got == long


def test_rank_filters_of_cubes_equal_those_of_voxels(spark):
    v = _mask(spark, np.random.default_rng(3).random((9, 8, 7)) < 0.6)
    for r, rank, axes in ((1, 0.5, ("y", "x")), (2, 0.3, ("y", "x", "z"))):
        want = stencil.median_filter(v, r, [c for c in ("sample_id", "channel", "z") if c not in axes], axes, rank)
        _same_rows(want, blocks.rank_filter(blocks.volume(v, 4, size=(9, 8, 7)), r, rank, axes).voxels())


@pytest.mark.parametrize("per_batch", [1, 5])
def test_a_stream_of_planes_finds_the_cells_of_the_batch(spark, tmp_path, per_batch):
    """Planes in an order of their own, some twice, in batches that cut every cell."""
    r = np.random.default_rng(2)
    a = r.integers(90, 110, (14, 48, 52)).astype(float)
    z, y, x = np.indices(a.shape)
    for cz, cy, cx in ((4, 12, 12), (5, 30, 40), (9, 20, 25), (10, 38, 10)):
        a += 900 * np.exp(-((z - cz) ** 2 + (y - cy) ** 2 + (x - cx) ** 2) / 4)
    options = tiles.Detection(2.0, 0.5, 0.25, 5, 32)
    folder = tmp_path / "planes"
    folder.mkdir()
    for k in r.permutation(14):
        (folder / f"p_{k + 1:03d}.raw").write_bytes(a[k].astype("<u2").tobytes())
    for k in (3, 8):
        (folder / f"again_{k:03d}.raw").write_bytes(a[k - 1].astype("<u2").tobytes())
    (folder / "part_099.raw").write_bytes(b"short")
    planes = streaming.plane_files(spark, str(folder), 48, 52, "S", 1, per_batch)
    cells = streaming.stream_cells(planes, 14, options)
    out = str(tmp_path / "cells")
    cells.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    batch = spark.createDataFrame([("S", 1, k + 1, 48, 52, p.astype("<u2").tobytes()) for k, p in enumerate(a)], "sample_id string, channel int, z int, ny int, nx int, data binary")
    key = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in q) for q in df.collect())
    want = key(tiles.detect_cells_in_planes(batch, options))
    assert len(want) >= 4 and key(spark.read.parquet(out)) == want


def test_smooth_path_in_blocks_equals_dense_solve(spark):
    """Blocks of all remainders, a null key, unknown ends, a second value with too few known ones, rows out of order."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for key, n in (("a", 61), ("b", 5), ("c", 7), ("d", 2), (None, 23)):
        y = [None if rng.random() < 0.5 else float(rng.normal()) for _ in range(n)]
        y[1], y[-1] = 1.0, 2.0
        lone = [5.0 if i == 1 else float("nan") if i % 2 else None for i in range(n)]
        a, b = np.zeros((n, n)), np.zeros(n)
        for i, v in enumerate(y):
            if v is not None:
                a[i, i] += 1
                b[i] = v
        for i in range(n - 2):
            r = np.zeros(n)
            r[i : i + 3] = 1, -2, 1
            a += 3.0 * np.outer(r, r)
        solved = np.linalg.solve(a + 1e-9 * np.eye(n), b) if n > 2 else y
        want |= {(key, i): v for i, v in enumerate(solved)}
        rows += [(key, i, v, w, "kept") for i, (v, w) in enumerate(zip(y, lone))]
    rng.shuffle(rows)
    path = spark.createDataFrame(rows, "k string, i int, v double, w double, other string")
    for block in (5, 6, 7, 23, 100):
        got = series.smooth_path(path, "k", "i", ["v", "w"], 3.0, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            expected = want[r["k"], r["i"]]
            assert r["other"] == "kept" and (r["v"] is None if expected is None else abs(r["v"] - expected) < 1e-6)
            assert r["w"] == 5.0 if r["i"] == 1 else r["w"] is None or math.isnan(r["w"])
    assert series.smooth_path(path.where("false"), "k", "i", ["v"], 3.0).count() == 0
    with pytest.raises(ValueError):
        series.smooth_path(path, "k", "i", ["v"], 3.0, block=4)


def test_smooth_path_solves_runs_of_blocks(spark, monkeypatch):
    """Runs of one block, of a few and of all blocks give what one block gives; a task's group is a run, so there are few groups of small blocks."""
    rng = np.random.default_rng(6)
    rows = [(key, i, float(rng.normal()) if i % 3 == 1 else None) for key, n in (("a", 83), ("b", 40), (None, 21), ("c", 6)) for i in range(n)]
    path = spark.createDataFrame(rows, "k string, i int, v double")
    key = lambda df: {(r["k"], r["i"]): r["v"] for r in df.collect()}
    want = key(series.smooth_path(path, "k", "i", ["v"], 3.0, block=1000))
    for run in (4, 15, 20, 20_000):
        monkeypatch.setattr(series, "RUN_ROWS", run)
        found = series.smooth_path(path, "k", "i", ["v"], 3.0, block=5)
        got = key(found)
        assert got.keys() == want.keys() and all(abs(got[at] - v) < 1e-6 for at, v in want.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [keys for keys in re.findall(r"GroupsInPandas \[([^\]]*)\]", plan) if "_block" in keys]


def test_transform_files_are_written_by_many_tasks(spark, duck, tmp_path, monkeypatch):
    """A file for each supplier, in a folder a task and not a folder each; no supplier, no row."""
    from atlasframe.plans import jobs

    rows = [(i, i % 25) for i in range(400)]
    for name, kept in (("some", rows), ("none", [])):
        spark.createDataFrame(kept, "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / name / "supplier.parquet"))
    monkeypatch.setattr(jobs, "scratch", lambda s, name: f"file://{tmp_path}/{name}")
    got = jobs.s15_transforms_from_text(spark, str(tmp_path / "some")).toPandas()
    files = [f for f in (tmp_path / "transforms").rglob("*id=*") if f.is_file()]
    assert len(files) == 400 and 1 < len({f.parent for f in files}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = duck.cursor()
    own.sql(f"create temp view supplier as select * from '{tmp_path}/some/supplier.parquet/*.parquet'")
    same(got, own.sql(queries.ORACLES["s15_transforms_from_text"]).df())
    monkeypatch.setattr(jobs, "scratch", lambda s, name: f"file://{tmp_path}/empty-{name}")
    assert jobs.s15_transforms_from_text(spark, str(tmp_path / "none")).count() == 0


def test_exploded_transforms_split_each_text_once(spark, tmp_path):
    (tmp_path / "t.txt").write_text('(Transform "TranslationTransform")\n(TransformParameters 1 2 3)')
    got = sources.transforms_from_text(spark, str(tmp_path)).select("path", F.posexplode("m"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert [r["col"] for r in got.orderBy("pos").collect()] == [1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1]


def test_cord_edges_against_filters(spark):
    """Edges of tissue and white matter by 3 x 3 filters over padded planes; thinning keeps one of six or fewer."""
    rng = np.random.default_rng(6)
    planes = rng.integers(0, 4, (2, 14, 11)) * (rng.random((2, 14, 11)) < 0.5)
    planes[0, 3:11, 2:8] = 2
    planes[0, 5:9, 4:6] = 3
    rows = [(z, y + 1, x + 1, int(planes[z, y, x]) or (None if (y + x) % 2 else 0)) for z in range(2) for y in range(14) for x in range(11)]
    labels = spark.createDataFrame(rows, "z int, y int, x int, region_id int")
    tree = spark.createDataFrame([("Cuneate Fasciculus", "3, x,"), ("grey", "2"), ("lateral FUNICULUS", "9,3"), ("dorsal funiculus", None)], "name string, children string")
    white = points.white_matter_ids(tree)
    assert sorted(r[0] for r in white.collect()) == [3, 9]
    want = set()
    for z in range(2):
        for mask in (planes[z] == 3, planes[z] > 0):
            p = np.pad(mask.astype(int), 1, mode="edge")
            at = lambda i, k: p[i : i + 14, k : k + 11]  # noqa: B023, E731
            gx = at(0, 2) + 2 * at(1, 2) + at(2, 2) - at(0, 0) - 2 * at(1, 0) - at(2, 0)
            gy = at(2, 0) + 2 * at(2, 1) + at(2, 2) - at(0, 0) - 2 * at(0, 1) - at(0, 2)
            want |= {(z, int(y) + 1, int(x) + 1) for y, x in zip(*np.nonzero((gx != 0) | (gy != 0)))}
    every = points.cord_edge_points(labels, white, most=1)
    assert {tuple(r) for r in every.select("z", "y", "x").collect()} == want and every.count() == len(want)
    thin = [tuple(r) for r in points.cord_edge_points(labels, white).select("z", "y", "x").collect()]
    assert set(thin) <= want and len(set(thin)) == len(thin)
    for z in range(2):
        n = sum(w[0] == z for w in want)
        assert n / 6 <= sum(t[0] == z for t in thin) <= n / 3 + 1
    only = points.cord_edge_points(labels.where("false"), white)
    assert only.count() == 0 and only.columns == ["z", "y", "x"]


def test_disc_grid_is_never_the_side_that_is_broadcast(spark):
    flat = spark.createDataFrame([(c, 1, 1, 1, float(c)) for c in (1, 2)], "channel int, y int, x int, z int, value double").where("value > 0")
    axes = {"uy": 1.0, "ux": 0.0, "uz": 0.0, "vy": 0.0, "vx": 1.0, "vz": 0.0, "ny": 0.0, "nx": 0.0, "nz": 1.0}
    one = spark.createDataFrame([(7, 1.0, 1.0, 1.0, 1.0)], "implant_id int, cy double, cx double, cz double, radius double").withColumns({k: F.lit(v) for k, v in axes.items()})
    got = lookup.sample_disc_intensity(one, flat, (2, 2, 2), [0.0])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildLeft" not in plan and "Cartesian" not in plan
    values = {(r["channel"], r["g1"], r["g2"]): r["value"] for r in got.collect()}
    assert len(values) == 50 and values[2, 0.0, 0.0] == 2.0 and values[1, 2.0, 2.0] == 0.0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_are_linked_without_broadcasts_or_checkpoints(spark):
    mask = spark.createDataFrame([("a", 1, 1, i, 1.0) for i in range(9)], "sample_id string, y int, x int, z int, value double")
    got = stencil.connected_components(mask, ["sample_id"])
    assert "BroadcastHashJoin" not in _plan(got) and "ExistingRDD" not in _plan(got)
    assert got.select("component").distinct().count() == 1


def test_nearest_neighbours_meet_places_not_copies(spark, monkeypatch):
    met, plain = [], spatial.pairs_within
    monkeypatch.setattr(spatial, "pairs_within", lambda a, b, *rest: met.append((a.count(), b.count())) or plain(a, b, *rest))
    p = spark.range(400).select(F.col("id").alias("point_id"), (F.col("id") % 4).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    for same in (True, False):
        got = {(r["point_id"], r["rank"]): (r["_right"], r["distance"]) for r in spatial.knn_join(p, p, 102, 0.5, "point_id", "point_id", same=same).collect()}
        for i in (0, 5, 399):
            want = sorted((abs(i % 4 - j % 4), j) for j in range(400) if same or i != j)[:102]
            assert [got[i, r + 1] for r in range(102)] == [(j, d) for d, j in want] and (i, 103) not in got
    assert met[0] == (4, 4) and max(map(max, met)) <= 4
    pairs = spatial.pairs_within(p, p, 0.5, "point_id", "point_id")
    assert "BroadcastHashJoin" not in _plan(pairs)


def test_points_without_a_place_have_no_neighbour(spark):
    kind = "point_id long, x double, y double, z double"
    left = spark.createDataFrame([(1, math.nan, 0.1, 0.1), (2, 0.2, 0.1, 0.1), (3, None, 0.1, 0.1), (4, 9.0, 9.0, 9.0), (5, 0.2, 0.1, 0.1)], kind)
    right = spark.createDataFrame([(1, 0.1, 0.1, 0.1), (2, -0.0, 0.1, 0.1)], kind)
    assert sorted(r["point_id"] for r in spatial.any_within(left, right, 1.0, "point_id").collect()) == [2, 5]
    assert sorted(r["point_id"] for r in spatial.anti_join_within(left, right, 1.0).collect()) == [1, 3, 4]


def test_no_window_frame_runs_to_the_end(spark):
    t = spark.createDataFrame([(1, i, float(i) if i % 3 == 0 else None) for i in range(10)], "g int, p int, v double")
    a = spark.createDataFrame([(float(i),) for i in range(0, 20, 5)], "pos double")
    s = spark.createDataFrame([(i, i / 3) for i in range(60)], "i int, pos double")
    jobs = [series.fill_nearest(t, ["g"], "p", "v"), series.interpolate_slices(t, ["g"], "p", "v"), spatial.nearest_slice(s, a, blocks=3)]
    assert not any("unboundedfollowing" in _plan(j).lower() and "currentrow" in _plan(j).lower().split("unboundedfollowing")[0][-40:] for j in jobs)
    assert not any("currentrow$(), unboundedfollowing$()" in _plan(j).lower() or "1, unboundedfollowing$()" in _plan(j).lower() for j in jobs)
    assert [r["v"] for r in jobs[0].orderBy("p").collect()] == [0, 0, 3, 3, 3, 6, 6, 6, 9, 9]
    assert all(r["nearest"] == min((0, 5, 10, 15), key=lambda x: (abs(x - r["pos"]), x)) for r in jobs[2].collect())


def test_equal_names_meet_once_and_count_all_their_rows(spark):
    terms = spark.createDataFrame([(1, "Cortex"), (2, "Cortex"), (3, "Pons"), (3, "PONS, "), (4, "Tectum"), (4, "Cortex"), (5, "left pons 2"), (6, "gyrus gyrus")], "region_id int, name string")
    other = spark.createDataFrame([("big cortex", 7), ("pons", 1), ("pons", 1), ("gyrus", 4)], "ext_name string, ext_value int")
    got = regions.join_by_name_unique(terms, other)
    assert "NestedLoopJoin LeftOuter" not in _plan(got) and "Contains" not in _plan(got)
    want = {(1, "Cortex", 7), (2, "Cortex", 7), (3, "Pons", 1), (3, "PONS, ", 1), (4, "Tectum", 7), (4, "Cortex", 7), (5, "left pons 2", 1), (6, "gyrus gyrus", 4)}
    assert {tuple(r) for r in got.collect()} == want
    twice = regions.join_by_name_unique(terms, other.unionByName(spark.createDataFrame([("a cortex", 7)], other.schema)))
    assert {r["region_id"]: r["ext_value"] for r in twice.where("name = 'Cortex'").collect()} == {1: None, 2: None, 4: None}


def test_cells_of_one_voxel_share_their_views(spark):
    cells = spark.createDataFrame([(i, "a", 1, 1.0 + 0.1 * (i % 3), 2.0, 1.0) for i in range(60)] + [(60, "a", 1, 3.0, 2.0, 9.0)], "cell_id int, sample_id string, channel int, y double, x double, z double")
    voxels = spark.createDataFrame([("a", 1, y, x, z, float(y * 16 + x * 4 + z)) for y in (1, 2, 3) for x in (1, 2, 3) for z in (1, 2)], "sample_id string, channel int, y int, x int, z int, value double")
    rows = tiles.candidate_views(cells, voxels, 1)
    got = {(r["cell_id"], r["view"], r["u"], r["v"]): r["value"] for r in rows.collect()}
    value = lambda y, x, z: float(y * 16 + x * 4 + z) if min(y, x, z) >= 1 and y <= 3 and x <= 3 and z <= 2 else 0.0
    cubes = {r["cell_id"]: r for r in blocks.candidate_views(cells, blocks.volume(voxels, 4, size=(3, 3, 2)), 1).collect()}
    assert len(got) == 61 * 27 and len(cubes) == 61
    for i in (0, 31, 60):
        z = 9 if i == 60 else 1
        y = 3 if i == 60 else 1
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                assert got[i, "yx", a, b] == max(value(y + a, 2 + b, z + c) for c in (-1, 0, 1)) == cubes[i]["view_yx"][3 * a + b + 4]
                assert got[i, "zx", a, b] == max(value(y + c, 2 + b, z + a) for c in (-1, 0, 1)) == cubes[i]["view_zx"][3 * a + b + 4]
                assert got[i, "zy", a, b] == max(value(y + b, 2 + c, z + a) for c in (-1, 0, 1)) == cubes[i]["view_zy"][3 * a + b + 4]
    # The boxes are of voxels: no join carries the cells' keys together with their steps.
    assert all("cell_id" not in line for line in _plan(rows).split("\n") if "Generate explode" in line)


def test_highlighted_voxels_are_not_sorted_by_region(spark):
    labels = spark.range(50).select((F.col("id") % 3).cast("int").alias("region_id"))
    names = spark.createDataFrame([(0, "area", 1.0), (1, "Arc", 3.0), (2, "pons", 9.0)], "region_id int, name string, value double")
    got = clean.highlight_regions(labels, names.repartition(2).groupBy("region_id", "name").agg(F.sum("value").alias("value")), "a")
    assert "SortMergeJoin" not in _plan(got)
    assert {tuple(r) for r in got.distinct().collect()} == {(0, 1.0), (1, 255.0)}


def test_slices_of_many_copies_are_refined_by_all_their_places(spark):
    r = np.random.default_rng(5)
    places = r.uniform(0, 40, (3000, 2))
    pdf = pd.DataFrame(np.repeat(places, 3, 0), columns=["x", "y"]).assign(slice=1)
    p = spark.createDataFrame(pdf)
    got = align.refine_per_slice(p, p, most=500, most_atlas=400).first()
    assert (got["n"], got["n_atlas"]) == (400, 400) and max(got["error"], got["back"], got["uneven"]) < 1e-9
    flipped = align.flip_decision(p.withColumn("x", 41 - F.col("x")), p, 40).first()
    assert flipped["flipped"] and flipped["error"] < 1e-9


def _next_step(m, slab, section):
    """How far one more rigid step of all the slab's points, by brute force, would take them; m maps the section onto the slab."""
    at = slab @ (inv := np.linalg.inv(np.array(m).reshape(3, 3)))[:2, :2].T + inv[:2, 2]
    d = ((at[:, None] - section[None]) ** 2).sum(2)
    near, d = section[d.argmin(1)], np.sqrt(d.min(1))
    use = d <= np.quantile(d, 0.9)
    a, b = at[use] - at[use].mean(0), near[use] - near[use].mean(0)
    t = math.atan2((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum(), (a * b).sum())
    turned = (at - at[use].mean(0)) @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) + near[use].mean(0)
    return np.abs(turned - at).max()


def _corner(seed, scale=1.0):
    """2,400 places of a lattice without a corner, each a little off."""
    x, y = np.indices((60, 50)).reshape(2, -1)
    at = np.column_stack([x, y])[(x < 30) | (y < 30)]
    return at * scale + np.random.default_rng(seed).normal(0, 0.1, at.shape)


def test_best_offset_fits_all_places_of_a_slab(spark):
    """More places than 1,500: the map found must be at rest for all of the slab's points, not for some."""
    slab = {0: _corner(70, 1.3), 1: _corner(204)}  # a case in which the tolerance of the mean does not end the rounds before rest
    section = _corner(104) + [0.2, -0.1]
    atlas = spark.createDataFrame([(*map(float, p), float(z)) for z, c in slab.items() for p in c], "x double, y double, z double")
    slices = spark.createDataFrame([("s", 0.0, *map(float, p)) for p in section], "slice string, pos double, x double, y double")
    assert [r["n_atlas"] for r in align.offset_errors(slices, atlas, [0.0, 1.0], 0.4).collect()] == [2400, 2400]
    got = align.best_offset(slices, atlas, [0.0, 1.0], 0.4).first()
    assert got["offset"] == 1.0 and _next_step(got["m"], slab[1], section) < 1e-6


def test_flip_decision_fits_all_places_of_a_slice(spark):
    section, neighbour = _corner(90) + [20.2, 9.9], _corner(91) + [20.0, 10.0]
    frame = lambda a: spark.createDataFrame([(1, *map(float, p)) for p in a], "slice int, x double, y double")
    for p, flipped in ((section, False), (section * [-1, 1] + [101, 0], True)):
        got = align.flip_decision(frame(p), frame(neighbour), 100).first()
        assert got["flipped"] is flipped and _next_step(got["m"], neighbour, section) < 1e-6


def test_offset_of_equal_places_is_told_by_their_points(spark):
    rows = [(float(z), float(i % 7), float(i // 7)) for z in (0, 1) for i in range(49) for _ in range(1 + (i * 5 + z * 3) % 4)]
    atlas = spark.createDataFrame(rows, "z double, x double, y double")
    slices = atlas.where("z = 1").select(F.lit("s").alias("slice"), F.lit(0.0).alias("pos"), "x", "y")
    got = align.best_offset(slices, atlas, [0.0, 1.0], 0.4, 20).first()
    assert got["offset"] == 1.0 and got["error"] + got["back"] < 1e-9


def test_weighted_quantile_is_that_of_repeated_values():
    r = np.random.default_rng(2)
    for _ in range(50):
        v, n = r.normal(size=9), r.integers(1, 5, 9)
        assert abs(align._quantile(v, n.astype(float), 0.9) - np.quantile(np.repeat(v, n), 0.9)) < 1e-12
