"""Robust statistics, maps, moments, fits, samples and evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.quantiles import group_quantiles, table_quantiles

XYZ = ("x", "y", "z")


def midpoint_quantile(values: Column, p: float) -> Column:
    """Quantile of a sorted array with positions (i - 0.5) / n, linear between them."""
    n = F.size(values)
    at = F.least(F.greatest(n * F.lit(p) + 0.5, F.lit(1.0)), n.cast("double"))
    low = F.floor(at).cast("int")
    a, b = F.get(values, low - 1), F.get(values, F.least(low, n - 1))
    return a + (b - a) * (at - low)


def robust_stats(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """median, robust SD (1.4826 median absolute deviations), quantiles, smallest mode."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    most = counts.groupBy(*by).agg(F.min_by(F.col(value), F.struct(-F.col("_c"), F.col(value))).alias("mode"), F.sum("_c").alias("n"))
    first = group_quantiles(df, by, value, {"median": 0.5, "q01": 0.01, "q99": 0.99})
    off = df.join(first.select(*by, F.col("median").alias("_m")), list(by))
    dev = group_quantiles(off, by, F.abs(F.col(value) - F.col("_m")) * 1.4826, {"robust_sd": 0.5})
    return first.join(most, list(by)).join(dev, list(by))


def density_map(points: DataFrame, weights: DataFrame, nz: int, by: Sequence[str] = ()) -> DataFrame:
    """Weighted points per voxel over samples; the two halves are folded and averaged."""
    rows = points.join(weights, "sample_id").select(*by, *(F.round(F.col(c), 0).cast("int").alias(c) for c in "yxz"), "weight")
    rows = rows.withColumn("z", F.least(F.col("z"), nz + 1 - F.col("z")))
    return rows.groupBy(*by, "y", "x", "z").agg((F.sum("weight") / 2).alias("value"))


def density_variance(maps: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean and unbiased weighted variance per voxel of the samples' maps
    (sample_id, y, x, z, value); voxels a sample lacks count as 0; one sample: null."""
    total = weights.agg(F.sum("weight").alias("w"), F.sum(F.col("weight") ** 2).alias("ww")).first()
    w, ww = float(total["w"] or 0), float(total["ww"] or 0)
    s = maps.join(weights, "sample_id").groupBy("y", "x", "z").agg(F.sum(F.col("weight") * F.col("value")).alias("_s"), F.sum(F.col("weight") * F.col("value") ** 2).alias("_q"))
    room = w - ww / w if w else 0.0
    var = F.greatest((F.col("_q") - F.col("_s") ** 2 / w) / room, F.lit(0.0)) if room > 1e-12 else F.lit(None).cast("double")
    return s.select("y", "x", "z", (F.col("_s") / w).alias("mean"), var.alias("variance"))


def intensity_map(voxels: DataFrame, weights: DataFrame, box: Sequence[tuple[int, int]], by: Sequence[str] = ()) -> DataFrame:
    """Sum over samples (for each of by, such as a channel) of weight * (v - b) / b, b the
    median of positive values in the border box."""
    inside = voxels
    for c, (a, b) in zip("yxz", box):
        inside = inside.where(F.col(c).between(a, b))
    base = group_quantiles(inside.where("value > 0"), ["sample_id", *by], "value", {"_b": 0.5})
    rows = voxels.join(base, ["sample_id", *by]).join(weights, "sample_id")
    return rows.groupBy(*by, "y", "x", "z").agg(F.sum(F.col("weight") * (F.col("value") - F.col("_b")) / F.col("_b")).alias("value"))


def component_moments(labels: DataFrame, by: Sequence[str] = ("component",), value: str = "value") -> DataFrame:
    """Per component: voxels, mean, weighted centre and second central moments."""
    m = labels.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("_v"), *(F.sum(F.col(value) * F.col(c)).alias(f"_{c}") for c in XYZ), *(F.sum(F.col(value) * F.col(a) * F.col(b)).alias(f"_{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]))
    m = m.withColumns({f"c{c}": F.col(f"_{c}") / F.col("_v") for c in XYZ})
    second = {f"m{a}{b}": F.col(f"_{a}{b}") / F.col("_v") - F.col(f"c{a}") * F.col(f"c{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]}
    return m.withColumns(second).select(*by, "n", "mean", *(f"c{c}" for c in XYZ), *second)


def component_stats(labels: DataFrame, by: Sequence[str] = ("component",), value: str = "value") -> DataFrame:
    """component_moments with the equivalent diameter and the ratio of the longest
    to the shortest principal axis (its eigenvalues by a vectorised pandas function)."""

    @F.pandas_udf("double")
    def elongation(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.Series:
        m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2).astype(float)
        axes = np.sqrt(np.maximum(np.linalg.eigvalsh(m + np.eye(3) / 12), 1e-12))  # a voxel's own extent
        return pd.Series(axes[:, 2] / axes[:, 0])

    m = component_moments(labels, by, value)
    return m.select("*", F.cbrt(F.col("n") * 6 / np.pi).alias("diameter"), elongation("mxx", "myy", "mzz", "mxy", "mxz", "myz").alias("elongation")).drop(*(f"m{a}{b}" for i, a in enumerate(XYZ) for b in XYZ[i:]))


def max_projections(voxels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, view, u, v, value): the greatest value along each axis."""
    pick = lambda name, u, v: voxels.groupBy(*by, F.lit(name).alias("view"), F.col(u).alias("u"), F.col(v).alias("v")).agg(F.max("value").alias("value"))
    return pick("yx", "y", "x").unionByName(pick("zx", "z", "x")).unionByName(pick("zy", "z", "y"))


def otsu_threshold(voxels: DataFrame, by: Sequence[str], width: float, value: str = "value") -> DataFrame:
    """(by, threshold): the lower edge of the bin, of given width, from which on the variance between the two classes is greatest."""
    h = voxels.groupBy(*by, F.floor(F.col(value) / width).alias("_b")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    low = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_n0", F.sum("_n").over(low)).withColumn("_s0", F.sum(F.col("_n") * F.col("_b")).over(low)).withColumn("_t", F.sum("_n").over(w)).withColumn("_s", F.sum(F.col("_n") * F.col("_b")).over(w)).where("_n0 > 0")
    between = F.col("_n0") * (F.col("_t") - F.col("_n0")) * (F.col("_s0") / F.col("_n0") - (F.col("_s") - F.col("_s0")) / (F.col("_t") - F.col("_n0"))) ** 2
    return h.withColumn("_v", F.round(between, 6)).groupBy(*by).agg((F.min_by("_b", F.struct(-F.col("_v"), F.col("_b"))) * width).alias("threshold"))


def area_profile(mask: DataFrame, by: Sequence[str] = ("sample_id",), axis: str = "z") -> DataFrame:
    """Area of each slice and whether it is in the kept range: from the first to the
    last slice above median + 3 robust SD; no such slice keeps none."""
    area = mask.groupBy(*by, axis).agg(F.count("*").alias("area"))
    limits = robust_stats(area, by, "area").select(*by, (F.col("median") + 3 * F.col("robust_sd")).alias("_l"))
    rows = area.join(limits, list(by))
    big = rows.where("area > _l").groupBy(*by).agg(F.min(axis).alias("_a"), F.max(axis).alias("_b"))
    return rows.join(big, list(by), "left").withColumn("kept", F.coalesce(F.col(axis).between(F.col("_a"), F.col("_b")), F.lit(False))).drop("_l", "_a", "_b")


def orientation(area: DataFrame, by: Sequence[str] = ("sample_id",), axis: str = "z", share: float = 0.05) -> DataFrame:
    """Whether the mean area of the first share of slices exceeds that of the last."""
    ends = area.groupBy(*by).agg(F.min(axis).alias("_a"), F.max(axis).alias("_b"))
    rows = area.join(ends, list(by)).withColumn("_w", F.greatest(F.floor((F.col("_b") - F.col("_a") + 1) * share), F.lit(1)))
    head, tail = F.avg(F.when(F.col(axis) < F.col("_a") + F.col("_w"), F.col("area"))), F.avg(F.when(F.col(axis) > F.col("_b") - F.col("_w"), F.col("area")))
    return rows.groupBy(*by).agg((head > tail).alias("head_first"))


def bounding_box(mask: DataFrame, by: Sequence[str], pad: int = 1, size: Sequence[int] | None = None) -> DataFrame:
    out = mask.groupBy(*by).agg(*(f(c).alias(f"{c}{n}") for c in "yxz" for n, f in (("0", F.min), ("1", F.max))))
    low = {f"{c}0": F.greatest(F.col(f"{c}0") - pad, F.lit(1)) for c in "yxz"}
    high = {f"{c}1": F.least(F.col(f"{c}1") + pad, F.lit(n)) if n else F.col(f"{c}1") + pad for c, n in zip("yxz", size or (None,) * 3)}
    return out.withColumns(low | high)


def cluster_size_filter(clusters: DataFrame, share: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Points of clusters that hold more than the share of all points."""
    n = clusters.groupBy(*by, "component").agg(F.count("*").alias("_n"))
    total = n.groupBy(*by).agg(F.sum("_n").alias("_t"))
    big = (n.join(total, list(by)) if by else n.join(F.broadcast(total), F.lit(True))).where(F.col("_n") > share * F.col("_t"))
    return clusters.join(big.select(*by, "component"), [*by, "component"], "left_semi")


def scan_pair_qc(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, median intensity and diameter, half of the central 95 % range."""
    bright = group_quantiles(cells, by, "intensity", {"median_intensity": 0.5, "_a": 0.025, "_b": 0.975})
    wide = group_quantiles(cells, by, "diameter", {"median_diameter": 0.5})
    n = cells.groupBy(*by).agg(F.count("*").alias("n")).join(bright, list(by), "left").join(wide, list(by), "left")
    return n.withColumn("half_range", (F.col("_b") - F.col("_a")) / 2).drop("_a", "_b")


def dynamic_range(voxels: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    q = group_quantiles(voxels, by, value, {"_a": 0.001, "_b": 0.999})
    return q.select(*by, (F.col("_b") - F.col("_a")).alias("range"))


def pair_moments(pairs: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Sums that any linear fit of pairs (x, y, z) -> (u, v, w) needs, rows weighted where a column is named."""
    ones = [*XYZ, "1"]
    at = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    w = F.col(weight) if weight else F.lit(1.0)
    left = [F.sum(w * at(a) * at(b)).alias(f"{a}{b}") for i, a in enumerate(ones) for b in ones[i:]]
    right = [F.sum(w * at(a) * F.col(b)).alias(f"{a}{b}") for a in ones for b in "uvw"]
    return pairs.groupBy(*by).agg(*left, *right, F.sum(w * (F.col("u") ** 2 + F.col("v") ** 2 + F.col("w") ** 2)).alias("tt"))


def fit_affine(pairs: DataFrame, weight: str | None = None) -> np.ndarray:
    """4 x 4 least-squares affine, rows weighted where a column is named; only the sums reach the driver."""
    m = pair_moments(pairs, weight=weight).first()
    ones = [*XYZ, "1"]
    a = np.array([[m[f"{min(i, j, key=ones.index)}{max(i, j, key=ones.index)}"] for j in ones] for i in ones])
    b = np.array([[m[f"{i}{j}"] for j in "uvw"] for i in ones])
    out = np.eye(4)
    out[:3] = np.linalg.lstsq(a, b, rcond=None)[0].T
    return out


def fit_similarity(pairs: DataFrame, scale: bool = True, weight: str | None = None) -> np.ndarray:
    """4 x 4 similarity (or, without scale, rigid) transform by centred covariances,
    reflections excluded; only the sums reach the driver."""
    w = F.col(weight) if weight else F.lit(1.0)
    s = pairs.agg(F.sum(w).alias("n"), *(F.sum(w * F.col(c)).alias(c) for c in "xyzuvw"), *(F.sum(w * F.col(a) * F.col(b)).alias(a + b) for a in "xyz" for b in "uvw"), F.sum(w * (F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("q")).first()
    n = s["n"]
    p, t = np.array([s[c] / n for c in "xyz"]), np.array([s[c] / n for c in "uvw"])
    cov = np.array([[s[a + b] / n for b in "uvw"] for a in "xyz"]) - np.outer(p, t)
    u, d, vt = np.linalg.svd(cov)
    turn = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    r = vt.T @ turn @ u.T
    k = float((d * np.diag(turn)).sum() / (s["q"] / n - p @ p)) if scale else 1.0
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = k * r, t - k * r @ p
    return out


def fit_rigid(pairs: DataFrame, weight: str | None = None) -> np.ndarray:
    return fit_similarity(pairs, False, weight)


def transform_mse(pairs: DataFrame, matrix: np.ndarray) -> DataFrame:
    m = np.asarray(matrix, float)
    moved = [sum((F.col(c) * float(m[i, k]) for k, c in enumerate(XYZ)), F.lit(float(m[i, 3]))) for i in range(3)]
    return pairs.agg(F.avg(sum(((a - F.col(b)) ** 2 for a, b in zip(moved, "uvw")), F.lit(0.0))).alias("mse"))


def fit_lines(points: DataFrame, by: str = "probe_id") -> DataFrame:
    """Centre and first principal direction of each probe's points, pointing to
    larger y; two points at least. Moments are summed by Spark, so no probe's
    points meet in one task; 3 x 3 eigenvectors come from a pandas function."""
    m = points.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"o{c}") for c in XYZ), *(F.covar_pop(a, b).alias(f"m{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:])).where("n >= 2")

    def direction(batches):
        for b in batches:
            mat = np.zeros((len(b), 3, 3))
            for i, a in enumerate(XYZ):
                for k, c in enumerate(XYZ):
                    mat[:, i, k] = b[f"m{min(a, c)}{max(a, c)}"]
            v = np.linalg.eigh(mat)[1][:, :, 2]
            v *= np.where(v[:, 1] < 0, -1, 1)[:, None]
            yield b[[by, "n", "ox", "oy", "oz"]].assign(dx=v[:, 0], dy=v[:, 1], dz=v[:, 2])

    kind = points.schema[by].dataType.simpleString()
    return m.mapInPandas(direction, f"{by} {kind}, n long, ox double, oy double, oz double, dx double, dy double, dz double")


def _axes_and_centres(moments: DataFrame, by: str) -> DataFrame:
    """(by, n, o*, a*, p*, q*): centre, direction of greatest spread and two unit
    vectors across it, from each group's moments (n, o*, m**)."""

    def frame(batches):
        for b in batches:
            mat = np.array([[b[f"m{min(i, k)}{max(i, k)}"] for k in XYZ] for i in XYZ]).transpose(2, 0, 1)
            axis = np.linalg.eigh(mat)[1][:, :, 2]
            helper = np.where(np.abs(axis[:, :1]) > 0.9, [[0.0, 1.0, 0.0]], [[1.0, 0.0, 0.0]])
            p = np.cross(axis, helper)
            p /= np.linalg.norm(p, axis=1, keepdims=True)
            sides = {"a": axis, "p": p, "q": np.cross(axis, p)}
            yield b[[by, "n", *(f"o{c}" for c in XYZ)]].assign(**{n + c: v[:, i] for n, v in sides.items() for i, c in enumerate(XYZ)})

    kind = moments.schema[by].dataType.simpleString()
    return moments.mapInPandas(frame, f"`{by}` {kind}, n long, " + ", ".join(f"{n}{c} double" for n in "oapq" for c in XYZ))


def fit_cylinders(points: DataFrame, by: str = "implant_id", radius: float = 0.0) -> DataFrame:
    """(by, n, cx, cy, cz, nx, ny, nz, radius): the cylinder on whose side each
    implant's points lie; four points at least, others have no row.

    The axis is the direction of greatest spread; across it a circle is fitted by
    least squares. The axis points to where the points beyond its 95 % quantile have
    a median y not less than the mean (deeper), and the centre is moved along it to
    the 99 % quantile of the points' depth, the implant's bottom. Where points are in
    line across the axis the circle has no answer: the centre stays on the mean and
    the radius is `radius`, the expected one. Rows with a null or NaN coordinate are
    left out. Everything is grouped sums and quantiles over counted values; what
    Python sees is one row of moments for each implant.
    """
    points = points.select(by, *(F.col(c).cast("double").alias(c) for c in XYZ))
    for c in XYZ:
        points = points.where(F.col(c) - F.col(c) == 0)
    moments = points.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"o{c}") for c in XYZ), *(F.covar_pop(a, b).alias(f"m{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:])).where("n >= 4")
    frames = _axes_and_centres(moments, by)
    along = lambda n: sum(((F.col(c) - F.col(f"o{c}")) * F.col(f"{n}{c}") for c in XYZ), F.lit(0.0))
    flat = points.join(frames, by).select(by, "y", "oy", along("a").alias("t"), along("p").alias("g"), along("q").alias("h"))
    sq = F.col("g") ** 2 + F.col("h") ** 2
    sums = flat.groupBy(by).agg(F.avg(F.col("g") ** 2).alias("gg"), F.avg(F.col("g") * F.col("h")).alias("gh"), F.avg(F.col("h") ** 2).alias("hh"), F.avg(F.col("g") * sq).alias("gs"), F.avg(F.col("h") * sq).alias("hs"), F.avg(F.col("t") ** 2).alias("tt"))
    # The sums of g and h are zero, so the normal equations are two by two.
    det = F.col("gg") * F.col("hh") - F.col("gh") ** 2
    flatness = det <= 1e-12 * F.greatest(F.col("gg") + F.col("hh"), F.col("tt") * 1e-12) ** 2
    circle = sums.select(
        by, F.when(flatness, 0.0).otherwise((F.col("hh") * F.col("gs") - F.col("gh") * F.col("hs")) / (2 * det)).alias("_g"), F.when(flatness, 0.0).otherwise((F.col("gg") * F.col("hs") - F.col("gh") * F.col("gs")) / (2 * det)).alias("_h"), flatness.alias("_flat"), (F.col("gg") + F.col("hh")).alias("_s")
    )
    depth = group_quantiles(flat, [by], "t", {"_low": 0.01, "_end": 0.95, "_high": 0.99})
    far = group_quantiles(flat.join(depth.select(by, "_end"), by).where("t > _end"), [by], F.col("y") - F.col("oy"), {"_dy": 0.5})
    found = frames.join(circle, by).join(depth, by).join(far, by, "left")
    sign = F.when(F.col("_dy") < 0, -1.0).otherwise(1.0)
    bottom = F.when(F.col("_dy") < 0, F.col("_low")).otherwise(F.col("_high"))
    centre = [(F.col(f"o{c}") + F.col("_g") * F.col(f"p{c}") + F.col("_h") * F.col(f"q{c}") + bottom * F.col(f"a{c}")).alias(f"c{c}") for c in XYZ]
    size = F.when(F.col("_flat"), F.lit(float(radius))).otherwise(F.sqrt(F.col("_s") + F.col("_g") ** 2 + F.col("_h") ** 2))
    return found.select(by, "n", *centre, *((sign * F.col(f"a{c}")).alias(f"n{c}") for c in XYZ), size.alias("radius"))


def depth_profile(pixels: DataFrame) -> DataFrame:
    """Median intensity inside the circle per implant, depth and channel."""
    return group_quantiles(pixels.where("g1 * g1 + g2 * g2 <= radius * radius"), ["implant_id", "depth", "channel"], "value", {"median": 0.5})


def retention_report(points: DataFrame, by: Sequence[str], flag: str = "kept") -> DataFrame:
    """Rows and share kept per group, and overall (nulls in the keys)."""
    return points.rollup(*by).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("share"))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def sample_fraction(df: DataFrame, share: float, key: str, seed: int = 1) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def sample_per_group(df: DataFrame, n: int, by: Sequence[str], key: str, seed: int = 1) -> DataFrame:
    """At most n rows of each group. Groups are cut to n per hash bucket first, so
    that a large one is not ranked by one task."""
    h = F.xxhash64(key, F.lit(seed))
    rows = df.withColumn("_h", h).withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(64)))
    part = Window.partitionBy(*by, "_b").orderBy("_h", key)
    whole = Window.partitionBy(*by).orderBy("_h", key)
    rows = rows.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
    return rows.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= n).drop("_h", "_b", "_r")


def class_balance(df: DataFrame, label: str, key: str, seed: int = 1) -> DataFrame:
    """As many rows of each class as the smallest has, by hash. Rows are counted by the
    first 16 bits of their hash; what lies below the part where a class has enough is
    taken as it is, and only that part, a 65,536th of the class or so, is ranked."""
    h = F.xxhash64(key, F.lit(seed))
    rows = df.withColumns({"_h": h, "_b": F.shiftright(h, 48)})
    sizes = rows.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    least = sizes.groupBy(label).agg(F.sum("_c").alias("n")).agg(F.min("n")).first()[0] or 0
    upto = F.sum("_c").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    edge = sizes.withColumn("_before", F.coalesce(upto, F.lit(0))).where((F.col("_before") < least) & (F.col("_before") + F.col("_c") >= least)).select(F.col(label).alias("_label"), F.col("_b").alias("_edge"), "_before")
    met = rows.join(edge, F.col(label).eqNullSafe(F.col("_label")))
    sure = met.where("_b < _edge")
    place = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    last = met.where("_b = _edge").withColumn("_r", place).where(F.col("_r") + F.col("_before") <= least).drop("_r")
    return sure.unionByName(last).select(*df.columns)


def cap_per_class(df: DataFrame, n: int, label: str, key: str, seed: int = 1) -> DataFrame:
    """At most n rows of each class, by hash."""
    return sample_per_group(df, n, [label], key, seed)


def deepest_point(points: DataFrame, by: Sequence[str], depth: str = "y", key: str = "point_id") -> DataFrame:
    """The row of each group with the greatest depth, the largest key of ties."""
    row = F.struct(*points.columns)
    return points.groupBy(*by).agg(F.max_by(row, F.struct(depth, key)).alias("_row")).select("_row.*")


def hash_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 1) -> DataFrame:
    """Adds training: true for the share of rows."""
    return df.withColumn("training", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def accuracy(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, predicted).agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"), F.count_if(F.col(label) != F.col(predicted)).alias("mismatches"))


def projection_strength(matrix: DataFrame, row: str, sample: str = "sample_id", value: str = "value", rounds: int = 20) -> DataFrame:
    """Rank-1 factor over rows that are positive in all samples: alternating updates,
    each two grouped sums; (row, strength) scaled to a median of 1. Samples are few
    and their factors (one number each) pass through the driver."""
    samples = [r[0] for r in matrix.select(sample).distinct().collect()]
    good = matrix.groupBy(row).agg(F.count_if(F.col(value) > 0).alias("_n")).where(F.col("_n") == len(samples)).select(row)
    m = matrix.select(row, sample, value).join(good, row, "left_semi").checkpoint()  # read twice a round
    factor = dict.fromkeys(samples, 1.0)
    for _ in range(rounds):
        f = F.element_at(F.create_map(*(F.lit(x) for k in factor.items() for x in k)), F.col(sample))
        norm = sum(v * v for v in factor.values())
        strength = m.groupBy(row).agg((F.sum(F.col(value) * f) / norm).alias("strength"))
        back = m.join(strength, row).groupBy(sample).agg((F.sum(F.col(value) * F.col("strength")) / F.sum(F.col("strength") ** 2)).alias("f"))
        new = {r[0]: r[1] for r in back.collect()}
        if not new or max(abs(new[k] - factor[k]) for k in new) < 1e-9 * max(map(abs, new.values())):
            break
        factor = new
    (middle,) = table_quantiles(strength, "strength", [0.5])
    return strength.select(row, (F.col("strength") / middle).alias("strength"))


def poisson_cross_validated(df: DataFrame, features: Sequence[str], count: str, fold: str) -> DataFrame:
    """(fold, n, log_likelihood, r2): a Poisson regression fitted on all other folds, judged on each."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol=count, predictionCol="_p", regParam=1e-6)
    out = None
    for (k,) in sorted(df.select(fold).distinct().collect()):
        held = glm.fit(rows.where(F.col(fold) != k)).transform(rows.where(F.col(fold) == k))
        out = held if out is None else out.unionByName(held)
    ll = F.col(count) * F.log("_p") - F.col("_p") - F.expr(f"aggregate(sequence(1, greatest(cast({count} as int), 1)), 0D, (a, i) -> a + ln(i))")
    stats = out.groupBy(fold).agg(F.count("*").alias("n"), F.sum(ll).alias("log_likelihood"), F.sum((F.col(count) - F.col("_p")) ** 2).alias("_e"), (F.var_pop(count) * F.count("*")).alias("_t"))
    return stats.select(fold, "n", "log_likelihood", F.when(F.col("_t") > 0, 1 - F.col("_e") / F.col("_t")).alias("r2"))
