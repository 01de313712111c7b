"""Jobs on stacks of sections: point clouds of bright tissue, crops to the tissue and
centred stacks. A plane of one section and channel is a row; what joins sections is
their limits, four numbers each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.operators.tiles import rank_background

KEYS = ("sample_id", "channel", "z")
_PLANE = "sample_id string, channel int, z int, ny int, nx int, data binary"


def resize(plane: np.ndarray, scale: float) -> np.ndarray:
    """The plane on ceil(scale * size) pixels. Each output pixel is the mean over the
    stretch of input that it covers, parts of pixels by their share; where scale is
    above 1, the nearest parts of pixels. So nothing finer than an output pixel folds back."""
    for axis in (0, 1):
        n = plane.shape[axis]
        m = int(np.ceil(scale * n - 1e-9))
        if m == n or not n:
            continue
        edges = np.minimum(np.arange(m + 1) / scale, n)
        edges[-1] = n
        # Integral of the line up to each edge, whole pixels and the part of the next one.
        total = np.concatenate([np.zeros_like(plane.take([0], axis), dtype=float), np.cumsum(plane, axis, dtype=float)], axis)
        low = np.minimum(edges.astype(int), n - 1)
        part = (edges - low).reshape([-1 if k == axis else 1 for k in (0, 1)])
        upto = total.take(low, axis) + part * plane.take(low, axis)
        size = np.diff(edges).reshape([-1 if k == axis else 1 for k in (0, 1)])
        plane = np.diff(upto, axis=axis) / size
    return plane


def floor_level(plane: np.ndarray) -> float:
    """1 % quantile of the positive pixels, 0 without any."""
    lit = plane[plane > 0]
    return float(np.quantile(lit, 0.01)) if lit.size else 0.0


def relative(plane: np.ndarray) -> np.ndarray:
    """(v - floor) / floor, 0 below and where the floor is 0."""
    level = floor_level(plane)
    return np.maximum((plane - level) / level, 0) if level > 0 else np.zeros(plane.shape)


def _hash_order(xy: np.ndarray, seed: int) -> np.ndarray:
    """A fixed random order of pixels, the same however planes are dealt."""
    h = xy[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (xy[:, 1].astype(np.uint64) + np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return np.argsort(h * np.uint64(0xBF58476D1CE4E5B9), kind="stable")


def without_outliers(xy: np.ndarray, neighbours: int) -> np.ndarray:
    """Points whose mean distance to their nearest `neighbours` others is at most a deviation above the mean of all."""
    k = min(neighbours, len(xy) - 1)
    if k < 1:
        return xy
    p = xy.astype(np.float32)
    sq = (p * p).sum(1)
    mean = np.empty(len(p))
    for i in range(0, len(p), 256):
        d = np.maximum(sq[i : i + 256, None] + sq[None] - 2 * p[i : i + 256] @ p.T, 0)
        mean[i : i + 256] = np.sqrt(np.partition(d, k, axis=1)[:, : k + 1]).sum(1) / k  # the point itself adds 0
    return xy[mean <= mean.mean() + mean.std()]


def bright_points(plane: np.ndarray, border: int = 0, most: int = 20_000, neighbours: int = 100, least: float = 0.5, seed: int = 1) -> np.ndarray:
    """(n, 2) x, y (from 1) of a section's tissue: pixels whose relative value is above
    a quarter of the 99 % quantile in the middle half of the plane, and above `least`;
    at least `border` pixels from the edge, at most `most` of them, without outliers."""
    rel = relative(plane)
    ny, nx = plane.shape
    middle = rel[int(ny * 0.25) : max(1, int(np.ceil(ny * 0.75))), int(nx * 0.25) : max(1, int(np.ceil(nx * 0.75)))]
    if not middle.size:
        return np.zeros((0, 2), int)
    y, x = np.nonzero(rel > max(least, np.quantile(middle, 0.99) / 4))
    xy = np.column_stack([x, y]) + 1
    xy = xy[(xy[:, 0] >= border) & (xy[:, 0] <= nx - border) & (xy[:, 1] >= border) & (xy[:, 1] <= ny - border)]
    xy = xy[np.sort(_hash_order(xy, seed)[:most])]
    return without_outliers(xy, neighbours)


def single_linkage(xy: np.ndarray, d: float) -> np.ndarray:
    """Cluster numbers of points (the smallest row of each): points closer than d are
    linked. Those of one cell narrower than d / sqrt(2) are; pairs of cells are
    compared while they are not linked yet, some of their points first."""
    if not len(xy):
        return np.zeros(0, int)
    cell = np.floor(xy / (d / np.sqrt(2) * (1 - 1e-9))).astype(np.int64)
    names, of = np.unique(cell, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    parts = np.split(order, np.cumsum(np.bincount(of))[:-1])
    index = {tuple(c): i for i, c in enumerate(names.tolist())}
    up = list(range(len(names)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def close(a: np.ndarray, b: np.ndarray) -> bool:
        return any((((xy[a[i : i + 256], None] - xy[None, b]) ** 2).sum(2) < d * d).any() for i in range(0, len(a), 256))

    for dy, dx in sorted(((i, k) for i in range(-2, 3) for k in range(-2, 3) if (i, k) > (0, 0)), key=lambda s: s[0] ** 2 + s[1] ** 2):
        for c, i in index.items():
            k = index.get((c[0] + dy, c[1] + dx))
            if k is not None and (a := root(i)) != (b := root(k)) and (close(parts[i][:40], parts[k][:40]) or close(parts[i], parts[k])):
                up[max(a, b)] = min(a, b)
    group = np.array([root(i) for i in range(len(names))])[of]
    first = np.full(len(names), len(xy))
    np.minimum.at(first, group, np.arange(len(xy)))
    return first[group]


def tissue_limits(xy: np.ndarray, shape: Sequence[int], buffer: int, share: float = 0.1) -> tuple[int, int, int, int]:
    """(y0, y1, x0, x1), from 1, both ends included: the box round the clusters (links
    shorter than buffer / 2) that hold more than `share` of the points, `buffer`
    wider on each side, clipped; the whole plane without points."""
    ny, nx = shape
    if not len(xy):
        return 1, ny, 1, nx
    names, inverse, size = np.unique(single_linkage(xy, max(buffer / 2, 1.5)), return_inverse=True, return_counts=True)
    kept = xy[(size > share * len(xy))[inverse.ravel()]]
    kept = kept if len(kept) else xy
    (x0, y0), (x1, y1) = kept.min(0), kept.max(0)
    return max(1, int(y0) - buffer), min(ny, int(y1) + buffer), max(1, int(x0) - buffer), min(nx, int(x1) + buffer)


def _prepared(row, scale: float, median: int) -> np.ndarray:
    plane = np.frombuffer(row.data, "<u2").reshape(row.ny, row.nx).astype(float)
    if median:
        plane = rank_background(plane, median)
    plane = np.round(resize(plane, scale))
    return np.where(plane == 0, round(floor_level(plane)), plane)


def section_points(planes: DataFrame, border: int = 0, most: int = 20_000, neighbours: int = 100, least: float = 0.5) -> DataFrame:
    """Point clouds of sections (sample_id, channel, z, x, y) by their relative value
    (see bright_points); a section has at most `most` points. planes: (sample_id,
    channel, z, ny, nx, data uint16). A section without pixels has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                xy = bright_points(np.frombuffer(row.data, "<u2").reshape(row.ny, row.nx).astype(float), border, most, neighbours, least)
                yield pd.DataFrame({"sample_id": row.sample_id, "channel": row.channel, "z": row.z, "x": xy[:, 0].astype(float), "y": xy[:, 1].astype(float)})

    return planes.select(*KEYS, "ny", "nx", "data").mapInPandas(run, "sample_id string, channel int, z int, x double, y double")


def build_slice_stack(planes: DataFrame, scale: float = 1.0, median: int = 1, buffer: int = 10, size: Sequence[int] | None = None, channel: int | None = None, most: int = 20_000, neighbours: int = 100) -> DataFrame:
    """Planes (sample_id, channel, z, ny, nx, data uint16) of sections as one stack:
    median filter, `scale`, zeros to the plane's floor, all channels of a section
    cropped alike to the tissue in `channel` (the sample's first where None), centred
    on planes of `size` (y, x; the greatest crop where None or smaller) filled with the
    floor of the cropped plane, and the margin that all sections of a sample share taken off, an
    even number of pixels less than half of it on each axis.

    Sections without that channel are cropped by none and keep their whole plane.
    The planes are filtered twice, for the limits and for the crop, and written never;
    what is joined are limits and sizes.
    """

    def limits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                plane = _prepared(row, scale, median)
                out.append((row.sample_id, row.z, *tissue_limits(bright_points(plane, buffer, most, neighbours), plane.shape, buffer)))
            yield pd.DataFrame(out, columns=["sample_id", "z", "y0", "y1", "x0", "x1"])

    rows = planes.select(*KEYS, "ny", "nx", "data")
    if channel is None:
        first = planes.groupBy("sample_id").agg(F.min("channel").alias("channel"))
        guide = rows.join(first, ["sample_id", "channel"], "left_semi")
    else:
        guide = rows.where(F.col("channel") == channel)
    boxes = guide.mapInPandas(limits, "sample_id string, z int, y0 int, y1 int, x0 int, x1 int").groupBy("sample_id", "z").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    whole = lambda n: F.ceil(F.col(n) * scale - 1e-9).cast("int")
    shaped = rows.select("sample_id", "z", whole("ny").alias("my"), whole("nx").alias("mx")).groupBy("sample_id", "z").agg(F.max("my").alias("my"), F.max("mx").alias("mx"))
    boxes = shaped.join(boxes, ["sample_id", "z"], "left").select("sample_id", "z", *(F.coalesce(F.col(c), d).alias(c) for c, d in (("y0", F.lit(1)), ("y1", F.col("my")), ("x0", F.lit(1)), ("x1", F.col("mx")))))
    boxes = boxes.checkpoint()  # limits are found once, and read for the sizes and for the crop
    ny, nx = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    given = size or (0, 0)
    full = boxes.groupBy("sample_id").agg(F.greatest(F.max(ny), F.lit(given[0])).alias("fy"), F.greatest(F.max(nx), F.lit(given[1])).alias("fx"), F.max(ny).alias("_y"), F.max(nx).alias("_x"))
    # The least padding is that of the greatest crop.
    trim = {c: (F.floor((F.col(f) - F.col(m)) / 4) * 2).cast("int").alias(c) for c, f, m in (("ty", "fy", "_y"), ("tx", "fx", "_x"))}
    placed = boxes.join(full.select("sample_id", "fy", "fx", *trim.values()), "sample_id")

    def crop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                cut = _prepared(row, scale, median)[row.y0 - 1 : row.y1, row.x0 - 1 : row.x1]
                plane = np.full((row.fy, row.fx), round(floor_level(cut)), "<u2")
                y, x = (row.fy - cut.shape[0]) // 2, (row.fx - cut.shape[1]) // 2
                plane[y : y + cut.shape[0], x : x + cut.shape[1]] = np.clip(cut, 0, 65535)
                plane = plane[row.ty // 2 : row.fy - row.ty // 2, row.tx // 2 : row.fx - row.tx // 2]
                out.append((row.sample_id, row.channel, row.z, *plane.shape, plane.tobytes()))
            yield pd.DataFrame(out, columns=["sample_id", "channel", "z", "ny", "nx", "data"])

    return rows.join(placed, ["sample_id", "z"]).mapInPandas(crop, _PLANE)
