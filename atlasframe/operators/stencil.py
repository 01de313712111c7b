"""Neighbourhoods in volumes held as rows (by, y, x, z, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.spatial import _cut, link_components

AXES = ("y", "x", "z")


def _line(by: Sequence[str], axis: str, axes: Sequence[str], low: int, high: int):
    return Window.partitionBy(*by, *(a for a in axes if a != axis)).orderBy(axis).rangeBetween(low, high)


def _over_box(sources: DataFrame, targets: DataFrame, r: int, by: Sequence[str], axes: Sequence[str], values: dict[str, Column], how) -> DataFrame:
    """targets with, for each of values, how (F.max, F.sum, ...) over the sources in
    the box of +-r round the row; volumes may have gaps. Axis by axis a source goes
    to the 2 r + 1 places that it reaches and equal places are folded at once (on the
    map side first); along the last axis a window over the line does both. A place
    between two voxels is carried whether or not a voxel is there."""
    rows = sources.select(*by, *axes, *(c.alias(n) for n, c in values.items()))
    for a in axes[:-1]:
        rows = rows.withColumn(a, F.explode(F.sequence(F.col(a) - r, F.col(a) + r)))
        rows = rows.groupBy(*by, *axes).agg(*(how(n).alias(n) for n in values))
    own = targets.select(*by, *axes, *(F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in values), F.struct(*(F.col(c) for c in targets.columns)).alias("_own"))
    both = rows.withColumn("_own", F.lit(None).cast(own.schema["_own"].dataType)).unionByName(own)
    line = _line(by, axes[-1], axes, -r, r)
    return both.withColumns({n: how(n).over(line) for n in values}).where("_own is not null").select("_own.*", *values)


def local_extreme(voxels: DataFrame, r: int, by: Sequence[str], axes: Sequence[str] = AXES, most: bool = True, value: str = "value", out: str = "extreme") -> DataFrame:
    """Adds the greatest (or least) value of the present voxels in the box of +-r."""
    how = F.max if most else F.min
    if len(axes) == 1:
        return voxels.withColumn(out, how(value).over(_line(by, axes[0], axes, -r, r)))
    return _over_box(voxels, voxels, r, by, axes, {out: F.col(value)}, how)


def local_max(voxels: DataFrame, r: int, by: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    return local_extreme(voxels, r, by, axes)


def local_min(voxels: DataFrame, r: int, by: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    return local_extreme(voxels, r, by, axes, most=False)


def find_peaks(voxels: DataFrame, r: int, threshold: float, by: Sequence[str], axes: Sequence[str] = AXES, tolerance: float = 0.0) -> DataFrame:
    """Voxels above threshold that are the maximum of their neighbourhood, within the tolerance."""
    return local_max(voxels, r, by, axes).where((F.col("value") >= F.col("extreme") - tolerance) & (F.col("value") > threshold)).drop("extreme")


def dilate(mask: DataFrame, r: int, voxels: DataFrame, by: Sequence[str], threshold: float, axes: Sequence[str] = AXES) -> DataFrame:
    """Voxels above threshold within the box of +-r round a mask voxel."""
    bright = voxels.where(F.col("value") > threshold)
    return _over_box(mask, bright, r, by, axes, {"_near": F.lit(1)}, F.max).where("_near = 1").drop("_near")


def dilate_ellipsoid(mask: DataFrame, radii: Sequence[float], by: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    """All voxels of the ellipsoids round the mask's voxels."""
    steps = [s for s in product(*(range(-math.floor(r), math.floor(r) + 1) for r in radii)) if sum((a / r) ** 2 for a, r in zip(s, radii)) <= 1]
    rows = mask.select(*by, *axes, F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps))).alias("_s"))
    return rows.select(*by, *((F.col(a) + F.get("_s", F.lit(i))).alias(a) for i, a in enumerate(axes))).distinct()


def connected_components(mask: DataFrame, by: Sequence[str], connectivity: int = 26, axes: Sequence[str] = AXES, checkpoint=None) -> DataFrame:
    """Adds component (an id per blob). Neighbours share a face, edge (18) or corner
    (26; 8 in two dimensions); edges go through distributed label propagation."""
    most = 2 if connectivity == 18 else len(axes)
    steps = [s for s in product((-1, 0, 1), repeat=len(axes)) if 0 < sum(map(abs, s)) <= most and s > (0,) * len(axes)]
    cut = checkpoint or _cut
    nodes = cut(mask.withColumn("_id", F.struct(*by, *axes)))
    near = nodes.select(*by, *axes, F.col("_id").alias("a"), F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps))).alias("_s"))
    near = near.select("a", *by, *((F.col(c) + F.get("_s", F.lit(i))).cast(mask.schema[c].dataType).alias(c) for i, c in enumerate(axes)))
    # Spark's size check does not count the rows of the steps, so neither side may be broadcast.
    edges = near.join(nodes.select(*by, *axes, F.col("_id").alias("b")).hint("merge"), [*by, *axes]).select("a", "b")
    return nodes.join(link_components(edges, nodes, "_id", checkpoint).hint("merge"), "_id").drop("_id")


def largest_component(components: DataFrame, by: Sequence[str]) -> DataFrame:
    n = components.groupBy(*by, "component").agg(F.count("*").alias("_n"))
    best = n.groupBy(*by).agg(F.min_by("component", F.struct(-F.col("_n"), F.col("component"))).alias("component"))
    return components.join(best, [*by, "component"], "left_semi")


def weighted_background(voxels: DataFrame, sigma: float, r: int, by: Sequence[str], axis: str = "z", axes: Sequence[str] = AXES) -> DataFrame:
    """Adds background: Gaussian-weighted mean over +-r along axis, weights of absent planes left out."""
    offsets = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    near = voxels.select(*by, *axes, "value", offsets.alias("_o")).withColumn(axis, F.col(axis) + F.col("_o"))
    w = F.exp(-(F.col("_o") ** 2) / (2 * sigma**2))
    mean = near.groupBy(*by, *axes).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("background"))
    return voxels.join(mean, [*by, *axes])


def gaussian_smooth(voxels: DataFrame, sigma: float, by: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    """Separable Gaussian (three sigma) over the present voxels, axis by axis."""
    r = max(1, math.ceil(3 * sigma))
    for a in axes:
        voxels = weighted_background(voxels, sigma, r, by, a, axes).withColumn("value", F.col("background")).drop("background")
    return voxels


def median_filter(voxels: DataFrame, r: int, by: Sequence[str], axes: Sequence[str] = ("y", "x"), rank: float = 0.5) -> DataFrame:
    """Median (or other rank) of the present voxels in the window of +-r."""
    steps = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in product(range(-r, r + 1), repeat=len(axes)))))
    spread = voxels.select(*by, *axes, "value", steps.alias("_s"))
    spread = spread.select(*by, *((F.col(a) + F.get("_s", F.lit(i))).alias(a) for i, a in enumerate(axes)), "value")
    med = spread.groupBy(*by, *axes).agg(F.percentile("value", F.lit(rank)).alias("_m"))
    return voxels.join(med, [*by, *axes]).withColumn("value", F.col("_m")).drop("_m")


def gradient_magnitude(voxels: DataFrame, by: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    """Adds gradient: central differences where both neighbours are there, one-sided at the ends, 0 alone."""
    total = F.lit(0.0)
    for a in axes:
        w = Window.partitionBy(*by, *(c for c in axes if c != a)).orderBy(a)
        here = lambda f: F.when(F.abs(f(a).over(w) - F.col(a)) == 1, f("value").over(w))  # noqa: B023, E731
        low, high = here(F.lag), here(F.lead)
        d = F.when(low.isNotNull() & high.isNotNull(), (high - low) / 2).when(high.isNotNull(), high - F.col("value")).when(low.isNotNull(), F.col("value") - low).otherwise(0.0)
        total = total + d * d
    return voxels.withColumn("gradient", F.sqrt(total))


def local_std(voxels: DataFrame, r: int, by: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    """Adds std: sample deviation in the box of +-r over the present voxels, from sums
    of values less their group's mean (so that a large mean costs no digits)."""
    mean = voxels.groupBy(*by).agg(F.avg("value").alias("_mean"))
    off = F.col("value").cast("double") - F.col("_mean")
    near = voxels.join(mean, list(by)).select(*by, *axes, off.alias("_off"))
    rows = _over_box(near, voxels, r, by, axes, {"_n": F.lit(1.0), "_s": F.col("_off"), "_q": F.col("_off") ** 2}, F.sum)
    var = F.when(F.col("_n") > 1, F.greatest((F.col("_q") - F.col("_s") ** 2 / F.col("_n")) / (F.col("_n") - 1), F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("std", F.sqrt(var)).drop("_n", "_s", "_q")
