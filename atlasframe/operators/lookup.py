"""Label and name lookups, sampling along lines and discs, interpolation on grids."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlasframe.functions import clamp
from atlasframe.operators.geometry import apply_affine, apply_slice_transforms, to_registration_space

GRID = ("y", "x", "z")


def label_points(points: DataFrame, labels: DataFrame, how: str = "left") -> DataFrame:
    """Adds region_id at the rounded voxel; 0 where the annotation has none.

    An equi-join on the three axes; the annotation (labels) has a row per voxel."""
    keys = [F.round(F.col(c), 0).cast("int").alias(f"_{c}") for c in GRID]
    rows = points.select("*", *keys)
    a = labels.select(*(F.col(c).alias(f"_{c}") for c in GRID), "region_id")
    return rows.join(a, [f"_{c}" for c in GRID], how).withColumn("region_id", F.coalesce("region_id", F.lit(0))).drop(*(f"_{c}" for c in GRID))


def keep_in_tissue(points: DataFrame, labels: DataFrame) -> DataFrame:
    return label_points(points, labels).where("region_id > 0")


def points_in_regions(points: DataFrame, labels: DataFrame, ids: Sequence[int]) -> DataFrame:
    return label_points(points, labels).where(F.col("region_id").isin(list(ids)))


def with_region_names(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds substructure, structure, division, acronym and colour by region_id. Of
    several rows of one id and term set the smallest name counts; an unknown id is
    named by its number, without acronym, black."""
    pick = lambda s, c: F.min(F.when(F.col("term_set") == s, F.col(c)))
    wide = terms.groupBy("region_id").agg(
        *(pick(s, "name").alias(s) for s in ("substructure", "structure", "division")),
        pick("substructure", "acronym").alias("acronym"), *(pick("substructure", c).alias(c) for c in ("red", "green", "blue")),
    )
    rows = df.join(wide, "region_id", "left")
    return rows.withColumns({"substructure": F.coalesce("substructure", F.col("region_id").cast("string")), "acronym": F.coalesce("acronym", F.lit(""))} | {c: F.coalesce(c, F.lit(0)) for c in ("red", "green", "blue")})


def locate_ids(ids: DataFrame, where: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """First position of each id; nothing at all if one of them is missing."""
    found = ids.select(key).join(where.groupBy(key).agg(F.min(pos).alias(pos)), key, "left")
    lost = F.broadcast(found.agg(F.count_if(F.col(pos).isNull()).alias("_lost")))  # a single row
    return found.join(lost, F.col("_lost") == 0).drop("_lost")


def attach_labels(candidates: DataFrame, labels: DataFrame, key: str = "cell_id") -> DataFrame:
    """Candidates that have a label."""
    return candidates.join(labels.where("label is not null and not isnan(label)").select(key, "label"), key)


def _corners(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """A row per corner of the cell that holds each point, with its weight; corners
    without weight are left out, so points on the grid need no neighbour beyond it."""
    rows = points
    for a in axes:
        low = F.floor(F.col(a))
        part = F.col(a) - low
        choice = F.array(F.struct(low.alias("i"), (1 - part).alias("w")), F.struct((low + 1).alias("i"), part.alias("w")))
        rows = rows.withColumn(f"_{a}", F.explode(F.filter(choice, lambda s: s["w"] > 0)))
    weight = F.lit(1.0)
    for a in axes:
        weight = weight * F.col(f"_{a}.w")
    return rows.withColumn("_w", weight).withColumns({f"_{a}": F.col(f"_{a}.i").cast("int") for a in axes})


def _grid_cells(grid: DataFrame, axes: Sequence[str], values: Sequence[str], also: Sequence[str]) -> DataFrame:
    """A row for each cell that a place of the grid is a corner of: _axis is its lower
    corner, _c0, _c1, ... the values at its corners, null where the grid has none."""
    corners = list(product((0, 1), repeat=len(axes)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *((F.col(f"_{a}") - s).cast("int").alias(a) for a, s in zip(axes, step))) for k, step in enumerate(corners)))).alias("_at")
    rows = grid.select(*also, F.struct(*values).alias("_v"), each)
    return rows.groupBy(*also, *(F.col(f"_at.{a}").alias(f"_{a}") for a in axes)).agg(*(F.max(F.when(F.col("_at.k") == k, F.col("_v"))).alias(f"_c{k}") for k in range(len(corners))))


def interpolate(points: DataFrame, grid: DataFrame, axes: dict[str, str], values: dict[str, str], outside: float | None = 0.0, also: Sequence[str] = ()) -> DataFrame:
    """points with further columns: values (new column -> grid column) by linear
    interpolation of the grid, which has one row a place. axes: point column -> grid
    column. The grid is brought to one row a cell, so that a point meets its cell in
    one equi-join, whether points repeat or have no key. A point with a corner of
    weight that the grid lacks, or without a place, is outside: it gets that value
    (None drops it). also: further equal columns, such as a slice or channel."""
    names = list(axes)
    g = grid.select(*(F.col(c).alias(f"_{a}") for a, c in axes.items()), *also, *(F.col(c).alias(f"_v{i}") for i, c in enumerate(values.values())))
    cells = _grid_cells(g, names, [f"_v{i}" for i in range(len(values))], also)
    rows = points.withColumns({f"_{a}": F.floor(F.col(a)).cast("int") for a in names})
    hit = rows.join(cells, [f"_{a}" for a in names] + list(also), "left")
    out: dict[str, Column] = {}
    for i, v in enumerate(values):
        total = F.lit(0.0)
        for k, step in enumerate(product((0, 1), repeat=len(names))):
            w = F.lit(1.0)
            for a, s in zip(names, step):
                part = F.col(a) - F.floor(F.col(a))
                w = w * (part if s else 1 - part)
            # A corner without weight need not be there.
            total = total + F.when(w > 0, w * F.col(f"_c{k}._v{i}")).when(w == 0, 0.0)
        out[v] = total
    hit = hit.withColumns(out)
    lost = F.col(next(iter(values))).isNull()
    hit = hit.where(~lost) if outside is None else hit.withColumns({v: F.coalesce(v, F.lit(outside)) for v in values})
    return hit.select(*points.columns, *values)


def displace_points(points: DataFrame, field: DataFrame, voxel: float = 1.0) -> DataFrame:
    """Points minus the field (i, j, k, dx, dy, dz) at their place; outside it they
    stay. Rows of one id, or of none, are moved each for itself."""
    moved = interpolate(points, field, {"x": "i", "y": "j", "z": "k"}, {f"_d{c}": f"d{c}" for c in "xyz"})
    return moved.withColumns({c: F.col(c) - F.col(f"_d{c}") / voxel for c in "xyz"}).drop(*(f"_d{c}" for c in "xyz"))


def displace_points_2d(points: DataFrame, field: DataFrame, voxel: float = 1.0) -> DataFrame:
    """Each slice's points by its own field (slice, i, j, dx, dy)."""
    moved = interpolate(points, field, {"x": "i", "y": "j"}, {"_dx": "dx", "_dy": "dy"}, also=["slice"])
    return moved.withColumns({c: F.col(c) - F.col(f"_d{c}") / voxel for c in "xy"}).drop("_dx", "_dy").select(*points.columns)


def points_to_atlas(points: DataFrame, field: DataFrame, voxel: Sequence[float], size: Sequence[int], perm: Sequence[int], atlas_voxel: float, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """The whole chain: registration space, displacement, affine map back."""
    moved = displace_points(to_registration_space(points, voxel, size, perm, atlas_voxel), field)
    return apply_affine(moved, matrix, inverse=True)


def slice_points_to_atlas(points: DataFrame, field: DataFrame, transforms: DataFrame, positions: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Section series: 2-D displacement and transform of each slice, the slice's position as z, then the rigid map back."""
    flat = apply_slice_transforms(displace_points_2d(points, field), transforms)
    return apply_affine(flat.join(positions.select("slice", F.col("position").cast("double").alias("z")), "slice"), matrix, inverse=True)


def sample_line(lines: DataFrame, labels: DataFrame, size: Sequence[int], reach: int = 1000, per_voxel: int = 10) -> DataFrame:
    """Labels along lines (probe_id, ox, oy, oz, dx, dy, dz): per_voxel samples a
    voxel over +-reach, rounded, those inside the volume: (probe_id, step, region_id)."""
    steps = lines.withColumn("step", F.explode(F.sequence(F.lit(-reach * per_voxel), F.lit(reach * per_voxel))))
    at = {c: F.round(F.col(f"o{c}") + F.col(f"d{c}") * F.col("step") / per_voxel, 0).cast("int") for c in GRID}
    inside = steps.withColumns(at)
    for c, n in zip(GRID, size):
        inside = inside.where(F.col(c).between(1, n))
    return inside.join(labels, list(GRID)).select("probe_id", "step", *GRID, "region_id")


def disc_grid(implants: DataFrame, size: Sequence[int], depths: Sequence[float], step: float = 1.0) -> DataFrame:
    """A square grid of +-2 r across the axis at each depth, coordinates held inside
    the volume: implants (implant_id, cy, cx, cz, uy, ux, uz, vy, vx, vz, ny, nx, nz, radius)."""
    rows = implants.withColumn("depth", F.explode(F.array(*(F.lit(float(d)) for d in depths))))
    half = F.floor(2 * F.col("radius") / step).cast("int")
    rows = rows.withColumn("g1", F.explode(F.sequence(-half, half))).withColumn("g2", F.explode(F.sequence(-half, half)))
    at = {c: clamp(F.col(f"c{c}") + F.col(f"n{c}") * F.col("depth") + F.col(f"u{c}") * F.col("g1") * step + F.col(f"v{c}") * F.col("g2") * step, 1.0, float(n)) for c, n in zip(GRID, size)}
    return rows.withColumns(at).select("implant_id", "depth", "radius", (F.col("g1") * step).alias("g1"), (F.col("g2") * step).alias("g2"), *GRID)


def sample_disc(implants: DataFrame, labels: DataFrame, size: Sequence[int], depths: Sequence[float], step: float = 1.0) -> DataFrame:
    return label_points(disc_grid(implants, size, depths, step), labels)


def sample_disc_intensity(implants: DataFrame, voxels: DataFrame, size: Sequence[int], depths: Sequence[float], step: float = 1.0) -> DataFrame:
    """Linear intensity of each channel over the same grid."""
    # All channels in a single row: Spark takes the side of the implants for the smaller one, not counting the grid's rows.
    channels = F.broadcast(voxels.select("channel").distinct().agg(F.collect_list(F.struct("channel")).alias("_channels")))
    every = disc_grid(implants, size, depths, step).join(channels, F.lit(True)).select("*", F.inline("_channels")).drop("_channels")
    return interpolate(every, voxels, {c: c for c in GRID}, {"value": "value"}, also=["channel"])


def _output_grid(spark: SparkSession, size: Sequence[int]) -> DataFrame:
    ny, nx, nz = size
    return spark.range(ny * nx * nz).select((F.col("id") % ny + 1).cast("int").alias("out_y"), (F.floor(F.col("id") / ny) % nx + 1).cast("int").alias("out_x"), (F.floor(F.col("id") / (ny * nx)) + 1).cast("int").alias("out_z"))


def _resample(voxels: DataFrame, source: DataFrame, mode: str, fill: float, by: Sequence[str]) -> DataFrame:
    """Values of each group of voxels at source (out_y, out_x, out_z and the place in
    the input). What has no voxel at all at its corners of weight is left out where
    fill is 0, and is fill otherwise."""
    out = [F.col(f"out_{c}").alias(c) for c in GRID]
    if mode == "nearest":
        near = source.withColumns({c: F.round(F.col(c), 0).cast("int") for c in GRID})
        found = voxels.join(near, list(GRID)).select(*by, *out, "value")
    else:
        v = voxels.select(*by, *(F.col(c).alias(f"_{c}") for c in GRID), "value")
        hit = _corners(source, GRID).join(v, [f"_{c}" for c in GRID])
        summed = hit.groupBy(*by, *(f"out_{c}" for c in GRID)).agg(F.sum(F.col("_w") * F.col("value")).alias("value"), F.sum("_w").alias("_w"))
        found = summed.select(*by, *out, (F.col("value") + (1 - F.col("_w")) * fill).alias("value"))
    if fill == 0:
        return found
    every = source.select(*out).join(voxels.select(*by).distinct(), F.lit(True))  # every output voxel of every group is a row of the result
    return every.join(found, [*by, *GRID], "left").select(*by, *GRID, F.coalesce("value", F.lit(fill)).alias("value"))


def warp_volume(voxels: DataFrame, matrix: Sequence[Sequence[float]], size: Sequence[int], mode: str = "linear", fill: float = 0.0, by: Sequence[str] = ("sample_id", "channel")) -> DataFrame:
    """Resample onto a grid of `size` by the inverse of matrix: linear for
    intensities, nearest for labels; missing corners count as fill. A row per voxel
    and corner: for sparse volumes; dense ones go through blocks.warp_blocks."""
    grid = _output_grid(voxels.sparkSession, size)
    source = apply_affine(grid.withColumns({c: F.col(f"out_{c}").cast("double") for c in GRID}), matrix, inverse=True, cols=GRID)
    return _resample(voxels, source, mode, fill, by)


def warp_volume_field(voxels: DataFrame, field: DataFrame, matrix: Sequence[Sequence[float]], size: Sequence[int], mode: str = "linear", fill: float = 0.0, by: Sequence[str] = ("sample_id", "channel")) -> DataFrame:
    """warp_volume with a displacement of the output grid before the affine map."""
    grid = _output_grid(voxels.sparkSession, size)
    points = grid.withColumns({c: F.col(f"out_{c}").cast("double") for c in GRID})
    return _resample(voxels, apply_affine(displace_points(points, field), matrix, inverse=True), mode, fill, by)


def run_lengths(samples: DataFrame, by: str = "probe_id", order: str = "step", label: str = "region_id", per_voxel: int = 10) -> DataFrame:
    """Runs of one region along a line, outside (0) left out: depth from the first
    sample in tissue, samples of each run: (by, run, region_id, d0, d1, n)."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    rows = samples.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entry = samples.where(F.col(label) > 0).groupBy(by).agg(F.min(order).alias("_entry"))
    runs = rows.where(F.col(label) > 0).groupBy(by, "run", label).agg(F.min(order).alias("_a"), F.max(order).alias("_b"), F.count("*").alias("n"))
    return runs.join(entry, by).select(by, "run", label, ((F.col("_a") - F.col("_entry")) / per_voxel).alias("d0"), ((F.col("_b") - F.col("_entry")) / per_voxel).alias("d1"), "n")


def invert(matrix: Sequence[Sequence[float]]) -> list[list[float]]:
    return np.linalg.inv(np.array(matrix, float)).tolist()
