"""Coordinates: physical and voxel spaces, permutations, affine maps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _put(df: DataFrame, cols: Sequence[str], values: Sequence[Column]) -> DataFrame:
    return df.withColumns(dict(zip(cols, values)))


def to_registration_space(points: DataFrame, voxel: Sequence[float], size: Sequence[int], perm: Sequence[int], atlas_voxel: float, cols: Sequence[str] = XYZ) -> DataFrame:
    """Voxel centres (1-based) to registration voxels: to physical units, axes put
    in the order of |perm|, turned round in their extent where perm is negative,
    then divided by twice the atlas voxel."""
    physical = [(F.col(c) - 1) * v for c, v in zip(cols, voxel)]
    extent = [(n - 1) * v for n, v in zip(size, voxel)]
    out = []
    for p in perm:
        i = abs(p) - 1
        out.append((F.lit(extent[i]) - physical[i] if p < 0 else physical[i]) / (2 * atlas_voxel))
    return _put(points, cols, out)


def from_display_space(points: DataFrame, size: Sequence[int], perm: Sequence[int], scale: float, cols: Sequence[str] = XYZ) -> DataFrame:
    """Undo display flips (size + 1 - p), put axes back, rescale to native voxels (1-based)."""
    out: list[Column] = [F.lit(None)] * len(perm)
    for c, n, p in zip(cols, size, perm):
        shown = n + 1 - F.col(c) if p < 0 else F.col(c)
        out[abs(p) - 1] = (shown - 1) * scale + 1
    return _put(points, cols, out)


def permute_flip(voxels: DataFrame, size: Sequence[int], perm: Sequence[int], cols: Sequence[str] = ("y", "x", "z")) -> DataFrame:
    """Axes of a volume in the order of |perm|, counted from the far end where perm is negative."""
    return _put(voxels, cols, [size[abs(p) - 1] + 1 - F.col(cols[abs(p) - 1]) if p < 0 else F.col(cols[abs(p) - 1]) for p in perm])


def apply_affine(points: DataFrame, matrix: Sequence[Sequence[float]], inverse: bool = False, cols: Sequence[str] = XYZ) -> DataFrame:
    """Homogeneous transform of points; other columns are carried along."""
    m = np.linalg.inv(np.array(matrix, float)) if inverse else np.array(matrix, float)
    n = len(cols)
    return _put(points, cols, [sum((F.col(c) * float(m[i, k]) for k, c in enumerate(cols)), F.lit(float(m[i, n]))) for i in range(n)])


def apply_affine_columns(points: DataFrame, m: str, cols: Sequence[str] = XYZ) -> DataFrame:
    """As apply_affine, with the row-major matrix in an array column."""
    n = len(cols)
    at = lambda i, k: F.get(F.col(m), F.lit(i * (n + 1) + k))
    return _put(points, cols, [sum((F.col(c) * at(i, k) for k, c in enumerate(cols)), at(i, n)) for i in range(n)])


def apply_slice_transforms(points: DataFrame, transforms: DataFrame, cols: Sequence[str] = ("x", "y"), key: str = "slice") -> DataFrame:
    """Each point by the transform of its slice: transforms(slice, m). Points of slices without one are left out."""
    return apply_affine_columns(points.join(transforms.select(key, F.col("m").alias("_m")), key), "_m", cols).drop("_m")


def warp_by_path(points: DataFrame, path: DataFrame, axis: str = "z") -> DataFrame:
    """Points moved along a warp path (source, target); a source may serve several targets."""
    p = path.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    return points.join(p, points[axis] == p["_s"]).withColumn(axis, F.col("_t")).drop("_s", "_t")


def reorder_slices(voxels: DataFrame, decisions: DataFrame, width: int, axis: str = "z", across: str = "x") -> DataFrame:
    """Slices by the decisions (original_index, flip_state, new_order_original_index):
    turned round across where flip_state is 1 and dropped where it is -1; the slice
    at place k of the result is the one named in row k (rows in order of original_index)."""
    d = decisions.select(F.col("original_index").alias("_o"), F.col("flip_state").alias("_f"))
    order = decisions.select(F.col("new_order_original_index").alias("_from"), F.col("original_index").alias("_to"))
    rows = voxels.join(d, voxels[axis] == d["_o"]).where("_f <> -1").withColumn(across, F.when(F.col("_f") == 1, width + 1 - F.col(across)).otherwise(F.col(across)))
    return rows.join(order, F.col("_o") == F.col("_from")).withColumn(axis, F.col("_to")).drop("_o", "_f", "_from", "_to")


def map_and_crop(points: DataFrame, matrix: Sequence[Sequence[float]], size: Sequence[int], cols: Sequence[str] = XYZ) -> DataFrame:
    """Points of another scan by a rigid map, those inside the new volume."""
    out = apply_affine(points, matrix, cols=cols)
    for c, n in zip(cols, size):
        out = out.where(F.col(c).between(1, n))
    return out
