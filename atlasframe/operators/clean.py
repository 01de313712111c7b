"""Filters and value maps on points, detections and voxels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.functions import clamp
from atlasframe.operators.quantiles import group_quantiles, table_quantiles

XYZ = ("x", "y", "z")
SKIPPED_DIVISIONS = ["nerves", "tracts", "system", "unassigned", "white matter", "canal", "aqueduct", "ventricle"]


def _all(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def drop_nonfinite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(_all([F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in cols]))


def keep_in_volume(points: DataFrame, size: Sequence[int], cols: Sequence[str] = XYZ) -> DataFrame:
    """Coordinates rounded (halves away from zero); points outside 1..size go."""
    points = points.withColumns({c: F.round(F.col(c), 0).cast("int") for c in cols})
    return points.where(_all([F.col(c).between(1, n) for c, n in zip(cols, size)]))


def own_tile_only(cells: DataFrame, low: Sequence[str], high: Sequence[str], cols: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Detections whose centre lies in the tile's own part: from low, up to but not including high."""
    return cells.where(_all([(F.col(c) >= F.col(a)) & (F.col(c) < F.col(b)) for c, a, b in zip(cols, low, high)]))


def shape_filter(cells: DataFrame, radius: float, max_elongation: float = 2.5, max_size: float = 8.0) -> DataFrame:
    return cells.where((F.col("elongation") <= max_elongation) & F.col("diameter").between(radius, max_size * radius) & (F.col("intensity") > 0))


def shape_filter_2d(cells: DataFrame, radius: float, threshold: float, min_circularity: float = 0.7) -> DataFrame:
    return cells.where((F.col("circularity") >= min_circularity) & (F.col("diameter") >= radius / 2) & (F.col("intensity") >= threshold))


def size_filter(components: DataFrame, element: float, factor: float = 10.0, col: str = "n") -> DataFrame:
    return components.where(F.col(col).between(element / factor, element * factor))


def auto_intensity_threshold(points: DataFrame, inside: str = "region_id", value: str = "intensity") -> DataFrame:
    """One row: the half of (most frequent value of rejected points + 1 % quantile of
    accepted ones), at least 1, and 1 where the former is above the latter."""
    counts = points.where((F.col(inside) == 0) & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    found = counts.agg(F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("m"))
    (q,) = table_quantiles(points.where(F.col(inside) > 0), value, [0.01])
    return found.withColumn("q", F.lit(q).cast("double")).select(F.when(F.col("m") > F.col("q"), 1.0).otherwise(F.greatest(F.lit(1.0), (F.coalesce("m", F.lit(0.0)) + F.coalesce("q", F.lit(0.0))) / 2)).alias("threshold"))


def auto_intensity_filter(points: DataFrame, inside: str = "region_id", value: str = "intensity") -> DataFrame:
    """Accepted points at or above the automatic threshold."""
    one = F.broadcast(auto_intensity_threshold(points, inside, value))  # a single row
    return points.where(F.col(inside) > 0).join(one, F.col(value) >= F.col("threshold")).drop("threshold")


def edge_margin(points: DataFrame, size: Sequence[int], share: float = 0.01, cols: Sequence[str] = XYZ) -> DataFrame:
    """Points more than a border away from the edge: share of the smallest side, one voxel at least."""
    margin = max(int(min(size) * share), 1)
    return points.where(_all([(F.col(c) > margin) & (F.col(c) <= n - margin) for c, n in zip(cols, size)]))


def fill_zeros_with_mode(voxels: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Zeros become the most frequent positive value of their group (the smallest of ties)."""
    counts = voxels.where(F.col(value) > 0).groupBy(*by, value).count()
    # Counted by value first, so that no group's values meet in one task.
    modes = counts.groupBy(*by).agg(F.min_by(F.col(value), F.struct(-F.col("count"), F.col(value))).alias("_mode"))
    return voxels.join(modes, list(by), "left").withColumn(value, F.when(F.col(value) == 0, F.coalesce("_mode", F.col(value))).otherwise(F.col(value))).drop("_mode")


def relative_to_background(df: DataFrame, value: str = "value", background: str = "background", clip: bool = False) -> DataFrame:
    """(v - b) / b; 0 where b is 0 or missing, and where negative if clip."""
    v = F.when(F.col(background) != 0, (F.col(value) - F.col(background)) / F.col(background)).otherwise(0.0)
    v = F.coalesce(v, F.lit(0.0))
    return df.withColumn(value, F.greatest(v, F.lit(0.0)) if clip else v)


def rescale_to_range(voxels: DataFrame, by: Sequence[str], low: float = 0.01, high: float = 0.99, bits: int = 8, value: str = "value") -> DataFrame:
    """Stretch between two quantiles of each group to whole numbers of `bits` bits."""
    q = group_quantiles(voxels, by, value, {"_lo": low, "_hi": high})
    top = float((1 << bits) - 1)
    v = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return voxels.join(q, list(by)).withColumn(value, F.round(clamp(v, 0.0, 1.0) * top, 0)).drop("_lo", "_hi")


def clamp_background(voxels: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Values held between the 10 % and 90 % quantiles of the positive ones of their group."""
    q = group_quantiles(voxels, by, F.when(F.col(value) > 0, F.col(value)), {"_lo": 0.1, "_hi": 0.9})
    return voxels.join(q, list(by), "left").withColumn(value, clamp(value, "_lo", "_hi")).drop("_lo", "_hi")


def select_matched_controls(points: DataFrame) -> DataFrame:
    """Control points of views with as many sample as atlas points, of which there is one at least."""
    views = points.groupBy("view_id").agg(F.count_if(F.col("side") == "sample").alias("s"), F.count_if(F.col("side") == "atlas").alias("a"))
    return points.join(views.where("s = a and s > 0").select("view_id"), "view_id", "left_semi")


def exclude_divisions(df: DataFrame, name: str = "name", skipped: Sequence[str] = SKIPPED_DIVISIONS) -> DataFrame:
    """Rows without a name stay."""
    return df.where(~F.coalesce(F.lower(name).rlike("|".join(skipped)), F.lit(False)))


def side_of(z, nz: int) -> Column:
    return F.when((F.col(z) if isinstance(z, str) else z) > nz / 2, "L").otherwise("R")


def assign_side(points: DataFrame, nz: int, z: str = "z") -> DataFrame:
    return points.withColumn("side", side_of(z, nz))


def signal_qc(stats: DataFrame, by: Sequence[str], value: str = "value", floor: float = 0.0) -> DataFrame:
    """Adds good: not below median - 2 robust SD of its group, nor below floor."""
    rows = stats.join(group_quantiles(stats, by, value, {"_med": 0.5}), list(by), "left")
    sd = group_quantiles(rows, by, F.abs(F.col(value) - F.col("_med")) * 1.4826, {"_sd": 0.5})
    return rows.join(sd, list(by), "left").withColumn("good", (F.col(value) >= F.col("_med") - 2 * F.col("_sd")) & (F.col(value) >= floor)).drop("_med", "_sd")


def crop_axis(df: DataFrame, axis: str, low: int, high: int) -> DataFrame:
    """Rows with low <= axis <= high, counted from 1 again."""
    return df.where(F.col(axis).between(low, high)).withColumn(axis, F.col(axis) - (low - 1))


def take_slice(voxels: DataFrame, axis: str, index: int) -> DataFrame:
    return voxels.where(F.col(axis) == index).drop(axis)


def annotation_boundary(labels: DataFrame, by: Sequence[str], y: str = "y", x: str = "x", label: str = "region_id") -> DataFrame:
    """Adds boundary: the label differs from that of a neighbour up, down, left or right."""
    out = F.lit(False)
    for axis, other in ((y, x), (x, y)):
        w = Window.partitionBy(*by, other).orderBy(axis)
        for step in (F.lag, F.lead):
            near = step(axis).over(w)
            beside = F.abs(near - F.col(axis)) == 1
            out = out | F.coalesce(beside & (step(label).over(w) != F.col(label)), F.lit(False))
    return labels.withColumn("boundary", out)


def normalise_views(candidates: DataFrame, view: str = "view") -> DataFrame:
    """Views scaled to length 1, then all values mapped to 0..1 by the least and greatest of all."""
    norm = F.sqrt(F.aggregate(view, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rows = candidates.withColumn(view, F.transform(view, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))
    ends = F.broadcast(rows.agg(F.min(F.array_min(view)).alias("_lo"), F.max(F.array_max(view)).alias("_hi")))  # a single row
    return rows.join(ends, F.lit(True)).withColumn(view, F.transform(view, lambda x: F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0))).drop("_lo", "_hi")


def highlight_regions(labels: DataFrame, names: DataFrame, text: str, values: str = "value") -> DataFrame:
    """Label voxels of regions whose name holds text, with the region's value mapped to 1..255."""
    held = names.where(F.lower("name").contains(text.lower()))
    ends = F.broadcast(held.agg(F.min(values).alias("_lo"), F.max(values).alias("_hi")))  # a single row
    level = F.when(F.col("_hi") > F.col("_lo"), (F.col(values) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 254 + 1).otherwise(1.0)
    # A row a region of the atlas: voxels are neither shuffled nor sorted by the few regions.
    return labels.join(F.broadcast(held.join(ends, F.lit(True)).select("region_id", level.alias("level"))), "region_id")
