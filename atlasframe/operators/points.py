"""Point extraction from volumes, candidate models and augmentations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators import blocks
from atlasframe.operators.clean import annotation_boundary, edge_margin
from atlasframe.operators.quantiles import group_quantiles
from atlasframe.operators.spatial import denoise_points
from atlasframe.operators.stats import sample_fraction, sample_per_group
from atlasframe.operators.stencil import gradient_magnitude, local_std
from atlasframe.operators.tiles import bandpass

VOXEL = ("y", "x", "z")


def _above_quantile(rows: DataFrame, value: str, q: float, by: Sequence[str]) -> DataFrame:
    limit = group_quantiles(rows, by, value, {"_l": q})
    return rows.join(limit, list(by)).where(F.col(value) > F.col("_l")).drop("_l")


def extract_points_gradient(voxels: DataFrame, threshold: float, size: Sequence[int], by: Sequence[str], share: float = 0.1, neighbours: int = 0, width: float = 4.0) -> DataFrame:
    """Voxels whose gradient per intensity is above threshold and whose intensity is
    above twice the 5 % quantile of their third of the volume, away from the edge,
    thinned; with `neighbours`, without those whose mean distance to so many nearest
    ones of all groups is more than a deviation above the mean (see spatial.denoise_points)."""
    rows = gradient_magnitude(voxels, by).withColumn("_t", F.floor((F.col("z") - 1) * 3 / size[2]))
    floor = group_quantiles(rows, [*by, "_t"], "value", {"_q": 0.05}).select(*by, "_t", (2 * F.col("_q")).alias("_f"))
    hit = rows.join(floor, [*by, "_t"]).where((F.col("value") > F.col("_f")) & (F.col("gradient") > threshold * F.col("value"))).drop("_t", "_f")
    hit = edge_margin(hit, size, cols=VOXEL).withColumn("_k", F.xxhash64(*by, *VOXEL))
    thin = sample_fraction(hit, share, "_k")
    return (denoise_points(thin.checkpoint(), neighbours, width, "_k", VOXEL) if neighbours else thin).drop("_k")


def extract_points_std(voxels: DataFrame, r: int, q: float, by: Sequence[str], share: float = 1.0) -> DataFrame:
    """Voxels whose local deviation is above its quantile, thinned."""
    hit = _above_quantile(local_std(voxels, r, by), "std", q, by).withColumn("_k", F.xxhash64(*by, *VOXEL))
    return sample_fraction(hit, share, "_k").drop("_k")


def extract_points_highpass(v: blocks.Volume, radius: float, q: float = 0.99, share: float = 0.1, halo: int | None = None) -> DataFrame:
    """Voxels of fine structure: (by, y, x, z, value) where the band-passed volume is
    above half its q quantile over all voxels, off the first and last y, thinned to
    `share`. The band lies between a third and six times the corner length
    pi * radius / 2. Cubes are filtered each with its halo (the band's longer end, or
    the edge), and the quantile is counted where they lie, so only hits become rows."""
    corner = math.pi * radius / 2
    wide = min(v.edge, math.ceil(6 * corner)) if halo is None else halo
    band = blocks.filtered(v, wide, lambda a: bandpass(a, 6 * corner, corner / 3))
    band = replace(band, cubes=band.cubes.checkpoint())
    limit = blocks.cube_quantile(band.cubes, q)
    hit = blocks.voxels_above(band, math.inf if limit is None else limit / 2).where((F.col("y") > 1) & (F.col("y") < v.size[0]))
    return sample_fraction(hit.withColumn("_k", F.xxhash64(*v.by, *VOXEL)), share, "_k").drop("_k")


def extract_points_slices(voxels: DataFrame, q: float, n: int, by: Sequence[str]) -> DataFrame:
    """At most n voxels per slice of those whose in-plane gradient is above the slice's quantile."""
    keys = [*by, "z"]
    hit = _above_quantile(gradient_magnitude(voxels, keys, ("y", "x")), "gradient", q, keys)
    return sample_per_group(hit.withColumn("_k", F.xxhash64(*keys, "y", "x")), n, keys, "_k").drop("_k")


def boundary_points(labels: DataFrame, n: int) -> DataFrame:
    """At most n label-boundary voxels per slice."""
    hit = annotation_boundary(labels, ["z"]).where("boundary").withColumn("_k", F.xxhash64(*VOXEL))
    return sample_per_group(hit, n, ["z"], "_k").drop("_k", "boundary")


def white_matter_ids(tree: DataFrame, words: Sequence[str] = ("fasciculus", "funiculus")) -> DataFrame:
    """(region_id) of the children of regions whose name holds one of the words, in any
    case; children are numbers joined by commas, and what is no number is left out."""
    named = tree.where(F.lower("name").rlike("|".join(words)))
    ids = named.select(F.explode(F.split("children", ",")).alias("id")).select(F.trim("id").try_cast("int").alias("region_id"))
    return ids.where("region_id is not null").distinct()


def _edge(rows: DataFrame, masks: Sequence[str], by: Sequence[str]) -> DataFrame:
    """rows with masks (0 or 1) replaced by whether their 3 x 3 Sobel gradient in y and x is
    not zero; a missing neighbour counts as equal to the voxel beside it."""

    def beside(c: str, f, w: Window, axis: str):
        return F.coalesce(F.when(F.abs(f(axis).over(w) - F.col(axis)) == 1, f(c).over(w)), F.col(c))

    down, across = Window.partitionBy(*by, "x").orderBy("y"), Window.partitionBy(*by, "y").orderBy("x")
    # Both gradients are a difference along one axis of a (1, 2, 1) sum along the other: one pass an axis.
    first = {}
    for m in masks:
        low, high = beside(m, F.lag, down, "y"), beside(m, F.lead, down, "y")
        first |= {f"_s{m}": low + 2 * F.col(m) + high, f"_d{m}": high - low}
    rows = rows.withColumns(first)
    second = {}
    for m in masks:
        gx = beside(f"_s{m}", F.lead, across, "x") - beside(f"_s{m}", F.lag, across, "x")
        gy = beside(f"_d{m}", F.lead, across, "x") + 2 * F.col(f"_d{m}") + beside(f"_d{m}", F.lag, across, "x")
        second[m] = (gx != 0) | (gy != 0)
    return rows.withColumns(second).drop(*first)


def one_a_box(points: DataFrame, most: int, by: Sequence[str], cols: Sequence[str] = ("x", "y")) -> DataFrame:
    """One point of each box of a grid that follows the points' density: a group's
    points are cut to strips along the first column and the strips to boxes of at
    most `most` points along the second; the middle point of each box stays."""
    a, b = cols
    group = Window.partitionBy(*by)
    n = F.count("*").over(group)
    strips = F.ceil(F.sqrt(F.ceil(n / most)))
    rows = points.withColumn("_strip", F.floor((F.row_number().over(group.orderBy(a, b)) - 1) / F.ceil(n / strips)))
    strip = Window.partitionBy(*by, "_strip")
    rows = rows.withColumn("_at", F.row_number().over(strip.orderBy(b, a)) - 1).withColumn("_box", F.floor(F.col("_at") / most))
    middle = F.floor((F.least(F.lit(most), F.count("*").over(strip) - F.col("_box") * most) - 1) / 2)
    return rows.withColumn("_middle", middle).where(F.col("_at") % most == F.col("_middle")).drop("_strip", "_at", "_box", "_middle")


def cord_edge_points(labels: DataFrame, white: DataFrame, by: Sequence[str] = ("z",), most: int = 6) -> DataFrame:
    """(by, y, x) of voxels on the outer edge of labelled tissue or on the edge of its
    white matter (labels in white, (region_id)), thinned to one of `most` neighbouring
    ones in each slice. labels: (by, y, x, region_id), 0 or null outside. Labels are
    joined with the few regions of an atlas; two shuffles of the voxels, one an axis,
    find the edges, and only edges are thinned."""
    ids = white.select("region_id").distinct().withColumn("_white", F.lit(1))
    rows = labels.select(*by, "y", "x", "region_id").join(ids, "region_id", "left")
    rows = rows.select(*by, "y", "x", F.coalesce("_white", F.lit(0)).alias("_w"), F.coalesce((F.col("region_id") > 0).cast("int"), F.lit(0)).alias("_in"))
    return one_a_box(_edge(rows, ["_w", "_in"], by).where("_w or _in").select(*by, "y", "x"), most, by)


def augment_views(candidates: DataFrame, key: str = "cell_id", seed: int = 1, view: str = "view", parts: int = 3) -> DataFrame:
    """Each of the parts of a view turned round or not by the bits of the key's hash, all alike for one axis."""
    size = (F.size(view) / parts).cast("int")
    bits = F.xxhash64(key, F.lit(seed))
    cut = [F.slice(view, F.lit(i) * size + 1, size) for i in range(parts)]
    turned = [F.when(F.shiftright(bits, i).bitwiseAND(1) == 1, F.reverse(c)).otherwise(c) for i, c in enumerate(cut)]
    return candidates.withColumn(view, F.concat(*turned))


class ArtifactClassifier:
    """Two-class logistic model on view vectors (pyspark.ml)."""

    def __init__(self, view: str = "view", label: str = "label") -> None:
        self.view, self.label, self.model = view, label, None

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return df.withColumn("_x", array_to_vector(F.transform(self.view, lambda v: v.cast("double"))))

    def fit(self, df: DataFrame) -> ArtifactClassifier:
        from pyspark.ml.classification import LogisticRegression

        self.model = LogisticRegression(featuresCol="_x", labelCol=self.label, predictionCol="predicted", regParam=1e-3, maxIter=50).fit(self._vectors(df))
        return self

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._vectors(df)).withColumn("predicted", F.col("predicted").cast("int")).drop("_x", "rawPrediction", "probability")
