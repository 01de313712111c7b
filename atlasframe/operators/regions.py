"""Counts, volumes, medians and roll-ups by region, side and segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.clean import exclude_divisions, side_of
from atlasframe.operators.quantiles import group_quantiles


def _filled(stats: DataFrame, regions: DataFrame, by: Sequence[str], sides: Sequence[str], cols: Sequence[str], fill) -> DataFrame:
    """A row for each group, listed region and side, absent ones filled."""
    frame = regions.select("region_id").distinct()
    if sides:
        frame = frame.withColumn("side", F.explode(F.array(*map(F.lit, sides))))
    keys = ["region_id", *(["side"] if sides else [])]
    # An atlas has some thousand regions: a group's rows, and the list of all regions, are
    # one row each, so the statistics are computed once.
    frame = F.broadcast(frame.agg(F.collect_list(F.struct(*keys)).alias("_frame")))
    own = stats.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*keys), F.struct(*cols)))).alias("_own"))
    rows = own.join(frame, F.lit(True)).select(*by, F.explode("_frame").alias("_k"), "_own").select(*by, "_k.*", F.col("_own")[F.col("_k")].alias("_v"))
    value = lambda c: F.col("_v")[c]
    return rows.select(*by, *keys, *((value(c) if fill is None else F.coalesce(value(c), F.lit(fill))).alias(c) for c in cols))


def region_counts(points: DataFrame, regions: DataFrame, nz: int, by: Sequence[str] = ("sample_id", "channel"), fill: int | None = 0) -> DataFrame:
    """Labelled points per region and side, of the listed regions, zero-filled."""
    counts = points.withColumn("side", side_of("z", nz)).groupBy(*by, "region_id", "side").agg(F.count("*").alias("n"))
    return _filled(counts, regions, by, ["L", "R"], ["n"], fill)


def region_volumes(labels: DataFrame, voxel_mm: float, nz: int | None = None) -> DataFrame:
    """Volume of each region, by side if nz is given."""
    keys = ["region_id", *(["side"] if nz else [])]
    rows = labels.withColumn("side", side_of("z", nz)) if nz else labels
    return rows.groupBy(*keys).agg((F.count("*") * voxel_mm**3).alias("volume"))


def region_medians(voxels: DataFrame, labels: DataFrame, nz: int, by: Sequence[str] = ("sample_id", "channel"), regions: DataFrame | None = None, fill: float | None = 0.0) -> DataFrame:
    """Median intensity per region and side; that of region 0 is the side's background level."""
    rows = voxels.join(labels, ["y", "x", "z"]).withColumn("side", side_of("z", nz))
    stats = group_quantiles(rows, [*by, "region_id", "side"], "value", {"median": 0.5})
    return _filled(stats, labels if regions is None else regions, by, ["L", "R"], ["median"], fill)


def region_relative(medians: DataFrame, by: Sequence[str] = ("sample_id", "channel", "side")) -> DataFrame:
    """(median - background) / background, background being region 0's median; 0 where that is 0."""
    base = medians.where("region_id = 0").select(*by, F.col("median").alias("_b"))
    ratio = F.when(F.col("_b") != 0, (F.col("median") - F.col("_b")) / F.col("_b")).otherwise(0.0)
    return medians.join(base, list(by)).withColumn("relative", ratio).drop("_b")


def segment_join(rows: DataFrame, segments: DataFrame, axis: str = "z") -> DataFrame:
    """Axis position to segment: [start, end), the last one closed. Positions and
    segments meet by stretches of the axis as long as a segment is on average: an
    equi-join for any number of segments."""
    last, width = segments.agg(F.max("end_z"), F.avg(F.col("end_z") - F.col("start_z"))).first()
    if not width:
        return rows.withColumn("segment", F.lit(None).cast("string")).limit(0)
    at = lambda c: F.floor(F.col(c) / float(width)).cast("long")
    s = segments.select("segment", "start_z", "end_z", F.explode(F.sequence(at("start_z"), at("end_z"))).alias("_at"))
    inside = (F.col(axis) >= F.col("start_z")) & ((F.col(axis) < F.col("end_z")) | ((F.col(axis) == F.lit(last)) & (F.col("end_z") == F.lit(last))))
    return rows.withColumn("_at", at(axis)).join(s, "_at").where(inside).drop("start_z", "end_z", "_at")


def region_segment_medians(voxels: DataFrame, labels: DataFrame, segments: DataFrame, by: Sequence[str] = ("sample_id", "channel")) -> DataFrame:
    """Median by region and segment, and relative to region 0 of that segment."""
    rows = segment_join(voxels.join(labels, ["y", "x", "z"]), segments)
    med = group_quantiles(rows, [*by, "region_id", "segment"], "value", {"median": 0.5})
    base = med.where("region_id = 0").select(*by, "segment", F.col("median").alias("_b"))
    return med.join(base, [*by, "segment"], "left").withColumn("relative", F.when(F.col("_b") != 0, (F.col("median") - F.col("_b")) / F.col("_b"))).drop("_b")


def region_segment_volumes(labels: DataFrame, segments: DataFrame) -> DataFrame:
    """Voxels by region and segment and their share of the region."""
    n = segment_join(labels, segments).groupBy("region_id", "segment").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("region_id")))


def rollup_regions(stats: DataFrame, terms: DataFrame, level: str = "structure", by: Sequence[str] = ("sample_id", "channel"), skip: bool = True) -> DataFrame:
    """Leaf rows (region_id, side, n, volume, signal) to a coarser term set: counts and
    volumes are the sides' means summed over leaves, the signal is the
    volume-weighted mean of those that have one; with the parent division."""
    names = terms.where(F.col("term_set") == level).select("region_id", F.col("name"))
    parent = terms.where("term_set = 'division'").select("region_id", F.col("name").alias("division"))
    leaf = stats.groupBy(*by, "region_id").agg(F.avg("n").alias("n"), F.sum("volume").alias("volume"), F.avg("signal").alias("signal"))
    rows = leaf.join(names, "region_id").join(parent, "region_id", "left")
    weight = F.when(F.col("signal").isNotNull(), F.col("volume"))
    out = rows.groupBy(*by, "name").agg(F.sum("n").alias("n"), (F.sum("volume") / 2).alias("volume"), F.when(F.sum(weight) > 0, F.sum(F.col("signal") * weight) / F.sum(weight)).alias("signal"), F.min("division").alias("division"))
    return exclude_divisions(out, "division") if skip else out


def descendants(tree: DataFrame, checkpoint=None) -> DataFrame:
    """(id, descendant) for every node, itself included, over parent_id and, where
    the tree has it, the numbers in children (text or number). Paths double in
    every round, so a tree of depth d takes log d joins; cycles end."""
    cut = checkpoint or (lambda df: df.checkpoint())
    edges = tree.where("parent_id is not null").select(F.col("parent_id").alias("id"), F.col("id").alias("descendant"))
    if "children" in tree.columns:
        kids = tree.select("id", F.explode(F.regexp_extract_all(F.col("children").cast("string"), F.lit(r"(\d+)"))).alias("descendant"))
        edges = edges.unionByName(kids.select("id", F.col("descendant").cast(tree.schema["id"].dataType).alias("descendant")))
    nodes = tree.select("id", F.col("id").alias("descendant"))
    now = cut(edges.unionByName(nodes).distinct())
    n = now.count()
    while True:
        step = now.join(now.select(F.col("id").alias("descendant"), F.col("descendant").alias("_d")), "descendant").select("id", F.col("_d").alias("descendant"))
        now = cut(now.unionByName(step).distinct())
        if (m := now.count()) == n:
            return now
        n = m


def path_to_levels(tree: DataFrame, path: str = "path") -> DataFrame:
    """(id, level, ancestor) of /1/2/3/ paths."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return tree.select("id", F.posexplode(parts).alias("level", "ancestor")).withColumns({"level": F.col("level") + 1, "ancestor": F.col("ancestor").cast("long")})


def rollup_cord(stats: DataFrame, tree: DataFrame, targets: Sequence[int], by: Sequence[str] = ("sample_id", "segment"), checkpoint=None) -> DataFrame:
    """Leaf rows (region_id, volume, signal) summed up to target regions through their descendants."""
    under = descendants(tree, checkpoint).where(F.col("id").isin(list(targets))).select(F.col("id").alias("target"), F.col("descendant").alias("region_id"))
    w = F.when(F.col("signal").isNotNull(), F.col("volume"))
    return stats.join(under, "region_id").groupBy(*by, "target").agg(F.sum("volume").alias("volume"), F.when(F.sum(w) > 0, F.sum(F.col("signal") * w) / F.sum(w)).alias("signal"))


def _held_in(inner: DataFrame, outer: DataFrame, longer: bool) -> DataFrame:
    """(_i, _o): distinct names _i of inner that lie in names _o of outer, in longer ones only
    or in equal ones as well. A name is cut to its parts of the lengths that inner
    has, and parts meet equal names: an equi-join, nothing is compared with all others."""
    sizes = F.broadcast(inner.select(F.length("_i").alias("_s")).distinct().agg(F.collect_list("_s").alias("_all")))  # a single row
    rows = outer.join(sizes, F.lit(True)).select("_o", F.explode("_all").alias("_s"))
    rows = rows.where(F.col("_s") < F.length("_o") if longer else F.col("_s") <= F.length("_o"))
    parts = rows.select("_o", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_o") - F.col("_s") + 1), lambda i: F.substring(F.col("_o"), i, F.col("_s"))))).alias("_i"))
    # Spark's size check does not count the parts.
    return parts.join(inner.select("_i").hint("merge"), "_i")


def join_by_name_unique(terms: DataFrame, external: DataFrame, name: str = "name", key: str = "ext_name", value: str = "ext_value") -> DataFrame:
    """External rows whose name (lower case, no commas) holds that of a term or is
    held by it, anywhere in it, where exactly one does; else the value is missing.
    Empty names hold and are held by none. Equal names of a side are one, with the
    number of their rows; a name of a term gets the number of all that it meets."""
    clean = lambda c: F.trim(F.translate(F.lower(c), ",", ""))
    t = terms.select("region_id", clean(name).alias("_t")).where("_t <> ''").distinct()
    e = external.select(key, value, clean(key).alias("_e")).where("_e <> ''").distinct().groupBy("_e").agg(F.count("*").alias("_c"), F.min(value).alias("_v"))
    ours, theirs = t.select("_t").distinct(), e.select("_e")
    held = _held_in(ours.withColumnRenamed("_t", "_i"), theirs.withColumnRenamed("_e", "_o"), False).toDF("_t", "_e")
    holds = _held_in(theirs.withColumnRenamed("_e", "_i"), ours.withColumnRenamed("_t", "_o"), True).toDF("_e", "_t")
    met = held.unionByName(holds).join(e, "_e").groupBy("_t").agg(F.sum("_c").alias("_c"), F.min("_e").alias("_e"), F.min("_v").alias("_v"))
    # A region of several names: each must meet one row alone, and all of them the same.
    one = t.join(met, "_t").groupBy("region_id").agg(F.max("_c").alias("_c"), F.min("_e").alias("_a"), F.max("_e").alias("_b"), F.min("_v").alias(value))
    one = one.where("_c = 1 and _a = _b").select("region_id", value)
    return terms.select("region_id", name).join(one, "region_id", "left")


def midline_distance(labels: DataFrame, nz: int, voxel_mm: float) -> DataFrame:
    """Median lateral place of each region's right half, as mm from the midline."""
    right = labels.where(F.col("z") <= nz / 2)
    return group_quantiles(right, ["region_id"], "z", {"_m": 0.5}).select("region_id", ((nz / 2 - F.col("_m")) * voxel_mm).alias("distance"))


def regions_under_implant(pixels: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Regions under each implant with their share of the pixels inside its circle."""
    inside = pixels.where("region_id > 0 and g1 * g1 + g2 * g2 <= radius * radius")
    n = inside.groupBy("implant_id", "region_id").agg(F.count("*").alias("n"))
    out = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("implant_id")))
    return out if terms is None else out.join(terms.where("term_set = 'substructure'").select("region_id", "name"), "region_id", "left")


def downsample(voxels: DataFrame, factor: Sequence[int], by: Sequence[str] = ("sample_id", "channel"), how: str = "mean") -> DataFrame:
    """Blocks of factor voxels (y, x, z) by their mean, or their most frequent value for labels."""
    block = [F.ceil(F.col(c) / f).cast("int").alias(c) for c, f in zip("yxz", factor)]
    value = F.avg("value") if how == "mean" else F.mode("value", True)
    return voxels.groupBy(*by, *block).agg(value.alias("value"))


def density_table(stats: DataFrame) -> DataFrame:
    """Counts per volume, as share of the sample's total, by division and overall ('All')."""
    total = stats.groupBy("sample_id").agg(F.sum("n").alias("_n"))
    rows = stats.join(total, "sample_id")
    parts = rows.select("sample_id", F.explode(F.array("division", F.lit("All"))).alias("division"), "n", "volume", "_n")
    return parts.groupBy("sample_id", "division").agg((F.sum("n") / F.sum("volume")).alias("density"), (F.sum("n") / F.max("_n")).alias("share"))


def distinct_regions(labels: DataFrame) -> DataFrame:
    return labels.select("region_id").distinct()


def except_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def intersect_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_semi")
