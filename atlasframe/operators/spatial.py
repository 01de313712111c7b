"""Distance joins by grid blocking: points meet only those of neighbouring cells."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _cells(df: DataFrame, cols: Sequence[str], width: float, spread: bool) -> DataFrame:
    """Adds _cell; spread rows go to all neighbouring cells as well."""
    base = [F.floor(F.col(c) / width) for c in cols]
    if not spread:
        return df.withColumn("_cell", F.array(*base))
    return df.withColumn("_cell", F.explode(F.array(*(F.array(*(b + s for b, s in zip(base, step))) for step in product((-1, 0, 1), repeat=len(cols))))))


def _distance(cols: Sequence[str]) -> Column:
    return F.sqrt(sum(((F.col(f"_l{c}") - F.col(f"_r{c}")) ** 2 for c in cols), F.lit(0.0)))


def pairs_within(left: DataFrame, right: DataFrame, d: float, left_id: str, right_id: str, cols: Sequence[str] = XYZ) -> DataFrame:
    """(left_id, right_id as _right, distance) of all pairs at most d apart; at d = 0
    the pairs of equal places, and none below. Rows with a null or NaN have no place."""
    if d < 0:
        return left.join(right.select(F.col(right_id).alias("_right")), F.lit(False)).select(left_id, "_right", F.lit(0.0).alias("distance"))
    if d == 0:
        # 0.0 is added so that zeros of both signs are one place.
        a = left.select(left_id, *((F.col(c).cast("double") + 0.0).alias(f"_{c}") for c in cols)).where(" and ".join(f"_{c} - _{c} = 0" for c in cols))
        b = right.select(F.col(right_id).alias("_right"), *((F.col(c).cast("double") + 0.0).alias(f"_{c}") for c in cols))
        return a.join(b, [f"_{c}" for c in cols]).select(left_id, "_right", F.lit(0.0).alias("distance"))
    a = _cells(left.select(left_id, *(F.col(c).alias(f"_l{c}") for c in cols)), [f"_l{c}" for c in cols], d, True)
    b = _cells(right.select(F.col(right_id).alias("_right"), *(F.col(c).alias(f"_r{c}") for c in cols)), [f"_r{c}" for c in cols], d, False)
    # Spark's size check does not count the rows of the neighbouring cells, so neither side may be broadcast.
    return a.join(b.hint("merge"), "_cell").withColumn("distance", _distance(cols)).where(F.col("distance") <= d).select(left_id, "_right", "distance")


def _finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(" and ".join(f"{c} - {c} = 0" for c in cols))


def any_within(left: DataFrame, right: DataFrame, d: float, left_id: str, cols: Sequence[str] = XYZ) -> DataFrame:
    """Ids of the left points that have a right point at most d away. Equal places of a side are
    asked once, and no pair leaves the join: a place ends at its first hit, and one whose
    cube (of a diagonal below d) holds a right point needs none."""
    if d <= 0:
        return pairs_within(left, right.withColumn("_rid", F.lit(0)), d, left_id, "_rid", cols).select(left_id).distinct()
    width = d / len(cols) ** 0.5 * (1 - 1e-9)
    cube = F.array(*(F.floor(F.col(c) / width) for c in cols)).alias("_cube")
    places, others = (_finite(df.select(*cols), cols).distinct() for df in (left, right))
    full = others.select(cube).distinct()
    placed = places.select(*cols, cube)
    sure = placed.join(full, "_cube", "left_semi").select(*cols)
    open_ = placed.join(full, "_cube", "left_anti").select(F.struct(*cols).alias("_place"), *(F.col(c).alias(f"_l{c}") for c in cols))
    a = _cells(open_, [f"_l{c}" for c in cols], d, True)
    b = _cells(others.select(*(F.col(c).alias(f"_r{c}") for c in cols)), [f"_r{c}" for c in cols], d, False).withColumnRenamed("_cell", "_rcell")
    hit = a.join(b.hint("merge"), (F.col("_cell") == F.col("_rcell")) & (_distance(cols) <= d), "left_semi").select("_place.*")
    return left.select(left_id, *cols).join(sure.unionByName(hit).distinct(), list(cols), "left_semi").select(left_id).distinct()


def knn_join(left: DataFrame, right: DataFrame, k: int, width: float, left_id: str, right_id: str, cols: Sequence[str] = XYZ, same: bool = True, rounds: int = 40, checkpoint=None) -> DataFrame:
    """(left_id, right_id as _right, distance, rank): the k nearest right points.

    Equal places of a side are one: only places meet, and of the copies at a right
    place the k smallest ids can be an answer. A left place's answer is final once k
    right points lie within the cell width; the rest are asked again with doubled
    width, over ever fewer places, until the width spans the data and everything left
    is final. Ties by right id. same=False leaves out pairs of one id (a cloud with
    itself, an id a point). Rows with a null, NaN or infinite coordinate take no part;
    points undecided after `rounds` are an error."""
    cut = checkpoint or _cut
    left, right = (_finite(df.select(i, *cols), cols) for df, i in ((left, left_id), (right, right_id)))
    most = k if same else k + 1  # one of them may be the point itself
    place = F.struct(*(F.col(c) for c in cols))
    copy = Window.partitionBy(*cols).orderBy(right_id)
    ids = cut(right.withColumn("_n", F.row_number().over(copy)).where(F.col("_n") <= most).select(place.alias("_at"), F.col(right_id).alias("_right")))
    places = ids.select("_at").distinct().select("_at", "_at.*")
    todo = cut(left.select(*cols).distinct().select(place.alias("_place"), *cols))
    ends = [df.agg(*(f(c).alias(f"{n}{c}") for c in cols for n, f in (("a", F.min), ("b", F.max)))).first() for df in (places, todo)]
    reach = 0.0
    if ends[0][0] is not None and ends[1][0] is not None:
        reach = sum((max(e[f"b{c}"] for e in ends) - min(e[f"a{c}"] for e in ends)) ** 2 for c in cols) ** 0.5
    ranked, near_places = Window.partitionBy("_place").orderBy("distance", "_right"), Window.partitionBy("_place").orderBy("distance")
    out = None
    for _ in range(rounds):
        near = pairs_within(todo, places, width, "_place", "_at", cols)
        # Each place has an id or more: those of the first `most` places, with ties, are enough.
        near = near.withColumn("rank", F.rank().over(near_places)).where(F.col("rank") <= most).select("_place", F.col("_right").alias("_at"), "distance")
        near = near.join(ids, "_at").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most).select("_place", "_right", "distance", "rank")
        last = width >= reach
        near = near if last else cut(near)  # what follows reads it three times
        full = near.groupBy("_place").agg(F.count("*").alias("_n")).where(F.col("_n") >= most).select("_place")
        done = near if last else near.join(full, "_place", "left_semi")
        out = done if out is None else out.unionByName(done)
        if not last:
            todo = cut(todo.join(full, "_place", "left_anti"))
            last = todo.isEmpty()
        if last:
            break
        width *= 2
    else:
        raise ValueError(f"undecided after {rounds} rounds: start with a greater width than {width / 2**rounds}")
    found = left.select(left_id, place.alias("_place")).join(out.select("_place", "_right", "distance"), "_place")
    found = found if same else found.where(F.col(left_id) != F.col("_right"))
    mine = Window.partitionBy(left_id).orderBy("distance", "_right")
    return found.select(left_id, "_right", "distance", F.row_number().over(mine).alias("rank")).where(F.col("rank") <= k)


def match_clouds(sample: DataFrame, atlas: DataFrame, far: float = 50.0, near: float = 20.0, k: int = 40, width: float = 10.0) -> DataFrame:
    """Pairs (point_id, _right, distance): points far from the other cloud go, then a
    sample point is matched if its nearest is closer than near and the median of its
    k nearest distances below far."""
    s = sample.join(any_within(sample, atlas, far, "point_id"), "point_id", "left_semi")
    a = atlas.join(any_within(atlas, sample, far, "point_id"), "point_id", "left_semi")
    near_all = knn_join(s, a, k, width, "point_id", "point_id")
    median = near_all.groupBy("point_id").agg(F.percentile("distance", F.lit(0.5)).alias("_m"))
    return near_all.where(F.col("rank") == 1).join(median, "point_id").where((F.col("distance") < near) & (F.col("_m") < far)).select("point_id", "_right", "distance")


def anti_join_within(auto: DataFrame, user: DataFrame, d: float, auto_id: str = "point_id", cols: Sequence[str] = XYZ) -> DataFrame:
    """Points farther than d from every user point."""
    return auto.join(any_within(auto, user, d, auto_id, cols), auto_id, "left_anti")


def nearest_slice(samples: DataFrame, atlas: DataFrame, pos: str = "pos", group: str | None = None, blocks: int = 4096) -> DataFrame:
    """For each sample position the nearest atlas position, the smaller of ties; null
    for a missing position or a group without an atlas position. Samples before the
    first or behind the last position of their group are answered by these two. For
    the others the axis is cut into blocks. Within one, a sorted pass takes the last atlas position before and
    the first after; those beyond the block come from a table of the blocks' ends."""
    keys = [group] if group else []
    low, high = atlas.agg(F.min(F.col(pos).cast("double")), F.max(F.col(pos).cast("double"))).first()
    if low is None:
        return samples.withColumn("nearest", F.lit(None).cast("double"))
    part = F.least(F.greatest(F.floor((F.col("_p") - low) / ((high - low) or 1.0) * blocks), F.lit(0)), F.lit(blocks - 1)).alias("_block")
    a = atlas.select(*keys, F.col(pos).cast("double").alias("_p")).where("_p is not null").select(*keys, "_p", part, F.col("_p").alias("_a"))
    all_samples = samples.select(*keys, F.col(pos).cast("double").alias("_p"), F.struct(*samples.columns).alias("_s"))
    if keys:
        all_samples = all_samples.join(a.groupBy(*keys).agg(F.min("_a").alias("_low"), F.max("_a").alias("_high")), keys, "left")
    else:
        all_samples = all_samples.withColumns({"_low": F.lit(low), "_high": F.lit(high)})
    inner = F.coalesce((F.col("_p") > F.col("_low")) & (F.col("_p") < F.col("_high")), F.lit(False))
    ended = all_samples.where(~inner).select("_s.*", F.when(F.col("_p") <= F.col("_low"), F.col("_low")).when(F.col("_p") >= F.col("_high"), F.col("_high")).alias("nearest"))
    s = all_samples.where(inner).select(*keys, "_p", part, F.lit(None).cast("double").alias("_a"), "_s")
    # One row for each block that has anything.
    ends = a.select(*keys, "_block", "_a").unionByName(s.select(*keys, "_block", "_a").distinct()).groupBy(*keys, "_block").agg(F.min("_a").alias("_first"), F.max("_a").alias("_last"))
    # Both ways from the start of a window: a frame to its end is gone through anew for every row.
    sofar = lambda *order, upto=0: Window.partitionBy(*order[0]).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, upto)
    ends = ends.select(*keys, "_block", F.last("_last", True).over(sofar(keys, "_block", upto=-1)).alias("_below"), F.last("_first", True).over(sofar(keys, F.desc("_block"), upto=-1)).alias("_above"))
    both = s.unionByName(a.withColumn("_s", F.lit(None).cast(s.schema["_s"].dataType)))
    before = F.last("_a", True).over(sofar([*keys, "_block"], "_p", F.col("_a").isNull()))
    after = F.last("_a", True).over(sofar([*keys, "_block"], F.desc("_p"), F.col("_a").isNull().desc()))
    rows = both.withColumns({"_b": before, "_f": after}).where("_s is not null").join(ends, [*keys, "_block"], "left")
    rows = rows.withColumns({"_b": F.coalesce("_b", "_below"), "_f": F.coalesce("_f", "_above")})
    near = F.when(F.col("_p").isNull(), None).when(F.col("_b").isNull(), F.col("_f")).when(F.col("_f").isNull(), F.col("_b")).when(F.col("_p") - F.col("_b") <= F.col("_f") - F.col("_p"), F.col("_b")).otherwise(F.col("_f"))
    return rows.select("_s.*", near.alias("nearest")).unionByName(ended)


def slab_join(points: DataFrame, slices: DataFrame, half: float, axis: str = "z", pos: str = "pos") -> DataFrame:
    """Points with |axis - pos| < half of each slice."""
    p = points.withColumn("_b", F.explode(F.array(*(F.floor(F.col(axis) / half) + s for s in (-1, 0, 1)))))
    return p.join(slices.withColumn("_b", F.floor(F.col(pos) / half)), "_b").where(F.abs(F.col(axis) - F.col(pos)) < half).drop("_b")


def grid_downsample(points: DataFrame, width: float, by: Sequence[str] = (), cols: Sequence[str] = XYZ) -> DataFrame:
    """One mean point for each occupied box of a grid, with the number of points."""
    box = [F.floor(F.col(c) / width).alias(f"b{c}") for c in cols]
    return points.groupBy(*by, *box).agg(*(F.avg(c).alias(c) for c in cols), F.count("*").alias("n")).drop(*(f"b{c}" for c in cols))


def _cut(df: DataFrame) -> DataFrame:
    """df without lineage: a Parquet table in the shared folder if there is one. A
    checkpoint keeps the partitioning and ordering of its plan, which grow from round to round."""
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return df.checkpoint()
    path = f"{shared.rstrip('/')}/points-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _done(df: DataFrame) -> None:
    """Delete the table behind a _cut() that nothing reads any more; a checkpoint is Spark's to clean."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("points-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _heads(points: DataFrame, key: str, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Points folded by equal coordinates: (key, cols) of the smallest key of each
    place, and (key, _head) of the others. Points without a place (null, NaN) are in neither."""
    placed = points.select(key, *cols)
    for c in cols:
        placed = placed.where(F.col(c) - F.col(c) == 0)
    heads = placed.groupBy(*cols).agg(F.min(key).alias("_head"))
    copies = placed.join(heads, list(cols)).where(F.col(key) > F.col("_head")).select(key, "_head")
    return heads.select(F.col("_head").alias(key), *cols), copies


def _greedy(key: np.ndarray, place: np.ndarray, state: np.ndarray, own: np.ndarray, d: float) -> np.ndarray:
    """States after one pass in order of key. state: 1 kept, 0 undecided; own: whether
    the point is decided here. A point goes (-1) if one kept before it is closer than
    d, stays undecided if an undecided one is, and is kept otherwise."""
    order = np.argsort(key, kind="stable")
    cells = np.floor(place / d).astype(np.int64)
    near = list(product((-1, 0, 1), repeat=place.shape[1]))
    known: dict[tuple, tuple[list, list]] = {}
    out, limit = state.copy(), d * d
    places, cell_of = place.tolist(), cells.tolist()
    for i in order.tolist():
        p, c = places[i], cell_of[i]
        if own[i] and state[i] == 0:
            around = [known[k] for s in near if (k := tuple(a + b for a, b in zip(c, s))) in known]
            close = lambda q: sum((a - b) ** 2 for a, b in zip(p, q)) < limit  # noqa: B023, E731
            out[i] = -1 if any(close(q) for kept, _ in around for q in kept) else 0 if any(close(q) for _, open_ in around for q in open_) else 1
        if out[i] >= 0:
            known.setdefault(tuple(c), ([], []))[0 if out[i] else 1].append(p)
    return out


def thin_points(points: DataFrame, d: float, order: str = "point_id", cols: Sequence[str] = XYZ, checkpoint=None, tile_points: int = 50_000) -> DataFrame:
    """Greedy thinning in order: a point stays if it is at least d from all that stay
    before it; the same points as the loop's, whatever the partitioning.

    Space is cut into tiles of about tile_points undecided points (and not less than
    2 d wide). In one round each tile goes through its points in order, with the kept
    and undecided ones within d of its border: a point goes if one kept before it is
    near, waits if an undecided one of another tile, or one that waits, is, and stays
    otherwise. The next round takes what waits, in tiles as wide as that allows, so a
    chain of any length inside a tile takes one round. Of equal places only the
    first can stay: what removes it removes the others as well; so can repeated rows
    of one id only stay or go together. Points without a place (null, NaN, infinite)
    stay.
    """
    cut = checkpoint or _cut
    if d <= 0:
        return points
    heads, copies = _heads(points, order, cols)
    kind = points.schema[order].dataType.simpleString()
    placed = [F.col(c).cast("double").alias(f"_{c}") for c in cols]
    now = cut(heads.select(F.col(order).alias("_k"), *placed, F.lit(0).alias("_s")))
    names = [f"_{c}" for c in cols]
    tile = [f"_t{i}" for i in range(len(cols))]
    ends = now.agg(*(f(c) for c in names for f in (F.min, F.max))).first()
    origin = {n: ends[2 * i] or 0.0 for i, n in enumerate(names)}
    width = max(2 * d, *((ends[2 * i + 1] or 0.0) - origin[n] for i, n in enumerate(names))) * 1.001
    at = lambda n, width, shift=0.0: F.floor((F.col(n) - origin[n] + shift) / width)
    schema = f"_k {kind}, " + ", ".join(f"{n} double" for n in names) + ", _s int"

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["_own"].to_numpy(bool)
        pdf = pdf.assign(_s=_greedy(pdf["_k"].to_numpy(), pdf[names].to_numpy(float), pdf["_s"].to_numpy(), own, d))
        return pdf.loc[own, ["_k", *names, "_s"]]

    def fits(rows: DataFrame, width: float) -> bool:
        most = rows.groupBy(*(at(n, width) for n in names)).count().agg(F.max("count")).first()[0]
        return (most or 0) <= tile_points

    while not (todo := now.where("_s = 0")).isEmpty():
        while width / 2 >= 2 * d and not fits(todo, width):
            width /= 2
        base = [at(n, width).alias(t) for n, t in zip(names, tile)]
        busy = todo.select(*base).distinct()
        spread = now.where("_s >= 0").withColumn("_base", F.array(*(at(n, width) for n in names)))
        for n, t in zip(names, tile):
            spread = spread.withColumn(t, F.explode(F.sequence(at(n, width, -d), at(n, width, d))))
        spread = spread.withColumn("_own", (F.col("_base") == F.array(*tile)) & (F.col("_s") == 0))
        # An own point comes once: in its base tile. Kept points are needed where something waits.
        found = spread.join(busy, tile, "left_semi").groupBy(*tile).applyInPandas(decide, schema)
        after = cut(now.where("_s <> 0").unionByName(found))
        _done(now)
        now = after
        if fits(now.where("_s = 0"), 2 * width):
            width *= 2
    gone = now.where("_s < 0").select(F.col("_k").alias(order))
    lost = copies.select(order).unionByName(gone)
    return points.join(lost.distinct(), order, "left_anti")


def augment_controls(user: DataFrame, auto: DataFrame, d: float, cols: Sequence[str] = XYZ) -> DataFrame:
    """User points with weight 1 and, thinned and away from them, auto points; with
    weight 0.5 for these where there is no user point."""
    weight = 0.5 if user.isEmpty() else 1.0
    kept = thin_points(anti_join_within(auto, user, d, cols=cols), d, cols=cols)
    return user.withColumn("weight", F.lit(1.0)).unionByName(kept.withColumn("weight", F.lit(weight)))


def keep_by_distance(points: DataFrame, share: float = 0.8, key: str = "point_id", cols: Sequence[str] = XYZ) -> DataFrame:
    """The share of points with the largest Mahalanobis distance from the mean."""
    moments = points.agg(*(F.avg(c).alias(f"m{c}") for c in cols), *(F.covar_samp(a, b).alias(f"{a}{b}") for a in cols for b in cols), F.count("*").alias("n")).first()
    inverse = np.linalg.inv(np.array([[moments[f"{a}{b}"] for b in cols] for a in cols]))
    diff = [F.col(c) - moments[f"m{c}"] for c in cols]
    dist = sum((diff[i] * diff[k] * float(inverse[i, k]) for i in range(len(cols)) for k in range(len(cols))), F.lit(0.0))
    keep = int(share * moments["n"] + 1e-9)
    # A range sort over the cluster and a top-n, not a window over one partition.
    return points.withColumn("mahalanobis", dist).orderBy(F.col("mahalanobis").desc(), key).limit(keep)


def denoise_points(points: DataFrame, k: int, width: float, key: str = "point_id", cols: Sequence[str] = XYZ, sd: float = 1.0) -> DataFrame:
    """Points whose mean distance to their k nearest is at most sd standard deviations above the mean of all."""
    mean = knn_join(points, points, k, width, key, key, cols, same=False).groupBy(key).agg(F.avg("distance").alias("_d"))
    limit = F.broadcast(mean.agg((F.avg("_d") + sd * F.stddev_samp("_d")).alias("_limit")))  # a single row
    return points.join(mean.join(limit, F.col("_d") <= F.col("_limit")).select(key), key, "left_semi")


def link_components(edges: DataFrame, nodes: DataFrame, key: str, checkpoint=None) -> DataFrame:
    """(key, component): the smallest key reachable over edges (a, b). Labels are
    lowered to the least of the neighbours' and jump along their own labels, so the
    rounds grow with the logarithm of a chain's length; each round is cut. Labels of many
    rows are small files, which Spark would broadcast: the joins are merged."""
    cut = checkpoint or _cut
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(nodes.select(F.col(key).alias("id"), F.col(key).alias("c")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("c").alias("nc")).hint("merge"), "b").groupBy("a").agg(F.min("nc").alias("nc"))
        new = label.join(near.hint("merge"), label["id"] == near["a"], "left").select("id", F.least("c", F.coalesce("nc", "c")).alias("c"), F.col("c").alias("old"))
        jump = new.select(F.col("id").alias("j"), F.col("c").alias("jc"))
        new = cut(new.join(jump.hint("merge"), new["c"] == jump["j"]).select("id", F.least("c", "jc").alias("c"), "old"))
        if new.where("c <> old").isEmpty():
            return new.select(F.col("id").alias(key), F.col("c").alias("component"))
        label = new.select("id", "c")


def cluster_points(points: DataFrame, d: float, key: str = "point_id", cols: Sequence[str] = XYZ, checkpoint=None) -> DataFrame:
    """Single-linkage clusters: points closer than d are of one component. Equal
    places are one, and places of one cube whose diagonal is less than d are linked
    through the smallest key; pairs are compared only across cubes."""
    if d <= 0:
        return points.withColumn("component", F.col(key))
    heads, copies = _heads(points, key, cols)
    # A little less than d / sqrt(n), so that rounding never links points d apart.
    width = d / len(cols) ** 0.5 * (1 - 1e-9)
    heads = heads.withColumn("_cube", F.array(*(F.floor(F.col(c) / width) for c in cols)))
    cut = checkpoint or _cut
    heads = cut(heads)
    first = heads.groupBy("_cube").agg(F.min(key).alias("a"))
    inner = heads.join(first, "_cube").where(F.col(key) > F.col("a")).select("a", F.col(key).alias("b"))
    pairs = pairs_within(heads, heads, d, key, key, cols).where((F.col("distance") < d) & (F.col(key) < F.col("_right")))
    cube = heads.select(F.col(key).alias("_k"), "_cube").join(first, "_cube").select("_k", "a")
    # One link for each pair of cubes that have a pair of places closer than d.
    across = pairs.join(cube.select(F.col("_k").alias(key), "a"), key).join(cube.select(F.col("_k").alias("_right"), F.col("a").alias("b")), "_right")
    across = across.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = link_components(inner.unionByName(across), heads, key, cut)
    others = copies.join(found.withColumnRenamed(key, "_head"), "_head").select(key, "component")
    return points.join(found.unionByName(others), key, "left").withColumn("component", F.coalesce("component", key))
