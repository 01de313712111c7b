"""Ordered series: slices, paths and angles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from atlasframe.functions import matmul
from atlasframe.operators.quantiles import group_quantiles


def moving_median(series: DataFrame, r: int, by: Sequence[str], order: str, value: str, out: str = "median") -> DataFrame:
    """Median of the rows at most r places away (a frame holds 2 r + 1 values)."""
    frame = F.array_sort(F.collect_list(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-r, r)))
    n = F.size(frame)
    return series.withColumn(out, (F.get(frame, F.floor((n - 1) / 2).cast("int")) + F.get(frame, F.floor(n / 2).cast("int"))) / 2)


def robust_outliers(points: DataFrame, r: int, by: Sequence[str], order: str, value: str, limit: float = 3.0) -> DataFrame:
    """Adds outlier: farther from the moving median than limit robust SD of the group's distances to it."""
    rows = moving_median(points, r, by, order, value, "_m").withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    sd = group_quantiles(rows, by, F.col("_d") * 1.4826, {"_sd": 0.5})
    return rows.join(sd, list(by)).withColumn("outlier", F.col("_d") > limit * F.col("_sd")).drop("_m", "_d", "_sd")


def _around(by: Sequence[str], order: str, value: str):
    known = F.col(value).isNotNull()
    place = F.when(known, F.col(order))
    # Both from the start of a window: a frame to its end is gone through anew for every row.
    back, ahead = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(order), F.desc(order)))
    return F.last(value, True).over(back), F.last(place, True).over(back), F.last(value, True).over(ahead), F.last(place, True).over(ahead)


def fill_nearest(series: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Missing values from the nearest known one, the earlier of ties; none beyond the ends."""
    v0, p0, v1, p1 = _around(by, order, value)
    near = F.when(F.col(order) - p0 <= p1 - F.col(order), v0).otherwise(v1)
    return series.withColumn(value, F.when(p0.isNotNull() & p1.isNotNull(), near))


def interpolate_slices(series: DataFrame, by: Sequence[str], order: str, value: str, least: int = 4) -> DataFrame:
    """Missing values by straight lines between known ones, along the nearest two
    beyond the ends; groups with fewer than least known values stay as they are."""
    n = F.count(value).over(Window.partitionBy(*by))
    v0, p0, v1, p1 = _around(by, order, value)
    # The first two and the last two known values of each group: four rows at most.
    w = Window.partitionBy(*by)
    known = series.where(F.col(value).isNotNull()).select(*by, F.struct(F.col(order).cast("double").alias("p"), F.col(value).cast("double").alias("v")).alias("_k"))
    known = known.withColumns({"_r": F.row_number().over(w.orderBy("_k")), "_l": F.row_number().over(w.orderBy(F.col("_k").desc()))}).where("_r <= 2 or _l <= 2")
    known = known.groupBy(*by).agg(F.sort_array(F.collect_list("_k")).alias("_k"))
    rows = series.join(known, list(by), "left").withColumns({"_v0": v0, "_p0": p0, "_v1": v1, "_p1": p1, "_n": n})
    a, b = F.get("_k", F.lit(0)), F.get("_k", F.lit(1))
    y, z = F.get("_k", F.size("_k") - 2), F.get("_k", F.size("_k") - 1)
    along = lambda s, t: s["v"] + (t["v"] - s["v"]) / (t["p"] - s["p"]) * (F.col(order) - s["p"])
    inner = F.col("_v0") + (F.col("_v1") - F.col("_v0")) / (F.col("_p1") - F.col("_p0")) * (F.col(order) - F.col("_p0"))
    line = F.when(F.col("_p0").isNull(), along(a, b)).when(F.col("_p1").isNull(), along(y, z)).otherwise(inner)
    return rows.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(F.col("_n") >= least, F.round(line, 0))).drop("_k", "_v0", "_p0", "_v1", "_p1", "_n")


def unwrap_angle(series: DataFrame, by: Sequence[str], order: str, angle: str) -> DataFrame:
    """Jumps of whole turns between neighbours taken out."""
    w = Window.partitionBy(*by).orderBy(order)
    turn = F.round((F.col(angle) - F.lag(angle).over(w)) / (2 * math.pi), 0)
    rows = series.withColumn("_t", F.coalesce(turn, F.lit(0.0)))
    return rows.withColumn(angle, F.col(angle) - 2 * math.pi * F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t")


def compose_along(transforms: DataFrame, by: Sequence[str], order: str, m: str = "m", n: int = 4) -> DataFrame:
    """Running product of each group's matrices (row-major arrays) in order. Rows are
    dealt by ranges of (by, order), as many as the shuffle has partitions; each range
    multiplies its own matrices, the products of whole ranges, one a group and range, are multiplied up,
    and each row then takes what stands before its range. So a series of any length is
    many tasks, and rows of one place in the order (ties) come in any order."""

    def product(a: np.ndarray, b) -> np.ndarray:
        return a @ np.asarray(b, float).reshape(n, n)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now, out = pdf.sort_values(order), np.eye(n), []
        for x in pdf[m]:
            now = product(now, x)
            out.append(now.ravel().tolist())
        return pdf.assign(**{m: out, "_last": np.arange(len(out)) == len(out) - 1})

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, now, out = pdf.sort_values("_part"), np.eye(n), []
        for x in pdf["_all"]:
            out.append(now.ravel().tolist())
            now = product(now, x)
        return pdf.assign(_before=out)[[*by, "_part", "_before"]]

    spark = transforms.sparkSession
    dealt = transforms.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, order).withColumn("_part", F.spark_partition_id()).checkpoint()
    own = dealt.groupBy(*by, "_part").applyInPandas(within, StructType([*dealt.schema.fields, StructField("_last", BooleanType())])).checkpoint()
    keys = [transforms.schema[c] for c in by]
    ends = own.where("_last").select(*by, "_part", F.col(m).alias("_all"))
    # A row for each group and range that holds rows of it.
    ahead = ends.groupBy(*by).applyInPandas(before, StructType([*keys, StructField("_part", IntegerType()), StructField("_before", ArrayType(DoubleType()))]))
    met = own.join(ahead.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)}).withColumnRenamed("_part", "_at"), (F.col("_part") == F.col("_at")) & reduce(and_, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)), F.lit(True)))
    return met.withColumn(m, matmul(F.col("_before"), F.col(m), n)).select(*transforms.columns)


def _five_diagonals(main: np.ndarray, one: np.ndarray, two: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of symmetric positive definite systems with two diagonals beside the
    main one, by their LDL' factors: linear in the number of rows. Systems of as many
    rows are solved at once: diagonals are (rows, systems), right is (rows, right sides,
    systems); one alone is (rows) and (rows, right sides) or (rows)."""
    n = len(main)
    d, l1, l2, x = main.astype(float).copy(), np.zeros(main.shape), np.zeros(main.shape), right.astype(float).copy()
    for i in range(n):
        if i >= 2:
            d[i] -= l2[i - 2] ** 2 * d[i - 2]
            x[i] -= l2[i - 2] * x[i - 2]
        if i >= 1:
            d[i] -= l1[i - 1] ** 2 * d[i - 1]
            x[i] -= l1[i - 1] * x[i - 1]
            if i + 1 < n:
                l1[i] = (one[i] - l1[i - 1] * l2[i - 1] * d[i - 1]) / d[i]
        elif n > 1:
            l1[i] = one[i] / d[i]
        if i + 2 < n:
            l2[i] = two[i] / d[i]
    x /= d.reshape(n, *[1] * (x.ndim - d.ndim), *d.shape[1:])
    for i in range(n - 2, -1, -1):
        x[i] -= l1[i] * x[i + 1] + (l2[i] * x[i + 2] if i + 2 < n else 0)
    return x


class _Stretches:
    """Blocks of as many rows each of the normal equations of a path of n rows: block
    k has the rows start[k], start[k] + 1, ..., known is (rows, blocks). Its first two rows
    (none in the path's first block, which comes alone) join it to the block before; the
    inner rows touch only these and the first two of the next block."""

    def __init__(self, start: np.ndarray, known: np.ndarray, n: int, penalty: float) -> None:
        m = len(known)
        at = start + np.arange(m)[:, None]
        first, middle, last = at <= n - 3, (at >= 1) & (at <= n - 2), at >= 2
        # Sums of squares of (1, -2, 1) at every place; a touch on the main diagonal
        # keeps a path with few known values solvable.
        self.main = known + penalty * (first + 4.0 * middle + last) + 1e-9
        self.one = -2.0 * penalty * (first + 1.0 * middle)
        self.two = penalty * first.astype(float)
        self.joint = j = 0 if start[0] == 0 else min(2, m)
        #: Entries between the inner rows and (own first two, next block's first two).
        self.beside = np.zeros((m - j, 4, len(start)))
        if m > j:
            if j:
                self.beside[0, 0], self.beside[0, 1] = self.two[0], self.one[1]
                if m > 3:
                    self.beside[1, 1] = self.two[1]
            self.beside[-1, 2] += self.one[-1]
            self.beside[-1, 3] += self.two[-1]
            if m - j > 1:
                self.beside[-2, 2] += self.two[-2]

    def inner(self, right: np.ndarray) -> np.ndarray:
        system = [x[self.joint :] for x in (self.main, self.one, self.two)]
        if right.shape[2] > 1:
            return _five_diagonals(*system, right)
        # One block alone: a loop over numbers is quicker than one over arrays of one.
        lone = right.reshape(right.shape[:2] if right.shape[1] > 1 else len(right))
        return _five_diagonals(*(x[:, 0] for x in system), lone).reshape(right.shape)

    def folded(self, right: np.ndarray) -> np.ndarray:
        """What is left of each block (a row) for its joints when its inner rows are solved: 4 x 4
        and 4 numbers of the fold, and the joint rows' own 2 x 2 entries and right sides."""
        j, k = self.joint, right.shape[1]
        x = self.inner(np.concatenate([self.beside, right[j:, None]], axis=1))
        own, side = np.zeros((k, 2, 2)), np.zeros((k, 2))
        own[:, [0, 1], [0, 1]] = 1
        for i in range(j):
            own[:, i, i], side[:, i] = self.main[i], right[i]
        if j == 2:
            own[:, 0, 1] = own[:, 1, 0] = self.one[0]
        return np.hstack([np.einsum("rak,rbk->kab", self.beside, x).reshape(k, 20), own.reshape(k, 4), side])  # 4 x 5, 2 x 2, 2

    def solved(self, right: np.ndarray, joints: np.ndarray) -> np.ndarray:
        """All rows' values, given those of the own joint rows and the next block's (blocks, 4)."""
        j = self.joint
        inner = right[j:] - np.einsum("rak,ka->rk", self.beside, joints)
        return np.concatenate([joints[:, :j].T, self.inner(inner[:, None])[:, 0]])


def _cut(m: int, start: int, block: int) -> list[tuple[int, int, int]]:
    """(from, to, rows of a block) of a run of m rows that begins at a block's start: the
    path's first block, whole blocks, and what is left of the path's last."""
    first = min(block, m) if start == 0 else 0
    whole = first + (m - first) // block * block
    return [(a, b, size) for a, b, size in ((0, first, first), (first, whole, block), (whole, m, m - whole)) if b > a]


def _joints(folds: np.ndarray) -> np.ndarray:
    """The joint rows' values (blocks, 4: own and the next block's) from the folds of
    a path's blocks in order: 2 x 2 elimination down and back."""
    k = len(folds)
    fold, own, side = folds[:, :20].reshape(k, 4, 5), folds[:, 20:24].reshape(k, 2, 2), folds[:, 24:].copy()
    x = np.zeros((k + 1, 2))
    main, above = np.zeros((k, 2, 2)), np.zeros((k, 2, 2))
    for i in range(1, k):
        main[i] = own[i] - fold[i, :2, :2] - fold[i - 1, 2:, 2:4]
        side[i] -= fold[i, :2, 4] + fold[i - 1, 2:, 4]
        above[i] = -fold[i, :2, 2:4]
        if i > 1:
            back = np.linalg.solve(main[i - 1], above[i - 1]).T
            main[i] -= back @ above[i - 1]
            side[i] -= back @ side[i - 1]
    for i in range(k - 1, 0, -1):
        x[i] = np.linalg.solve(main[i], side[i] - above[i] @ x[i + 1])
    return np.hstack([x[:-1], x[1:]])


#: Rows of a path that a task solves at a time, about: as many whole blocks, one at least.
RUN_ROWS = 20_000


def smooth_path(path: DataFrame, by: str, order: str, values: Sequence[str], penalty: float, block: int = 20_000) -> DataFrame:
    """Values for every slice from few annotated ones: least squares with a penalty
    on second differences. Null and NaN are unknown; a value with fewer than two known
    ones in its path, and paths of fewer than three rows, stay as they are.

    Paths are cut into blocks of `block` rows (5 or more) by place, and a run of blocks is a
    task's group. Each block solves its inner rows against its two first rows and the next
    block's, the blocks of a run all at once; what is left, two rows a block, is one small
    system a path; with its solution each block fills in its own rows. So a path of any
    length is many tasks and none holds more than a run or two rows of each block. Rows of
    one place (ties) come in any order.
    """
    if block < 5:
        raise ValueError("a block has 5 rows or more")
    run = max(1, RUN_ROWS // block)
    spark, columns = path.sparkSession, path.columns
    known = lambda v: F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    dealt = path.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by, order).withColumn("_part", F.spark_partition_id()).checkpoint()
    # A row for each path and range that holds rows of it.
    sizes = dealt.groupBy(by, "_part").agg(F.count("*").alias("_c"), *(F.count_if(known(v)).alias(f"_k{i}") for i, v in enumerate(values)))
    whole = Window.partitionBy(by)
    sizes = sizes.select(
        F.col(by).alias("_by"), F.col("_part").alias("_at"), (F.sum("_c").over(whole.orderBy("_part")) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_n"),
        *((F.sum(f"_k{i}").over(whole) >= 2).alias(f"_fit{i}") for i in range(len(values))),
    )
    place = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order)) - 1 + F.col("_before")
    rows = dealt.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at"))).withColumn("_i", place.cast("long"))
    rows = rows.withColumn("_run", F.floor(F.col("_i") / (block * run)).cast("long")).drop("_part", "_by", "_at", "_before").checkpoint()

    def systems(pdf: pd.DataFrame):
        """(value's number, [(from, to, number of the first block, system, right side)]) of the values that are fitted."""
        n, start = int(pdf["_n"].iloc[0]), int(pdf["_i"].iloc[0])
        for at, v in enumerate(values):
            if pdf[f"_fit{at}"].iloc[0] and n > 2:
                y = pdf[v].to_numpy(float)
                there = ~np.isnan(y)
                right, parts = np.where(there, y, 0), []
                for a, b, size in _cut(len(y), start, block):
                    cut = lambda x: x[a:b].reshape(-1, size).T  # noqa: E731, B023
                    parts.append((a, b, (start + a) // block, _Stretches(np.arange(start + a, start + b, size), cut(there).astype(float), n, penalty), cut(right)))
                yield at, parts

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("_i"), []
        for at, parts in systems(pdf):
            for _, _, k, system, right in parts:
                out += [(pdf[by].iloc[0], k + i, at, f) for i, f in enumerate(system.folded(right))]
        return pd.DataFrame(out, columns=[by, "_block", "_value", "_fold"])

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        return pdf.assign(_joint=_joints(np.array(pdf["_fold"].tolist())).tolist())[[by, "_block", "_value", "_joint"]]

    def fill(pdf: pd.DataFrame, joints: pd.DataFrame) -> pd.DataFrame:
        pdf, joints = pdf.sort_values("_i"), joints.sort_values("_block")
        for at, parts in systems(pdf):
            met = np.array(joints.loc[joints["_value"] == at, "_joint"].tolist(), float)
            first = parts[0][2]
            solved = [system.solved(right, met[k - first : k - first + right.shape[1]]).T.ravel() for _, _, k, system, right in parts]
            pdf[values[at]] = np.concatenate(solved)
        return pdf[columns]

    keys = [path.schema[by], StructField("_block", LongType()), StructField("_value", IntegerType())]
    folds = rows.groupBy(by, "_run").applyInPandas(fold, StructType([*keys, StructField("_fold", ArrayType(DoubleType()))]))
    joints = folds.groupBy(by, "_value").applyInPandas(join_up, StructType([*keys, StructField("_joint", ArrayType(DoubleType()))]))
    joints = joints.withColumn("_run", F.floor(F.col("_block") / run).cast("long"))
    return rows.groupBy(by, "_run").cogroup(joints.groupBy(by, "_run")).applyInPandas(fill, path.schema)


def smooth_transforms(series: DataFrame, r: int, by: Sequence[str], order: str, shifts: Sequence[str], angle: str) -> DataFrame:
    """Moving medians of translations and of an angle's sine and cosine."""
    for s in shifts:
        series = moving_median(series, r, by, order, s, "_m").withColumn(s, F.col("_m")).drop("_m")
    series = moving_median(series.withColumn("_s", F.sin(angle)).withColumn("_c", F.cos(angle)), r, by, order, "_s", "_ms")
    series = moving_median(series, r, by, order, "_c", "_mc")
    return series.withColumn(angle, F.atan2("_ms", "_mc")).drop("_s", "_c", "_ms", "_mc")


def straighten_transforms(path: DataFrame, centre: Sequence[float], angle: float = 0.0) -> DataFrame:
    """Adds m (3 x 3, row-major): each slice's point (x, y) to centre, its angle turned to the given one."""
    d = angle - F.col("angle")
    c, s = F.cos(d), F.sin(d)
    x, y = F.col("x"), F.col("y")
    return path.withColumn("m", F.array(c, -s, centre[0] - c * x + s * y, s, c, centre[1] - s * x - c * y, F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def largest_gap(annotations: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """(by, start, gap): the widest step between neighbouring annotations, the first of ties."""
    step = F.lead(order).over(Window.partitionBy(*by).orderBy(order)) - F.col(order)
    rows = annotations.withColumn("_g", step).where("_g is not null")
    return rows.groupBy(*by).agg(F.min_by(order, F.struct(-F.col("_g"), F.col(order))).alias("start"), F.max("_g").alias("gap"))


def select_scenes(catalog: DataFrame, file: str = "file", scene: str = "scene", width: str = "width", tolerance: float = 0.3) -> DataFrame:
    """Scenes where the width jumps up (each new picture's full resolution), of those
    the ones within the tolerance of their file's median width."""
    w = Window.partitionBy(file).orderBy(scene)
    tops = catalog.withColumn("_p", F.lag(width).over(w)).where(F.col("_p").isNull() | (F.col(width) > F.col("_p"))).drop("_p")
    middle = tops.groupBy(file).agg(F.percentile(width, F.lit(0.5)).alias("_m"))
    return tops.join(middle, file).where(F.abs(F.col(width) - F.col("_m")) <= tolerance * F.col("_m")).drop("_m")
