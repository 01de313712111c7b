"""Dense volumes as cubes of voxels, a cube a row: resampling and components whose
shuffles carry cubes and faces, never a row for each voxel and neighbour."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.operators.spatial import link_components

AXES = ("y", "x", "z")
PLACE = ("b_y", "b_x", "b_z")


def _kinds(df: DataFrame, cols: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in cols)


def _cubes(rows: DataFrame, edge: int, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, b_y, b_x, b_z, a binary per value): edge^3 doubles in order y, x, z, NaN where there is no row."""
    inside = sum((F.pmod(F.col(a) - 1, F.lit(edge)) * edge ** (2 - i) for i, a in enumerate(AXES)), F.lit(0)).cast("int")
    placed = rows.select(*by, *(F.floor((F.col(a) - 1) / edge).cast("int").alias(b) for a, b in zip(AXES, PLACE)), F.struct(inside.alias("at"), *(F.col(v).cast("double").alias(v) for v in values)).alias("v"))
    lists = placed.groupBy(*by, *PLACE).agg(F.collect_list("v").alias("v"))  # edge^3 entries at most
    keys = len(by) + 3

    def dense(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(keys)
            entries, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = entries.field("at").to_numpy(zero_copy_only=False)
            out = []
            for v in values:
                flat = entries.field(v).to_numpy(zero_copy_only=False)
                data = []
                for i, j in zip(ends, ends[1:]):
                    cube = np.full(edge**3, np.nan)
                    cube[at[i:j]] = flat[i:j]
                    data.append(cube.tobytes())
                out.append(pa.array(data, pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[:keys], *out], names=[*b.schema.names[:keys], *values])

    return lists.mapInArrow(dense, _kinds(lists, [*by, *PLACE]) + ", ".join(f"`{v}` binary" for v in values))


@dataclass(frozen=True)
class Volume:
    """cubes (by, b_y, b_x, b_z, value) of edge^3 voxels each; size: y, x, z where known, voxels beyond it are none."""

    cubes: DataFrame
    edge: int
    by: tuple[str, ...]
    size: tuple[int, int, int] | None = None

    def voxels(self) -> DataFrame:
        """(by, y, x, z, value) of the voxels that are there."""
        edge, size, by = self.edge, self.size, list(self.by)

        def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    cube = np.frombuffer(b.column(len(by) + 3)[i].as_buffer())
                    at = np.flatnonzero(~np.isnan(cube))
                    place = [p + 1 + b.column(len(by) + k)[i].as_py() * edge for k, p in enumerate(np.unravel_index(at, (edge,) * 3))]
                    if size:
                        fits = np.logical_and.reduce([p <= n for p, n in zip(place, size)])
                        at, place = at[fits], [p[fits] for p in place]
                    keys = [pa.repeat(b.column(k)[i], len(at)) for k in range(len(by))]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(p.astype(np.int32)) for p in place), pa.array(cube[at])], names=[*by, *AXES, "value"])

        return self.cubes.select(*by, *PLACE, "value").mapInArrow(spread, _kinds(self.cubes, by) + "y int, x int, z int, value double")


def volume(voxels: DataFrame, edge: int = 32, by: Sequence[str] = ("sample_id", "channel"), size: Sequence[int] | None = None) -> Volume:
    """Rows (by, y, x, z, value), each voxel once, as cubes: one shuffle of the rows. A
    null or NaN value is no voxel."""
    return Volume(_cubes(voxels, edge, by, ["value"]), edge, tuple(by), tuple(size) if size else None)


def _positions(place: Sequence[int], edge: int, size: Sequence[int], inverse: np.ndarray, field: Sequence[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """(places in the cube that lie within size, where each of them is in the input)."""
    grid = np.indices((edge,) * 3).reshape(3, -1)
    at = grid + np.array(place)[:, None] * edge + 1
    inside = np.flatnonzero((at <= np.array(size)[:, None]).all(0))
    at = at[:, inside].astype(float)
    if field is not None:
        at = at - np.stack([np.nan_to_num(np.frombuffer(f)[inside]) for f in field])
    return inside, inverse[:3, :3] @ at + inverse[:3, 3:]


def _corners(at: np.ndarray, mode: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(input voxel, weight) of each corner; nearest has one, halves away from zero."""
    if mode == "nearest":
        yield (np.sign(at) * np.floor(np.abs(at) + 0.5)).astype(np.int64), np.ones(at.shape[1])
        return
    low = np.floor(at)
    part = at - low
    for step in product((0, 1), repeat=3):
        yield (low + np.array(step)[:, None]).astype(np.int64), np.prod([p if s else 1 - p for s, p in zip(step, part)], axis=0)


def _gather(at: np.ndarray, sources: Iterable[tuple[Sequence[int], np.ndarray]], edge: int, mode: str, fill: float) -> np.ndarray:
    """Values at places from the source cubes, one after the other; NaN, or fill where it is not 0, where none of them has a corner of weight."""
    total, weight = np.zeros(at.shape[1]), np.zeros(at.shape[1])
    corners = [(v - 1, w) for v, w in _corners(at, mode)]
    for place, cube in sources:
        for voxel, w in corners:
            here = np.flatnonzero((voxel // edge == np.array(place)[:, None]).all(0) & (w > 0))
            y, x, z = voxel[:, here] - np.array(place)[:, None] * edge
            value = cube[(y * edge + x) * edge + z]
            there = ~np.isnan(value)
            np.add.at(total, here[there], w[here][there] * value[there])
            np.add.at(weight, here[there], w[here][there])
    found = total + (1 - weight) * fill
    return np.where(weight > 0, found, np.nan if fill == 0 else fill)


def warp(source: Volume, matrix: Sequence[Sequence[float]], size: Sequence[int], mode: str = "linear", fill: float = 0.0, field: DataFrame | None = None) -> Volume:
    """The volume on a grid of `size` (y, x, z) by the inverse of matrix, after a
    displacement by field (i, j, k, dx, dy, dz) where one is given: the same voxels
    and values as lookup.warp_volume and warp_volume_field, from cubes.

    Each output cube computes which source cubes its places touch; these are joined
    by cube, collected for the output cube, and sampled there one after the other.
    Output cubes are the smaller the more the map shrinks, so that one touches a few
    source cubes. What is shuffled is each source cube once for each output cube that
    needs it. For lookup.warp_volume the matrix acts on (y, x, z); with a field on
    (x, y, z), as there.
    """
    inverse = np.linalg.inv(np.array(matrix, float))
    by, edge = list(source.by), source.edge
    stretch = max(1.0, float(np.abs(inverse[:3, :3]).sum(1).max()))
    out = max(2, int(edge / stretch))
    spark = source.cubes.sparkSession
    n = [-(-s // out) for s in size]
    places = spark.range(n[0] * n[1] * n[2]).select(*(c.cast("int").alias(p) for c, p in zip((F.floor(F.col("id") / (n[1] * n[2])), F.floor(F.col("id") / n[2]) % n[1], F.col("id") % n[2]), PLACE)))
    if field is not None:
        # The field's axes i, j, k are x, y, z; the matrix is brought to the order y, x, z.
        turn = [1, 0, 2, 3]
        inverse = inverse[turn][:, turn]
        shifts = _cubes(field.select(F.col("j").alias("y"), F.col("i").alias("x"), F.col("k").alias("z"), "dy", "dx", "dz"), out, [], ["dy", "dx", "dz"])
        places = places.join(shifts, list(PLACE), "left")
    extra = ["dy", "dx", "dz"] if field is not None else []
    size = tuple(int(s) for s in size)

    def place_of(row) -> tuple[np.ndarray, np.ndarray]:
        moved = (row.dy, row.dx, row.dz) if extra and row.dy is not None else None
        return _positions((row.b_y, row.b_x, row.b_z), out, size, inverse, moved)

    def needs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                _, at = place_of(row)
                touched = np.concatenate([(v[:, w > 0] - 1) // edge for v, w in _corners(at, mode)], axis=1)
                s = np.unique(touched, axis=1)
                s = s[:, (s >= 0).all(0) & (np.abs(s) < 2**31).all(0)]
                yield pd.DataFrame({"b_y": row.b_y, "b_x": row.b_x, "b_z": row.b_z, **{f"s_{a}": s[i].astype(np.int32) for i, a in enumerate(AXES)}})

    wanted = places.mapInPandas(needs, "b_y int, b_x int, b_z int, s_y int, s_x int, s_z int")
    cubes = source.cubes.select(*by, *(F.col(p).alias(f"s_{a}") for a, p in zip(AXES, PLACE)), "value")
    gathered = wanted.join(cubes, [f"s_{a}" for a in AXES]).groupBy(*by, *PLACE).agg(F.collect_list(F.struct("s_y", "s_x", "s_z", "value")).alias("sources"))
    if fill != 0:  # every output cube of every group is part of the result
        gathered = places.select(*PLACE).join(source.cubes.select(*by).distinct(), F.lit(True)).join(gathered, [*by, *PLACE], "left")
    if extra:
        gathered = gathered.join(places, list(PLACE))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for row in b.itertuples(index=False):
                inside, at = place_of(row)
                cube = np.full(out**3, np.nan)
                found = [] if row.sources is None else row.sources
                cube[inside] = _gather(at, (((s["s_y"], s["s_x"], s["s_z"]), np.frombuffer(s["value"])) for s in found), edge, mode, fill)
                data.append(cube.tobytes())
            yield b[[*by, *PLACE]].assign(value=data)

    made = gathered.select(*by, *PLACE, "sources", *extra).mapInPandas(sample, _kinds(source.cubes, by) + "b_y int, b_x int, b_z int, value binary")
    return Volume(made, out, source.by, size)


# ---- filters over halo cubes ----------------------------------------------------------------


def halo_cubes(v: Volume, halo: int, absent: float = 0.0, every: bool = False) -> DataFrame:
    """(by, b_y, b_x, b_z, low array<int>, shape array<int>, data): each cube with
    `halo` voxels (the edge at most) of its neighbours on all sides, clipped at the
    volume's size; absent voxels are `absent`. A cube sends its sides to its neighbours
    as blocks of doubles. A cube that is not there is made only where `every` is set
    and a neighbour is."""
    edge, by = v.edge, list(v.by)
    if not 0 <= halo <= edge:
        raise ValueError(f"a halo of {halo} does not fit cubes of {edge}")
    if v.size is None:
        raise ValueError("the volume's size must be known")
    size = tuple(v.size)

    def sides(step: int) -> slice:
        """The part that a cube sends to the neighbour `step` away."""
        return slice(None) if step == 0 else slice(edge - halo, edge) if step > 0 else slice(0, halo)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                cube = np.frombuffer(row.value).reshape((edge,) * 3)
                out = []
                for step in product((-1, 0, 1), repeat=3):
                    part = cube[tuple(map(sides, step))]
                    to = [getattr(row, p) + s for p, s in zip(PLACE, step)]
                    if part.size and all(t >= 0 for t in to):
                        out.append((*(getattr(row, c) for c in by), *to, *step, part.tobytes()))
                yield pd.DataFrame(out, columns=[*by, *PLACE, "sy", "sx", "sz", "part"])

    sent = v.cubes.select(*by, *PLACE, "value").mapInPandas(send, _kinds(v.cubes, by) + "b_y int, b_x int, b_z int, sy int, sx int, sz int, part binary")
    met = sent.groupBy(*by, *PLACE).agg(F.collect_list(F.struct("sy", "sx", "sz", "part")).alias("parts"), F.max((F.col("sy") == 0) & (F.col("sx") == 0) & (F.col("sz") == 0)).alias("own")).where(F.col("own") | F.lit(every))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                full = np.full((edge + 2 * halo,) * 3, absent)
                for p in row.parts:
                    steps = (p["sy"], p["sx"], p["sz"])
                    # A neighbour on the far side sent its near side, and the other way round.
                    at = tuple(slice(halo, halo + edge) if s == 0 else slice(0, halo) if s > 0 else slice(halo + edge, None) for s in steps)
                    part = np.frombuffer(p["part"]).reshape(full[at].shape)
                    full[at] = np.where(np.isnan(part), absent, part)
                low = [getattr(row, c) * edge + 1 - halo for c in PLACE]
                cut = tuple(slice(max(0, 1 - a), min(edge + 2 * halo, n - a + 1)) for a, n in zip(low, size))
                full = full[cut]
                out.append((*(getattr(row, c) for c in [*by, *PLACE]), [max(1, a) for a in low], list(full.shape), full.tobytes()))
            yield pd.DataFrame(out, columns=[*by, *PLACE, "low", "shape", "data"])

    return met.select(*by, *PLACE, "parts").mapInPandas(join, _kinds(v.cubes, by) + "b_y int, b_x int, b_z int, low array<int>, shape array<int>, data binary")


def filtered(v: Volume, halo: int, how: Callable[[np.ndarray], np.ndarray], absent: float = 0.0) -> Volume:
    """The volume after how (an array to one of its shape), each cube by itself with
    its halo; absent voxels are `absent` before it."""
    edge, by, size = v.edge, list(v.by), tuple(v.size or ())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for row in b.itertuples(index=False):
                done = how(np.frombuffer(row.data).reshape(row.shape))
                first = [getattr(row, p) * edge + 1 for p in PLACE]
                n = [min(edge, s - f + 1) for s, f in zip(size, first)]
                cube = np.full((edge,) * 3, np.nan)
                cube[tuple(slice(0, k) for k in n)] = done[tuple(slice(f - a, f - a + k) for f, a, k in zip(first, row.low, n))]
                data.append(cube.tobytes())
            yield b[[*by, *PLACE]].assign(value=data)

    return Volume(halo_cubes(v, halo, absent).mapInPandas(run, _kinds(v.cubes, by) + "b_y int, b_x int, b_z int, value binary"), edge, v.by, v.size)


def _windowed_rank(a: np.ndarray, r: int, axes: Sequence[int], rank: float) -> np.ndarray:
    """Quantile, linear between neighbours, of the numbers in the window of +-r along
    axes round each number; NaN where there is none, and NaN stays NaN."""
    pads = [(r, r) if i in axes else (0, 0) for i in range(a.ndim)]
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(a, pads, constant_values=np.nan), [2 * r + 1] * len(axes), axis=tuple(axes))
    out = np.full(a.shape, np.nan)
    for i in range(a.shape[0]):  # a slab's windows at a time
        flat = np.sort(windows[i].reshape(*a.shape[1:], -1), axis=-1)  # NaN last
        n = (~np.isnan(flat)).sum(-1)
        at = np.maximum(n - 1, 0) * rank
        low = np.floor(at).astype(int)
        take = lambda k: np.take_along_axis(flat, k[..., None], -1)[..., 0]  # noqa: B023, E731
        a0, a1 = take(low), take(np.minimum(low + 1, np.maximum(n - 1, 0)))
        out[i] = a0 + (a1 - a0) * (at - low)
    return np.where(np.isnan(a), np.nan, out)


def rank_filter(v: Volume, r: int, rank: float = 0.5, axes: Sequence[str] = ("y", "x")) -> Volume:
    """The median, or another rank, of the present voxels in the window of +-r along
    axes: stencil.median_filter on cubes, without a row for each neighbour."""
    along = [AXES.index(a) for a in axes]
    return filtered(v, r, lambda a: _windowed_rank(a, r, along, rank), float("nan"))


def candidate_views(cells: DataFrame, v: Volume, half: int, key: str = "cell_id") -> DataFrame:
    """(key, view_yx, view_zx, view_zy array<double>): greatest-value projections of
    the box of +-half round each cell (by, y, x, z), rows of (2 half + 1)^2 values in
    order of the view's first axis, voxels outside the volume and absent ones 0. Cells go
    to the halo cube that they lie in, so a voxel is never a row; each voxel that holds cells is
    projected once, and its cells take the views from it. Cells without a place are left out."""
    edge, by, side = v.edge, list(v.by), 2 * half + 1
    halos = halo_cubes(v, half, every=True)
    at = cells.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in by), *(F.round(F.col(a), 0).cast("int").alias(f"_{a}") for a in AXES)).where("_y is not null and _x is not null and _z is not null")
    at = at.withColumns({f"_{p}": F.floor((F.col(f"_{a}") - 1) / edge).cast("int") for a, p in zip(AXES, PLACE)})
    names = ["view_yx", "view_zx", "view_zy"]

    def views(_, here: pd.DataFrame, cube: pd.DataFrame) -> pd.DataFrame:
        data = low = None
        if len(cube):
            data, low = np.frombuffer(cube["data"].iloc[0]).reshape(cube["shape"].iloc[0]), cube["low"].iloc[0]
        out = []
        for centre in here[["_y", "_x", "_z"]].itertuples(index=False, name=None):
            box = np.zeros((side,) * 3)
            if data is not None:
                first = [c - half - a for c, a in zip(centre, low)]
                src = tuple(slice(max(0, f), max(0, min(n, f + side))) for f, n in zip(first, data.shape))
                to = tuple(slice(s.start - f, s.start - f + max(0, s.stop - s.start)) for s, f in zip(src, first))
                box[to] = data[src]
            # Of y, x, z: along z for (y, x), along y for (z, x), along x for (z, y).
            out.append((*(here[f"_{c}"].iloc[0] for c in by), *centre, box.max(2).ravel().tolist(), box.max(0).T.ravel().tolist(), box.max(1).T.ravel().tolist()))
        return pd.DataFrame(out, columns=[*at_voxel, *names])

    at_voxel = [f"_{c}" for c in [*by, *AXES]]
    kind = ", ".join(f"`{c}` {at.schema[c].dataType.simpleString()}" for c in at_voxel)
    centres = at.select(*at_voxel, *(f"_{p}" for p in PLACE)).distinct()
    groups = centres.groupBy(*(f"_{c}" for c in [*by, *PLACE])).cogroup(halos.groupBy(*by, *PLACE))
    seen = groups.applyInPandas(views, f"{kind}, " + ", ".join(f"{n} array<double>" for n in names)).withColumnsRenamed({c: f"_at{c}" for c in at_voxel})
    met = at.join(seen.hint("merge"), reduce(and_, (F.col(c).eqNullSafe(F.col(f"_at{c}")) for c in at_voxel)))
    return met.select(F.col("_key").alias(key), *names)


def cube_quantile(cubes: DataFrame, q: float) -> float | None:
    """The quantile, exact and linear between neighbours, of all values in cubes; None
    without any. Values stay in their cubes: each of four scans counts the next 16 bits
    of their ordered binary form among those that agree so far with the ranks asked for."""

    def count(shift: int, prefixes: list[int]) -> dict[tuple[int, int], int]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(prefixes), 1 << 16), np.int64)
            for b in batches:
                for data in b.column(0):
                    bits = np.frombuffer(data.as_buffer()) + 0.0
                    bits = bits[~np.isnan(bits)].view(np.uint64)
                    bits = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))
                    for i, p in enumerate(prefixes):
                        own = bits if shift == 48 else bits[bits >> np.uint64(shift + 16) == np.uint64(p)]
                        total[i] += np.bincount((own >> np.uint64(shift)).astype(np.int64) & 0xFFFF, minlength=1 << 16)
            i, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[i, k])], names=["i", "k", "c"])

        found = cubes.select("value").mapInArrow(run, "i int, k int, c long").groupBy("i", "k").agg(F.sum("c").alias("c")).collect()
        return {(prefixes[r["i"]], r["k"]): r["c"] for r in found}

    counts = count(48, [0])
    n = sum(counts.values())
    if not n:
        return None
    at = (n - 1) * q
    ranks = [math.floor(at), math.ceil(at)]
    prefixes, rest = [0, 0], list(ranks)
    for shift in (48, 32, 16, 0):
        counts = counts if shift == 48 else count(shift, sorted(set(prefixes)))
        for j in (0, 1):
            for (p, k), c in sorted(counts.items()):
                if p != prefixes[j]:
                    continue
                if rest[j] < c:
                    prefixes[j] = p << 16 | k
                    break
                rest[j] -= c
    bits = np.array(prefixes, np.uint64)
    low, high = np.where(bits >> np.uint64(63) == 1, bits ^ np.uint64(1 << 63), ~bits).view(float)
    return float(low + (high - low) * (at - ranks[0]))


def voxels_above(v: Volume, threshold: float) -> DataFrame:
    """(by, y, x, z, value) of the voxels above threshold: no others become rows."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for value in b["value"]:
                cube = np.frombuffer(value)
                data.append(np.where(cube > threshold, cube, np.nan).tobytes())
            yield b.assign(value=data)

    bright = v.cubes.select(*v.by, *PLACE, "value").mapInPandas(keep, _kinds(v.cubes, v.by) + "b_y int, b_x int, b_z int, value binary")
    return Volume(bright, v.edge, v.by, v.size).voxels()


# ---- components -----------------------------------------------------------------------------


def label_runs(place: np.ndarray, most: int) -> np.ndarray:
    """For voxels (n, axes) the index of the first voxel, in order of the axes, of each
    one's component; neighbours differ by 1 along at most `most` axes. Voxels of one
    line without a gap are a run; runs of neighbouring lines that meet are linked, and
    labels are lowered along links and jump along their own labels until they rest."""
    n, d = place.shape
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort(place.T[::-1])
    p = place[order].astype(np.int64)
    p -= p.min(0)
    width = p.max(0) + 3  # room for a step beyond either end
    line = np.zeros(n, np.int64)
    for i in range(d - 1):
        line = line * width[i] + p[:, i] + 1
    last = p[:, -1] + 1
    key = line * width[-1] + last
    new = np.concatenate([[True], np.diff(key) != 1])
    first = np.flatnonzero(new)
    begin, end = key[first], key[np.concatenate([first[1:], [n]]) - 1]
    links = []
    for step in product((-1, 0, 1), repeat=d - 1):
        s = sum(map(abs, step))
        if s > most or step <= (0,) * (d - 1):
            continue
        shift = 0
        for i, k in enumerate(step):
            shift = shift * width[i] + k
        reach = 1 if s < most else 0
        low = np.searchsorted(end, begin + shift * width[-1] - reach)
        high = np.searchsorted(begin, end + shift * width[-1] + reach, "right")
        count = np.maximum(high - low, 0)
        a = np.repeat(np.arange(len(first)), count)
        b = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        links.append((a, b))
    a, b = (np.concatenate([x[i] for x in links]) if links else np.zeros(0, np.int64) for i in (0, 1))
    root = np.arange(len(first))
    while True:
        was = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, was):
            break
    out = np.empty(n, np.int64)
    out[order] = order[first[root[np.cumsum(new) - 1]]]
    return out


def connected_components(mask: DataFrame, by: Sequence[str], connectivity: int = 26, axes: Sequence[str] = AXES, edge: int = 64, checkpoint=None) -> DataFrame:
    """mask (each voxel once) with component: the struct of by and axes of the blob's
    first voxel, as stencil.connected_components has it.

    A tile of edge voxels along each axis is one row, in which runs of voxels are
    linked; only the tiles' outer voxels leave it, to meet those of neighbouring
    tiles, and only labels that meet one there go through distributed components.
    What is shuffled beside the tiles grows with their faces. Rows with a null place
    have no component.
    """
    most = {6: 1, 18: 2, 26: 3}.get(connectivity, len(axes)) if len(axes) == 3 else (1 if connectivity == 4 else len(axes))
    cut = checkpoint or (lambda df: df.checkpoint())
    tile = [f"_t{a}" for a in axes]
    there = " and ".join(f"{a} is not null" for a in axes)
    placed = mask.where(there).withColumns({t: F.floor((F.col(a) - 1) / edge).cast("long") for a, t in zip(axes, tile)})
    rows = placed.groupBy(*by, *tile).agg(F.collect_list(F.struct(*mask.columns)).alias("_rows"))  # edge^axes rows at most
    keys = len(by) + len(tile)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(keys)
            entries, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            place = np.stack([entries.field(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in axes], 1)
            labels, faces, sizes = [np.zeros(0, np.int32)], [], [0]
            for i, j in zip(ends, ends[1:]):
                own = label_runs(place[i:j], most)
                side = (place[i:j] - 1) % edge
                outer = np.flatnonzero(((side == 0) | (side == edge - 1)).any(1))
                labels.append(own.astype(np.int32))
                faces.append((place[i:j][outer], own[outer], place[i:j][own[outer]]))
                sizes.append(len(outer))
            if not faces:
                continue
            face, own, head = (np.concatenate([f[k] for f in faces]) for k in range(3))
            face_rows = pa.StructArray.from_arrays([*(pa.array(face[:, k]) for k in range(len(axes))), pa.array(own.astype(np.int32)), *(pa.array(head[:, k]) for k in range(len(axes)))], names=[*axes, "label", *(f"h{k}" for k in range(len(axes)))])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(labels))), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), face_rows)],
                names=[*b.schema.names, "_labels", "_faces"],
            )

    face_kind = ", ".join([f"`{a}`: bigint" for a in axes] + ["label: int"] + [f"h{k}: bigint" for k in range(len(axes))])
    tiles = cut(rows.mapInArrow(label, _kinds(rows, [*by, *tile]) + f"_rows {rows.schema['_rows'].dataType.simpleString()}, _labels array<int>, _faces array<struct<{face_kind}>>"))
    kinds = {c: mask.schema[c].dataType for c in [*by, *axes]}
    faces = tiles.select(*by, *tile, F.explode("_faces").alias("_f"))
    name = F.struct(*by, *(F.col(f"_f.h{k}").cast(kinds[a]).alias(a) for k, a in enumerate(axes)))
    faces = cut(faces.select(*by, *(F.col(f"_f.{a}").alias(a) for a in axes), F.struct(*(F.col(t) for t in tile)).alias("_tile"), F.col("_f.label").alias("_label"), name.alias("_name")))
    steps = [s for s in product((-1, 0, 1), repeat=len(axes)) if 0 < sum(map(abs, s)) <= most and s > (0,) * len(axes)]
    near = faces.select(*by, *axes, "_tile", F.col("_name").alias("a"), F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps))).alias("_s"))
    near = near.select(*by, *((F.col(c) + F.get("_s", F.lit(i))).alias(c) for i, c in enumerate(axes)), F.col("_tile").alias("_from"), "a")
    near = near.where(" or ".join(f"floor(({a} - 1) / {edge}) <> _from._t{a}" for a in axes))  # inside a tile all is linked
    edges = near.join(faces.select(*by, *axes, F.col("_name").alias("b")), [*by, *axes]).select("a", "b").distinct()
    edges = cut(edges)
    nodes = edges.select(F.col("a").alias("_name")).unionByName(edges.select(F.col("b").alias("_name"))).distinct()
    linked = link_components(edges, nodes, "_name", checkpoint).where("_name <> component")
    # The labels of each tile that are part of a smaller component elsewhere.
    named = faces.select("_name", *by, "_tile", "_label").distinct().join(linked, "_name")
    renamed = named.groupBy(*by, *(F.col(f"_tile.{t}").alias(t) for t in tile)).agg(F.collect_list("_label").alias("_l"), F.collect_list("component").alias("_c"))
    done = tiles.drop("_faces").join(renamed, [*by, *tile], "left").select(*by, "_rows", "_labels", "_l", "_c")

    names_out = [*mask.columns, "component"]

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own, labels = (b.column(len(by) + k)[i].values for k in range(2))
                labels = labels.to_numpy().copy()
                heads = own.take(pa.array(labels))
                names = pa.StructArray.from_arrays([*(pa.repeat(b.column(k)[i], len(own)) for k in range(len(by))), *(heads.field(a) for a in axes)], names=[*by, *axes])
                moved = b.column(len(by) + 2)[i].values
                if moved is not None:
                    at = np.arange(len(own))
                    to = np.full(int(labels.max()) + 1, -1)
                    to[moved.to_numpy()] = len(own) + np.arange(len(moved))
                    names = pa.concat_arrays([names, b.column(len(by) + 3)[i].values.cast(names.type)]).take(pa.array(np.where(to[labels] >= 0, to[labels], at)))
                yield pa.RecordBatch.from_arrays([*own.flatten(), names], names=names_out)

    kind = ", ".join(f"`{c}`: {t.simpleString()}" for c, t in kinds.items())
    return done.mapInArrow(spread, _kinds(mask, mask.columns) + f"component struct<{kind}>")
