"""Tile-parallel detection: halo tiles, band-pass, cells in volumes and sections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.functions import equiv_radius
from atlasframe.operators.clean import size_filter
from atlasframe.operators.stats import component_moments
from atlasframe.operators.stencil import connected_components, dilate, find_peaks

AXES = ("z", "y", "x")


@dataclass(frozen=True)
class Detection:
    """Options of a detector: expected cell radius in voxels, peak thresholds as
    ratio to the background, tile sizes (z, y and x)."""

    radius: float = 3.0
    peak: float = 0.5
    grow: float = 0.25
    nz: int = 32
    nxy: int = 256

    @property
    def halo(self) -> tuple[int, int, int]:
        r = int(np.ceil(self.radius))
        return r, 4 * r, 4 * r


def make_tiles(voxels: DataFrame, options: Detection, by: Sequence[str] = ("sample_id", "channel")) -> DataFrame:
    """Each voxel to its own tile and to those whose halo holds it: adds tz, ty, tx.
    A voxel goes to two tiles per axis at most when halos are narrower than tiles."""
    rows = voxels
    for a, size, halo in zip(AXES, (options.nz, options.nxy, options.nxy), options.halo):
        first, last = F.floor((F.col(a) - 1 - halo) / size), F.floor((F.col(a) - 1 + halo) / size)
        rows = rows.withColumn(f"t{a}", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), last.cast("int"))))
    return rows


def tile_bounds(tiles: DataFrame, options: Detection, by: Sequence[str] = ("sample_id", "channel")) -> DataFrame:
    """(by, tz, ty, tx, voxels, z0, y0, x0): the own part's first voxel."""
    n = tiles.groupBy(*by, "tz", "ty", "tx").agg(F.count("*").alias("voxels"))
    return n.withColumns({f"{a}0": F.col(f"t{a}") * s + 1 for a, s in zip(AXES, (options.nz, options.nxy, options.nxy))})


def bandpass(volume: np.ndarray, low: float, high: float, order: int = 4) -> np.ndarray:
    """Butterworth band-pass in frequency space, mirrored at the edges up to the next power of two."""
    pads = []
    for n in volume.shape:
        room = (1 << int(np.ceil(np.log2(n + 2 * min(n, int(np.ceil(low))))))) - n if n > 1 else 0
        pads.append((room // 2, room - room // 2))
    padded = np.pad(volume, pads, "symmetric")
    grid = np.meshgrid(*(np.fft.fftfreq(n) for n in padded.shape), indexing="ij")
    f = np.sqrt(sum(g**2 for g in grid))
    keep = 1 / (1 + (f * high) ** (2 * order)) - 1 / (1 + (f * low) ** (2 * order))
    out = np.fft.ifftn(np.fft.fftn(padded) * keep).real
    return out[tuple(slice(a, a + n) for (a, _), n in zip(pads, volume.shape))]


def _moving(volume: np.ndarray, r: int, how) -> np.ndarray:
    """how (np.maximum, np.add) over +-r along each axis, edges repeated (added as 0)."""
    for axis in range(volume.ndim):
        if volume.shape[axis] > 1:
            mode = {"constant_values": 0} if how is np.add else {}
            p = np.pad(volume, [(r, r) if i == axis else (0, 0) for i in range(volume.ndim)], "constant" if mode else "edge", **mode)
            n = volume.shape[axis]
            volume = how.reduce([np.take(p, range(k, k + n), axis) for k in range(2 * r + 1)])
    return volume


def signal_to_background(volume: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(band-passed, ratio): background is the rest of the band-pass, held between
    its 10 % and 90 % positive quantiles and averaged over the neighbourhood."""
    band = bandpass(volume, 4 * radius, radius / 2)
    back = volume - band
    pos = back[back > 0]
    if len(pos):
        back = np.clip(back, *np.quantile(pos, [0.1, 0.9]))
    r = max(1, int(radius))
    back = _moving(back, r, np.add) / np.maximum(_moving(np.ones_like(back), r, np.add), 1)
    return band, np.where(back > 0, band / np.where(back > 0, back, 1), 0)


def label_blobs(mask: np.ndarray) -> np.ndarray:
    """Components of a mask (all neighbours), by lowering labels over the neighbourhood until they rest."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        high = np.where(mask, _moving(label, 1, np.maximum), 0)
        # Jump along the labels' own labels, so that long blobs need few rounds.
        flat = np.concatenate([[0], high.ravel()])
        high = np.where(mask, flat[high], 0)
        if np.array_equal(high, label):
            return label
        label = high


def find_blobs(volume: np.ndarray, options: Detection) -> pd.DataFrame:
    """Peaks of the ratio grown to the lower threshold: centre (0-based), size, intensity, elongation."""
    band, ratio = signal_to_background(volume, options.radius)
    r = max(1, int(options.radius))
    peaks = (ratio >= _moving(ratio, r, np.maximum)) & (ratio > options.peak) & (band > np.quantile(band, 0.98))
    mask = (_moving(peaks.astype(np.int8), r, np.maximum) > 0) & (ratio > min(options.grow, options.peak))
    label = label_blobs(mask)
    at = np.flatnonzero(label)
    names, inverse = np.unique(label.ravel()[at], return_inverse=True)
    k, v = len(names), np.maximum(ratio.ravel()[at], 1e-9)
    place = np.stack(np.unravel_index(at, volume.shape)).astype(float)
    total = np.bincount(inverse, v, k)
    centre = np.stack([np.bincount(inverse, v * p, k) / np.maximum(total, 1e-12) for p in place])
    off = place - centre[:, inverse]
    m = np.stack([np.stack([np.bincount(inverse, v * a * b, k) / np.maximum(total, 1e-12) for b in off], -1) for a in off], -2)
    axes = np.sqrt(np.maximum(np.linalg.eigvalsh(m.reshape(k, volume.ndim, volume.ndim) + np.eye(volume.ndim) / 12), 1e-12)) if k else np.ones((0, volume.ndim))
    n = np.bincount(inverse, minlength=k)
    out = pd.DataFrame(centre.T, columns=list(AXES[-volume.ndim :]))
    return out.assign(n=n, intensity=total / np.maximum(n, 1), diameter=np.cbrt(n * 6 / np.pi) if volume.ndim == 3 else np.sqrt(n * 4 / np.pi), elongation=axes[:, -1] / axes[:, 0])


def detect_cells_3d(voxels: DataFrame, options: Detection = Detection(), by: Sequence[str] = ("sample_id", "channel")) -> DataFrame:
    """Cells (by, x, y, z, intensity, diameter, elongation): every tile with its halo
    is one task's dense block, and a cell counts where its centre is the tile's own."""

    columns = [*by, "x", "y", "z", "intensity", "diameter", "elongation"]

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(pdf[a] - 1) // size == pdf[f"t{a}"] for a, size in zip(AXES, (options.nz, options.nxy, options.nxy))]
        if not np.logical_and.reduce(own).any():  # nothing but halo, beyond the volume's end
            return pd.DataFrame(columns=columns)
        low = {a: int(pdf[a].min()) for a in AXES}
        dense = np.zeros([int(pdf[a].max()) - low[a] + 1 for a in AXES])
        dense[tuple((pdf[a] - low[a]).to_numpy() for a in AXES)] = pdf["value"]
        return _own_cells(dense, low, pdf.iloc[0], options, by)

    tiles = make_tiles(voxels, options, by)
    return tiles.groupBy(*by, "tz", "ty", "tx").applyInPandas(detect, _cell_columns(voxels, by))


def _cell_columns(df: DataFrame, by: Sequence[str]) -> str:
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return f"{kinds}, x double, y double, z double, intensity double, diameter double, elongation double"


def _own_cells(dense: np.ndarray, low: dict[str, int], head: pd.Series, options: Detection, by: Sequence[str]) -> pd.DataFrame:
    """The cells of a dense block that begins at low whose centres are the tile's own."""
    found = find_blobs(dense, options)
    keep = np.ones(len(found), bool)
    for a, size in zip(AXES, (options.nz, options.nxy, options.nxy)):
        found[a] += low[a]
        begin = int(head[f"t{a}"]) * size + 1
        keep &= (found[a] >= begin - 0.5) & (found[a] < begin + size - 0.5)
    keep &= (found["elongation"] <= 2.5) & (found["diameter"] >= options.radius) & (found["diameter"] <= 8 * options.radius) & (found["intensity"] > 0)
    return found[keep].assign(**{c: head[c] for c in by})[[*by, "x", "y", "z", "intensity", "diameter", "elongation"]]


def plane_tiles(planes: DataFrame, options: Detection = Detection(), by: Sequence[str] = ("sample_id", "channel")) -> DataFrame:
    """Planes (by, z, ny, nx, data uint16) cut to the tiles that they lie in, halos
    included, clipped at the plane's edge: (by, tz, ty, tx, z, y0, x0, ny, nx, data).
    A voxel stays two bytes of a block; it is never a row."""
    hz, hy, hx = options.halo

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                plane = np.frombuffer(row.data, "<u2").reshape(row.ny, row.nx)
                out = []
                for tz in range(max(0, (row.z - 1 - hz) // options.nz), (row.z - 1 + hz) // options.nz + 1):
                    for ty in range(-(-row.ny // options.nxy)):
                        for tx in range(-(-row.nx // options.nxy)):
                            y0, x0 = max(0, ty * options.nxy - hy), max(0, tx * options.nxy - hx)
                            part = plane[y0 : (ty + 1) * options.nxy + hy, x0 : (tx + 1) * options.nxy + hx]
                            out.append((*(getattr(row, c) for c in by), tz, ty, tx, row.z, y0 + 1, x0 + 1, *part.shape, part.tobytes()))
                yield pd.DataFrame(out, columns=[*by, "tz", "ty", "tx", "z", "y0", "x0", "ny", "nx", "data"])

    kinds = ", ".join(f"{c} {planes.schema[c].dataType.simpleString()}" for c in by)
    return planes.select(*by, "z", "ny", "nx", "data").mapInPandas(cut, f"{kinds}, tz int, ty int, tx int, z int, y0 int, x0 int, ny int, nx int, data binary")


def cells_of_pieces(pieces: pd.DataFrame, head: pd.Series, options: Detection, by: Sequence[str]) -> pd.DataFrame:
    """The cells of one halo tile (head: by, tz, ty, tx) from its pieces of planes."""
    low = {"z": int(pieces["z"].min()), "y": int(pieces["y0"].min()), "x": int(pieces["x0"].min())}
    dense = np.zeros((int(pieces["z"].max()) - low["z"] + 1, int(pieces["ny"].max()), int(pieces["nx"].max())))
    for row in pieces.itertuples(index=False):
        dense[row.z - low["z"], : row.ny, : row.nx] = np.frombuffer(row.data, "<u2").reshape(row.ny, row.nx)
    return _own_cells(dense, low, head, options, by)


def detect_cells_in_planes(planes: DataFrame, options: Detection = Detection(), by: Sequence[str] = ("sample_id", "channel")) -> DataFrame:
    """detect_cells_3d from raw planes: a tile's pieces are stacked in one task; planes
    that are missing between two others are empty."""

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        if not ((pdf["z"] - 1) // options.nz == pdf["tz"]).any():
            return pd.DataFrame(columns=[*by, "x", "y", "z", "intensity", "diameter", "elongation"])
        return cells_of_pieces(pdf, pdf.iloc[0], options, by)

    return plane_tiles(planes, options, by).groupBy(*by, "tz", "ty", "tx").applyInPandas(detect, _cell_columns(planes, by))


def planes_of(voxels: DataFrame, ny: int, nx: int, by: Sequence[str] = ("sample_id", "channel")) -> DataFrame:
    """Planes (by, z, ny, nx, data uint16) of rows (by, y, x, z, value): values rounded
    and held in 0..65535, voxels that are not there 0, rows outside ny x nx left out."""
    at = ((F.col("y") - 1) * nx + F.col("x") - 1).cast("int")
    level = F.least(F.greatest(F.round("value", 0), F.lit(0.0)), F.lit(65535.0)).cast("int")
    inside = voxels.where(F.col("y").between(1, ny) & F.col("x").between(1, nx))
    lists = inside.groupBy(*by, "z").agg(F.collect_list(F.struct(at.alias("at"), level.alias("v"))).alias("v"))  # a plane's pixels

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for entries in b["v"]:
                plane = np.zeros(ny * nx, "<u2")
                plane[[e["at"] for e in entries]] = [e["v"] for e in entries]
                data.append(plane.tobytes())
            yield b[[*by, "z"]].assign(ny=ny, nx=nx, data=data)

    kinds = "".join(f"{c} {lists.schema[c].dataType.simpleString()}, " for c in [*by, "z"])
    return lists.mapInPandas(dense, f"{kinds}ny int, nx int, data binary")


def plane_voxels(planes: DataFrame, by: Sequence[str] = ("sample_id", "channel"), above: int = 0) -> DataFrame:
    """(by, y, x, z, value) of the voxels of planes that are greater than above."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                plane = np.frombuffer(row.data, "<u2").reshape(row.ny, row.nx)
                y, x = np.nonzero(plane > above)
                yield pd.DataFrame({**{c: getattr(row, c) for c in by}, "y": y + 1, "x": x + 1, "z": row.z, "value": plane[y, x].astype(float)})

    kinds = ", ".join(f"{c} {planes.schema[c].dataType.simpleString()}" for c in by)
    return planes.select(*by, "z", "ny", "nx", "data").mapInPandas(spread, f"{kinds}, y int, x int, z int, value double")


def union_tiles(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Detections of several tiles or runs as one table; columns that one lacks are null there."""
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def cell_mask(voxels: DataFrame, look: int, threshold: float, by: Sequence[str] = ("sample_id", "channel"), cube: int = 2) -> DataFrame:
    """Voxels of bright spots in DataFrame functions: maxima of their plane's box of
    +-look above threshold, and what lies within +-cube of one above 0.8 of it."""
    peaks = find_peaks(voxels, look, threshold, [*by, "z"], ("y", "x"), 1e-3)
    return dilate(peaks, cube, voxels, by, 0.8 * threshold)


def detect_cells_sql(voxels: DataFrame, look: int, threshold: float, size: Sequence[int], by: Sequence[str] = ("sample_id", "channel"), cube: int = 2, voxel_volume: float = 1.0, checkpoint=None) -> DataFrame:
    """Cells (by, x, y, z, n, intensity, diameter) without a band-pass: components of
    cell_mask, of a tenth to ten times the cube's voxels, by their weighted centres,
    more than a hundredth of the plane (size: y, x) away from its edge. The whole
    volume is one mask, so no cell is cut by a batch of planes."""
    parts = connected_components(cell_mask(voxels, look, threshold, by, cube), by, checkpoint=checkpoint)
    cells = size_filter(component_moments(parts, [*by, "component"]), float((2 * cube + 1) ** 3))
    for c, n in (("cy", size[0]), ("cx", size[1])):
        cells = cells.where((F.col(c) > 0.01 * n) & (F.col(c) < 0.99 * n))
    return cells.select(*by, F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "n", F.col("mean").alias("intensity"), equiv_radius("n", voxel_volume).alias("diameter"))


def rank_background(plane: np.ndarray, r: int, rank: float = 0.5) -> np.ndarray:
    """Rank filter over (2 r + 1) squares, mirrored at the edges, row by row."""
    p = np.pad(plane, r, "symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1))
    return np.stack([np.quantile(row.reshape(row.shape[0], -1), rank, axis=1) for row in windows])


def detect_cells_2d(planes: DataFrame, options: Detection = Detection(), by: Sequence[str] = ("sample_id", "channel", "z")) -> DataFrame:
    """Cells of each section (by, x, y, intensity, diameter, circularity): rank
    background, ratio, peaks, components. planes: (by, y, x, value), a section a task."""

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        dense = np.zeros((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1))
        dense[(pdf["y"] - y0).to_numpy(), (pdf["x"] - x0).to_numpy()] = pdf["value"]
        back = rank_background(dense, max(2, int(2 * options.radius)))
        ratio = np.where(back > 0, (dense - back) / np.where(back > 0, back, 1), 0)
        found = find_blobs(np.maximum(ratio, 0), options)
        found = found.assign(x=found["x"] + x0, y=found["y"] + y0, circularity=1 / np.maximum(found["elongation"], 1))
        keep = (found["circularity"] >= 0.7) & (found["diameter"] >= options.radius / 2)
        head = pdf.iloc[0]
        return found[keep].assign(**{c: head[c] for c in by})[[*by, "x", "y", "intensity", "diameter", "circularity"]]

    kinds = ", ".join(f"{c} {planes.schema[c].dataType.simpleString()}" for c in by)
    return planes.groupBy(*by).applyInPandas(detect, f"{kinds}, x double, y double, intensity double, diameter double, circularity double")


def candidate_views(cells: DataFrame, voxels: DataFrame, half: int, by: Sequence[str] = ("sample_id", "channel"), key: str = "cell_id") -> DataFrame:
    """(cell, view, u, v, value): three greatest-value projections of the box round
    each cell, u and v from -half to half; voxels outside the volume count as 0. Each voxel that
    holds cells is projected once, and its cells take the views from it."""
    steps = F.sequence(F.lit(-half), F.lit(half))
    at = cells.select(key, *by, *(F.round(F.col(a), 0).cast("int").alias(f"_{a}") for a in AXES))
    centre = [*by, *(f"_{a}" for a in AXES)]
    box = at.select(*centre).distinct()
    for a in AXES:
        box = box.withColumn(f"d{a}", F.explode(steps)).withColumn(a, (F.col(f"_{a}") + F.col(f"d{a}")).cast("int"))
    rows = box.join(voxels.select(*by, *AXES, "value"), [*by, *AXES], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    pick = lambda n, u, v: F.struct(F.lit(n).alias("view"), F.col(f"d{u}").alias("u"), F.col(f"d{v}").alias("v"))
    rows = rows.select(*centre, F.explode(F.array(pick("yx", "y", "x"), pick("zx", "z", "x"), pick("zy", "z", "y"))).alias("_p"), "value")
    rows = rows.groupBy(*centre, "_p").agg(F.max("value").alias("value"))
    # 3 (2 half + 1)^2 entries a voxel.
    views = rows.groupBy(*centre).agg(F.collect_list(F.struct("_p.*", "value")).alias("_views")).withColumnsRenamed({c: f"_at{c}" for c in centre})
    met = at.join(views.hint("merge"), reduce(and_, (F.col(c).eqNullSafe(F.col(f"_at{c}")) for c in centre)))
    return met.select(key, F.inline("_views"))


def preprocess_volume(planes: DataFrame, out: str, factor: int = 2, options: Detection = Detection()) -> tuple[DataFrame, DataFrame]:
    """Raw planes to two Parquet sinks below out: 'registration', planes as from
    preprocess_planes(), and 'tiles', the full-resolution planes, zeros filled and
    3 x 3 medians taken, cut to plane_tiles() by sample, channel and tile. Returns both as read back."""
    spark = planes.sparkSession
    preprocess_planes(planes, factor).write.mode("overwrite").partitionBy("sample_id", "channel").parquet(f"{out}/registration")
    plane_tiles(preprocess_planes(planes, 1), options).write.mode("overwrite").partitionBy("sample_id", "channel", "tz").parquet(f"{out}/tiles")
    return spark.read.parquet(f"{out}/registration"), spark.read.parquet(f"{out}/tiles")


def preprocess_planes(planes: DataFrame, factor: int = 2) -> DataFrame:
    """Raw planes (sample_id, channel, z, ny, nx, data uint16): zeros to the plane's
    mode, 3 x 3 median, and blocks of factor x factor averaged; one plane at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples():
                a = np.frombuffer(row.data, "<u2").reshape(row.ny, row.nx)
                pos = a[a > 0]
                if len(pos):
                    a = np.where(a == 0, np.bincount(pos).argmax(), a)
                a = rank_background(a, 1)
                cut = a[: row.ny // factor * factor, : row.nx // factor * factor]
                small = cut.reshape(row.ny // factor, factor, row.nx // factor, factor).mean((1, 3))
                out.append((row.sample_id, row.channel, row.z, small.shape[0], small.shape[1], np.round(small).astype("<u2").tobytes()))
            yield pd.DataFrame(out, columns=["sample_id", "channel", "z", "ny", "nx", "data"])

    return planes.select("sample_id", "channel", "z", "ny", "nx", "data").mapInPandas(run, "sample_id string, channel int, z int, ny int, nx int, data binary")
