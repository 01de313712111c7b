"""Streams of a running acquisition; the same functions serve batches."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.operators.tiles import Detection, cells_of_pieces, plane_tiles


def detection_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Detections and mean value per sample and tumbling window; rows later than `late` are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "sample_id")
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "sample_id", "n", "mean")


def sliding_background(events: DataFrame, length: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean value per sample over sliding windows, and the last value's difference to it, relative to it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "sample_id")
    out = w.agg(F.avg("value").alias("background"), F.max_by("value", F.struct("ts", "value")).alias("last"))
    relative = F.when(F.col("background") != 0, (F.col("last") - F.col("background")) / F.col("background")).otherwise(0.0)
    return out.select(F.col("window.start").alias("start"), "sample_id", "background", relative.alias("relative"))


def sample_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of each sample's events with no pause of gap or more."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "sample_id")
    return w.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "sample_id", "n")


def dedupe(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A cell seen in two overlapping tiles once: by sample, channel and rounded voxel,
    with state no older than the watermark."""
    keyed = events.withWatermark("ts", late).withColumns({f"_{c}": F.round(F.col(c), 0).cast("int") for c in "xyz"})
    keys = ["sample_id", "channel", "_x", "_y", "_z"]
    out = keyed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else keyed.dropDuplicates(keys)
    return out.drop("_x", "_y", "_z")


def running_total(events: DataFrame) -> DataFrame:
    """Detections so far per sample (complete mode: state is one row a sample)."""
    return events.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def plane_files(spark: SparkSession, folder: str, ny: int, nx: int, sample_id: str = "", channel: int = 1, per_batch: int = 64) -> DataFrame:
    """A stream of planes(sample_id, channel, z, ny, nx, data) from a folder that an
    acquisition writes one raw uint16 plane a file to; z is the last number of the
    file's name. Files of another length are left out, as they are not finished."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(folder)
    number = F.regexp_extract(F.substring_index("path", "/", -1), r"(\d+)\D*$", 1).cast("int")
    planes = files.where(F.col("length") == 2 * ny * nx)
    return planes.select(F.lit(sample_id).alias("sample_id"), F.lit(channel).alias("channel"), number.alias("z"), F.lit(ny).alias("ny"), F.lit(nx).alias("nx"), F.col("content").alias("data"))


def stream_cells(planes: DataFrame, n_planes: int, options: Detection = Detection(), by: Sequence[str] = ("sample_id", "channel")) -> DataFrame:
    """The cells of a stream of planes (by, z, ny, nx, data) of an acquisition of n_planes
    planes, as tiles.detect_cells_in_planes finds them in all planes at once.

    State is kept for each halo tile: the pieces of planes that have come, in any
    order and over any batches, a repeated one once. When the last piece of a tile with its halo
    is there the tile is searched, its cells leave and its pieces are dropped; so
    state holds the tiles that the acquisition is in, and no cell is cut by a batch.
    A tile of which a plane never comes is never searched. For a table that is no
    stream use tiles.detect_cells_in_planes.
    """
    nz, hz = options.nz, options.halo[0]
    columns = [*by, "x", "y", "z", "intensity", "diameter", "elongation"]
    keys = [*by, "tz", "ty", "tx"]

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tz = key[len(by)]
        wanted = set(range(max(1, tz * nz + 1 - hz), min(n_planes, (tz + 1) * nz + hz) + 1))
        have = dict(zip(*state.get)) if state.exists else {}
        done = have.get(0) is not None
        for b in batches:
            for row in b.itertuples(index=False):
                have.setdefault(row.z, struct.pack("<4i", row.y0, row.x0, row.ny, row.nx) + row.data)
        if done or not wanted <= have.keys():
            if not done:
                state.update((list(have), list(have.values())))
            return
        state.update(([0], [b""]))  # searched: pieces that come again change nothing
        if tz * nz + 1 > n_planes:
            return
        pieces = [(z, *struct.unpack_from("<4i", have[z]), have[z][16:]) for z in sorted(wanted)]
        found = cells_of_pieces(pd.DataFrame(pieces, columns=["z", "y0", "x0", "ny", "nx", "data"]), pd.Series(dict(zip(keys, key))), options, by)
        if len(found):
            yield found[columns]

    pieces = plane_tiles(planes, options, by)
    kinds = ", ".join(f"{c} {planes.schema[c].dataType.simpleString()}" for c in by)
    out = f"{kinds}, x double, y double, z double, intensity double, diameter double, elongation double"
    return pieces.groupBy(*keys).applyInPandasWithState(gather, out, "zs array<int>, pieces array<binary>", "append", "NoTimeout")


def stream_planes(planes: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, late: str | None = None):
    """Start a query that runs job on each batch of planes and appends its rows as
    Parquet; the batch number in the path makes a repeated batch overwrite itself."""

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = planes.withWatermark("ts", late) if late else planes
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
