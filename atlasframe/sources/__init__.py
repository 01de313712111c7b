"""Sources and sinks: raw planes, catalogs, text tables, settings, transforms, reports."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlasframe.functions import channel_name

#: Bytes of planes that a task reads at a time, about.
RUN_BYTES = 64 << 20


def read_raw_planes(spark: SparkSession, path: str, ny: int, nx: int, sample_id: str = "", channel: int = 1) -> DataFrame:
    """Headerless uint16 files of any length, plane after plane: planes(sample_id,
    channel, z, ny, nx, data). z goes on from file to file in natural order of their
    names (plane2 before plane10); a file whose length is no whole number of planes is
    an error. Spark lists the files; each task seeks to a run of planes of one file
    and reads these alone."""
    size = 2 * ny * nx
    files = natural_sort(spark.read.format("binaryFile").load(path).select("path", "length"), "path")
    rows, z = [], 0
    for name, length in files.collect():  # file names and lengths only
        if length % size:
            raise ValueError(f"{name} has {length} bytes, which is no multiple of a plane's {size}")
        rows.append((name, length // size, z))
        z += length // size
    run = max(1, RUN_BYTES // size)
    parts = spark.createDataFrame(rows, "path string, n long, z0 long").where("n > 0").select("path", "n", "z0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long"))).alias("at"))
    parts = parts.repartition(max(1, sum(-(-n // run) for _, n, _ in rows)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, n, z0, at in b.itertuples(index=False):
                fs, own = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with fs.open_input_file(own) as f:
                    for i in range(at, min(n, at + run)):
                        yield pd.DataFrame({"z": [z0 + i + 1], "data": [f.read_at(size, i * size)]})

    planes = parts.mapInPandas(read, "z int, data binary")
    return planes.select(F.lit(sample_id).alias("sample_id"), F.lit(channel).alias("channel"), "z", F.lit(ny).alias("ny"), F.lit(nx).alias("nx"), "data")


def plane_catalog(spark: SparkSession, path: str, ny: int, nx: int) -> DataFrame:
    """(path, length, planes) of raw files; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", (F.col("length") / (2 * ny * nx)).alias("planes"))


def shape_conflicts(df: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("ny", "nx")) -> DataFrame:
    """Groups whose rows differ in size: (keys, shapes)."""
    return df.groupBy(*keys).agg(F.count_distinct(*cols).alias("shapes")).where("shapes > 1")


def assert_uniform_shape(df: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("ny", "nx")) -> DataFrame:
    """df, or an error that names groups whose rows differ in size."""
    bad = shape_conflicts(df, keys, cols).take(5)
    if bad:
        raise ValueError(f"sizes differ within {[tuple(r) for r in bad]}")
    return df


def natural_sort(df: DataFrame, col: str) -> DataFrame:
    """Rows in order of the text and numbers of a column, numbers by value."""
    parts = F.regexp_extract_all(F.lower(col), F.lit(r"(\d+|\D+)"))
    key = F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), F.lit("0")).otherwise(p).alias("t"), F.coalesce(F.when(p.rlike(r"^\d"), p.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("n")))
    return df.withColumn("_k", key).orderBy("_k", col).drop("_k")


def order_channels(files: DataFrame, name: str = "name", by: Sequence[str] = ("folder",)) -> DataFrame:
    """Adds place (1, 2, ... within its folder, in order of the number in chan<n>,
    files without one first, equal ones by name) and channel: the rest of the file's
    name, else ch and its place."""
    rows = files.withColumn("_n", F.coalesce(F.regexp_extract(name, r"^chan(\d+)", 1).try_cast("int"), F.lit(0)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_n", name))).drop("_n")
    return rows.withColumn("channel", F.coalesce(channel_name(name), F.concat(F.lit("ch"), F.col("place").cast("string"))))


def read_z_window(tiles: DataFrame, z0: int, z1: int, halo: int = 0) -> DataFrame:
    return tiles.where(F.col("z").between(z0 - halo, z1 + halo))


def read_bbox(voxels: DataFrame, points: DataFrame, pad: int = 0) -> DataFrame:
    """Voxels of the box round the points: bounds first, then literal ranges that reach the scan."""
    b = points.agg(*(f(c) for c in "yxz" for f in (F.min, F.max))).first()
    if b[0] is None:
        return voxels.limit(0)
    for i, c in enumerate("yxz"):
        voxels = voxels.where(F.col(c).between(int(b[2 * i]) - pad, int(b[2 * i + 1] + 0.999999) + pad))
    return voxels


def select_channels(voxels: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The channels asked for; ids that are not there are dropped without a word."""
    return voxels.where(F.col("channel").isin(list(ids)))


def resolve_volume(explicit: str | None, channel: int | None, registration_channel: int, pattern: str) -> str:
    """Path of a volume: an explicit one, else that of the channel, else that of the registration channel."""
    return explicit or pattern.format(channel if channel is not None else registration_channel)


def read_parcel_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="region_id int, term_set string, name string, acronym string, red int, green int, blue int")


def read_region_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="id int, parent_id int, children string, name string, acronym string")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="segment string, start_z double, end_z double")


def atlas_registry(catalog: DataFrame, name: str) -> DataFrame:
    """The row (name, template, annotation, terms, resolution) of one atlas."""
    return catalog.where(F.col("name") == name)


def load_sample_points(points: DataFrame, sample: str, space: str) -> DataFrame:
    return points.where((F.col("sample_id") == sample) & (F.col("space") == space))


def load_background(table: DataFrame, value: str = "value") -> DataFrame:
    """Negative values as missing."""
    return table.withColumn(value, F.when(F.col(value) >= 0, F.col(value)))


def read_tile_xml(spark: SparkSession, path: str) -> DataFrame:
    """(ID, X, Y, level, values): acquisition tiles with their HS_n blocks as rows."""
    raw = spark.read.format("xml").option("rowTag", "Cell").load(path)
    blocks = sorted((c for c in raw.columns if c.startswith("HS_")), key=lambda c: int(c[3:]))
    packed = F.array(*(F.struct(F.lit(int(c[3:])).alias("level"), F.col(c).cast("string").alias("text")) for c in blocks))
    rows = raw.select("ID", "X", "Y", F.explode(packed).alias("b")).where("b.text is not null")
    return rows.select("ID", "X", "Y", "b.level", F.transform(F.split(F.trim("b.text"), r"[\s,]+"), lambda x: x.cast("double")).alias("values"))


def settings_table(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """(key, value): 'key = value' lines, comments from % or #, the last of a key
    counts; keys of the defaults that the file lacks keep theirs."""
    line = F.trim(F.regexp_replace("value", r"[%#].*$", ""))
    text = spark.read.text(path).select(line.alias("l"), F.monotonically_increasing_id().alias("n")).where("l like '%=%'")
    own = text.select(F.trim(F.substring_index("l", "=", 1)).alias("key"), F.trim(F.regexp_replace("l", r"^[^=]*=", "")).alias("value"), "n")
    own = own.groupBy("key").agg(F.max_by("value", "n").alias("value"))
    base = spark.createDataFrame(list(defaults.items()) or [], "key string, default string")
    return base.join(own, "key", "full").select("key", F.coalesce("value", "default").alias("value"))


def read_slice_decisions(spark: SparkSession, path: str | None, n: int) -> DataFrame:
    """The tab-separated decisions, or n slices in order and unturned."""
    if path:
        return spark.read.csv(path, sep="\t", header=True, schema="original_index int, flip_state int, new_order_original_index int")
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("original_index"), F.lit(0).alias("flip_state"), F.col("id").cast("int").alias("new_order_original_index"))


def transforms_from_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, m): registration text files '(Name v ...)' as 4 x 4 row-major
    matrices: translation, Euler, similarity (versor and scale) and affine, about
    their centre of rotation; other kinds are an error when read."""
    field = lambda n: F.regexp_extract("value", rf"\({n}\s+([^)]*)\)", 1)
    numbers = lambda n: F.transform(F.filter(F.split(F.trim(field(n)), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    # The file's name is not deterministic. Beside the numbers it keeps filters on m (exploding it
    # makes one) above them; below, the text would be split anew for each use of a number.
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace(field("Transform"), '"', "").alias("kind"), numbers("TransformParameters").alias("p"), numbers("CenterOfRotationPoint").alias("c"))
    p = lambda i: F.get("p", F.lit(i))
    one = [F.lit(float(i == j)) for i in range(3) for j in range(3)]
    cx, sx, cy, sy, cz, sz = F.cos(p(0)), F.sin(p(0)), F.cos(p(1)), F.sin(p(1)), F.cos(p(2)), F.sin(p(2))
    euler = [cz * cy - sz * sx * sy, -sz * cx, cz * sy + sz * sx * cy, sz * cy + cz * sx * sy, cz * cx, sz * sy - cz * sx * cy, -cx * sy, sx, cx * cy]
    w = F.sqrt(F.greatest(1 - p(0) ** 2 - p(1) ** 2 - p(2) ** 2, F.lit(0.0)))
    turn = [1 - 2 * (p(1) ** 2 + p(2) ** 2), 2 * (p(0) * p(1) - p(2) * w), 2 * (p(0) * p(2) + p(1) * w), 2 * (p(0) * p(1) + p(2) * w), 1 - 2 * (p(0) ** 2 + p(2) ** 2), 2 * (p(1) * p(2) - p(0) * w), 2 * (p(0) * p(2) - p(1) * w), 2 * (p(1) * p(2) + p(0) * w), 1 - 2 * (p(0) ** 2 + p(1) ** 2)]
    kinds = {"TranslationTransform": (one, 0), "EulerTransform": (euler, 3), "SimilarityTransform": ([x * p(6) for x in turn], 3), "AffineTransform": ([p(i) for i in range(9)], 9)}

    def matrix(r: list, at: int):
        c = [F.coalesce(F.get("c", F.lit(i)), F.lit(0.0)) for i in range(3)]
        shift = [p(at + i) + c[i] - sum((r[3 * i + k] * c[k] for k in range(3)), F.lit(0.0)) for i in range(3)]
        return F.array(*(x for i in range(3) for x in (*r[3 * i : 3 * i + 3], shift[i])), *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))

    m = F.raise_error(F.concat(F.lit("no linear transform: "), "kind")).cast("array<double>")
    for kind, (r, at) in kinds.items():
        m = F.when(F.col("kind") == kind, matrix(r, at)).otherwise(m)
    return rows.select("path", "kind", m.alias("m"))


def region_intensities(stats: DataFrame, names: DataFrame, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Report rows (by, name, region_id, right and left intensity and volume) from (channel, region_id, side, signal, volume)."""
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = stats.groupBy(*by, "region_id").agg(at("R", "signal").alias("right_side_intensity"), at("L", "signal").alias("left_side_intensity"), at("R", "volume").alias("right_side_volume"), at("L", "volume").alias("left_side_volume"))
    return wide.join(names, "region_id", "left")


def region_cell_counts(stats: DataFrame, names: DataFrame, by: Sequence[str] = ("channel",)) -> DataFrame:
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = stats.groupBy(*by, "region_id").agg(at("R", "n").alias("right_side_count"), at("L", "n").alias("left_side_count"), at("R", "volume").alias("right_side_volume"), at("L", "volume").alias("left_side_volume"))
    return wide.join(names, "region_id", "left")


def write_by_channel(report: DataFrame, path: str) -> None:
    """A CSV folder per channel."""
    report.write.mode("overwrite").partitionBy("channel").option("header", True).csv(path)


def write_points(points: DataFrame, path: str, cols: Sequence[str] = ("x", "y", "z")) -> None:
    """Coordinates as text with ten decimals."""
    points.select(F.format_string(" ".join(["%.10f"] * len(cols)), *(F.col(c).cast("double") for c in cols)).alias("value")).write.mode("overwrite").text(path)


def write_volume(voxels: DataFrame, path: str, block: int = 32) -> None:
    """Parquet by sample, channel and block of planes; rows of a block sorted for pruning."""
    rows = voxels.withColumn("z_block", F.floor((F.col("z") - 1) / block).cast("int"))
    rows.repartition("sample_id", "channel", "z_block").sortWithinPartitions("z", "y", "x").write.mode("overwrite").partitionBy("sample_id", "channel", "z_block").parquet(path)
