"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are made in Arrow batches. Equal fingerprints are folded into one
representative first, so copies never meet in pairs. Representatives are laid
out in cells by the population counts of four 16-bit blocks; cells whose counts
differ by more than the radius in sum cannot hold a link and are never paired.
The cells that may link are compared tile against tile with numpy exclusive-or
and bit counts: exact, no candidate is dropped. A cell above `tile` rows is
split into several left tiles against which its partners stream in batches, so
that memory is bounded whatever the cell holds. Each tile returns a spanning
forest of the links that it found (at most one row per fingerprint that it
saw), and distributed connected components join these.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.llm.shared import components, table

BLOCKS, BLOCK_BITS = 4, 16
TILE = 8192
_CHUNK = 256


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, signed to fit a long. A-Z are lower-cased,
    words split at ASCII white space; a bit is set if it is set in over half the
    XXH64 of the shingles. No word: 0. Fewer words than a shingle: one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], np.uint64)
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) of every row; null and empty texts have fingerprint 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), shingle, seed) for t in texts], pa.int64())], names=[id_col, "fp"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


class Forest:
    """Union-find over ids; join() says whether the two were apart."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _links(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Index pairs (into left, into right or, if the flag is false, into left) that span every link between
    the two sides: for each right row its first match, and that match with the
    other left rows that match the same right row."""
    for i in range(0, len(left), _CHUNK):
        for j in range(0, len(right), 4096):
            near = np.bitwise_count(left[i : i + _CHUNK, None] ^ right[None, j : j + 4096]) <= radius
            hit = np.flatnonzero(near.any(0))
            if len(hit):
                near = near[:, hit]
                first = near.argmax(0)
                yield first + i, hit + j, True
                a, b = np.nonzero(near)
                pairs = np.unique(a * _CHUNK + first[b])
                yield pairs // _CHUNK + i, pairs % _CHUNK + i, False


def _compare(radius: int):
    """Rows (cell, sub, side, fp, rep), sorted: first the tile's own rows, side
    0, then the rows to compare them with. Returns a forest of links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, own_rep, forest = None, [], [], Forest()
        left = rep = None

        def found(right: np.ndarray, right_rep: np.ndarray) -> list[tuple[int, int]]:
            out = []
            for a, b, across in _links(left, right, radius):
                a, b = rep[a], (right_rep if across else rep)[b]
                out += [(x, y) for x, y in zip(a.tolist(), b.tolist()) if x != y and forest.join(x, y)]
            return out

        def out(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            a = np.array(rows, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        def closed() -> list[tuple[int, int]]:
            nonlocal left, rep
            if left is None and own:
                left, rep = np.concatenate(own), np.concatenate(own_rep)
                return found(left, rep)
            return []

        for batch in batches:
            cell, sub, side = (batch.column(i).to_numpy() for i in range(3))
            fp, ids = batch.column(3).to_numpy().view(np.uint64), batch.column(4).to_numpy()
            cuts = np.flatnonzero(np.diff(cell) | np.diff(sub) | np.diff(side)) + 1
            rows: list[tuple[int, int]] = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
                if s == e:
                    continue
                if (cell[s], sub[s]) != key:
                    rows += closed()
                    key, own, own_rep, left, rep, forest = (cell[s], sub[s]), [], [], None, None, Forest()
                if side[s] == 0:
                    own.append(fp[s:e])
                    own_rep.append(ids[s:e])
                elif own:
                    rows += closed()
                    rows += found(fp[s:e], ids[s:e])
            yield out(rows)
        yield out(closed())

    return run


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Steps between the counts of two cells that may link, one of each pair of opposite steps."""
    steps = [()]
    for _ in range(BLOCKS):
        steps = [(*s, d) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in steps if s > (0,) * BLOCKS]


def near_groups(fps: DataFrame, id_col: str = "doc_id", radius: int = 2, tile: int = TILE) -> DataFrame:
    """(fp, component) of every distinct fingerprint: the smallest id that can be
    reached over links of at most `radius` differing bits, itself included; null
    where no reachable row has an id."""
    base = 2**BLOCK_BITS
    reps = fps.groupBy("fp").agg(F.min(id_col).cast("long").alias("rep"))
    for i in range(BLOCKS):
        reps = reps.withColumn(f"c{i}", F.bit_count(F.shiftright("fp", i * BLOCK_BITS).bitwiseAND(base - 1)).cast("int"))
    cell = lambda cols: sum((c * (BLOCK_BITS + 1) ** i for i, c in enumerate(cols)), F.lit(0)).cast("int")
    counts = [F.col(f"c{i}") for i in range(BLOCKS)]
    reps = table(reps.withColumn("cell", cell(counts)), "fingerprints")
    # At most 17 ** 4 rows, whatever the input: it may be broadcast.
    cells = F.broadcast(reps.groupBy("cell").count().select("cell", F.ceil(F.col("count") / tile).cast("int").alias("subs")))
    placed = reps.where("rep is not null").join(cells, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    left = placed.select("cell", F.col("own").alias("sub"), F.lit(0).alias("side"), "fp", "rep")
    same = placed.where("own > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("sub"), F.lit(1).alias("side"), "fp", "rep")
    step = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in _offsets(radius))))
    moved = reps.where("rep is not null").select("fp", "rep", *counts, step.alias("step"))
    to = [F.col(f"c{i}") + F.col("step")[i] for i in range(BLOCKS)]
    inside = F.lit(True)
    for c in to:
        inside = inside & c.between(0, BLOCK_BITS)
    other = moved.where(inside).select(cell(to).alias("cell"), "fp", "rep").join(cells, "cell")
    other = other.select("cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(1).alias("side"), "fp", "rep")
    rows = left.unionByName(same).unionByName(other)
    rows = rows.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "side")
    links = rows.mapInArrow(_compare(radius), "a long, b long")
    groups = components(links, "a", "b")
    return reps.join(groups, reps["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id.

    Null or wordless texts have fingerprint zero and are linked like any other.
    Rows with a null id get the smallest id of their group, null if it has none.
    Repeated rows are returned as often as they come. Other columns are ignored;
    an empty table gives an empty result.
    """
    fps = table(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    groups = near_groups(fps, id_col, radius)
    return fps.join(groups, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
