"""Near-duplicate documents (five-word shingles, Jaccard 0.8 or more) by wide
SimHash fingerprints, compared tile against tile and verified exactly.

The 64-bit fingerprint with two differing bits finds texts that are all but
equal. For a similarity of 0.8 the fingerprint is widened to 256 bits over the
set of shingles and links at up to `radius` bits are candidates. Texts of this
similarity hold shingle counts within a factor 0.8, so that tiles are cut by
count and those whose counts differ by more are never paired; within a pair the
numpy comparison is complete. A first pass finds the documents that have any
candidate. Only these are dealt again, with their shingle sets, and every
candidate pair is decided by the exact Jaccard similarity before it is left out
or joined: a pair is skipped only where verified links of its tile join its ends
already. Each tile returns a spanning forest of verified links (linear in the
tile, whatever the size of a group of copies), and connected components over
them are the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.llm.shared import components, drop_table, table
from atlasframe.llm.simhash import Forest

SHINGLE, SIMILARITY = 5, 0.8
LANES, RADIUS = 4, 54
#: Fingerprints of few shingles scatter more: up to so many shingles the radius is this one at least.
SHORT, SHORT_RADIUS = 64, 80
TILE = 32_768
_CHUNK = 256
#: Shingles of the left rows that a tile holds at most while pairs are decided.
TILE_SHINGLES = 1 << 22


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the shingles of a text, A-Z lower-cased; of fewer words
    than a shingle, the one sequence; of no word, none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    return np.unique(np.array(list(map(xxhash.xxh64_intdigest, grams)), np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LANES 64-bit parts; each lane mixes the hashes anew."""
    out = np.zeros(LANES, np.int64)
    for lane in range(LANES):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * lane) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        count = np.zeros(64, np.int64)
        for i in range(0, len(x), 4096):
            count += np.unpackbits(x[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[lane] = np.packbits(count * 2 > len(x), bitorder="little").view(np.int64)[0]
    return out


def _fingerprints(docs: DataFrame) -> DataFrame:
    """(id, n, f0..f3, h) of (id, text); h is a hash of the whole set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(1).cast(pa.binary())]
            fp = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(-1, LANES)
            h = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, sets)), pa.int64()), *(pa.array(fp[:, i]) for i in range(LANES)), pa.array(h)], names=["id", "n", *(f"f{i}" for i in range(LANES)), "h"])

    return docs.mapInArrow(run, "id long, n long, " + ", ".join(f"f{i} long" for i in range(LANES)) + ", h long")


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of left, row of right, distance) of all pairs within the radius, in blocks."""
    for i in range(0, len(left), _CHUNK):
        for j in range(0, len(right), 4096):
            a, b = left[i : i + _CHUNK], right[j : j + 4096]
            # Two lanes rule out nearly all pairs; the sum over lanes only grows.
            part = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
            part += np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
            if radius > RADIUS:  # two lanes would rule out too little
                part += np.bitwise_count(a[:, None, 2] ^ b[None, :, 2])
            x, y = np.nonzero(part <= radius)
            d = part[x, y].astype(np.int32)
            for lane in range(3 if radius > RADIUS else 2, LANES):
                d += np.bitwise_count(a[x, lane] ^ b[y, lane])
            keep = d <= radius
            yield x[keep] + i, y[keep] + j, d[keep]


def _over_tiles(out_schema: pa.Schema, found, carried: int):
    """A function of batches of rows (cell, sub, side, rep, lanes, ...), sorted: a
    tile's own rows, side 0, then the rows to compare them with. Of each it keeps
    (fingerprints, ids, column `carried` or None) and yields, as one batch per
    input batch, what found(left, right, forest, cell) returns; right is left for
    a tile's own pairs, and the forest is the tile's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, left, forest = None, [], None, Forest()

        def closed() -> list[tuple]:
            nonlocal left, own
            if left is None and own:
                fps, ids, more = zip(*own)
                left, own = (np.concatenate(fps), np.concatenate(ids), [x for m in more for x in m]), []
                return found(left, left, forest, key[0])
            return []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            a = np.array(rows, np.int64).reshape(-1, len(out_schema))
            return pa.RecordBatch.from_arrays([pa.array(a[:, i]) for i in range(a.shape[1])], schema=out_schema)

        for batch in batches:
            cell, sub, side = (batch.column(i).to_numpy() for i in range(3))
            fps = np.stack([batch.column(4 + i).to_numpy() for i in range(LANES)], axis=1).view(np.uint64)
            reps = batch.column(3).to_numpy()
            cuts = np.flatnonzero(np.diff(cell) | np.diff(sub) | np.diff(side)) + 1
            rows: list[tuple] = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
                if s == e:
                    continue
                if (cell[s], sub[s]) != key:
                    rows += closed()
                    key, own, left, forest = (cell[s], sub[s]), [], None, Forest()
                more = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(carried)[s:e]] if carried else []
                part = fps[s:e], reps[s:e], more
                if side[s] == 0:
                    own.append(part)
                elif own or left:
                    rows += closed()
                    rows += found(left, part, forest, key[0])
            yield out(rows)
        yield out(closed())

    return run


def _with_candidate(radius: Callable[[int], int]):
    """(rep) of rows that have another one within the radius."""

    def found(left, right, forest, cell) -> list[tuple]:
        a, b = np.zeros(len(left[0]), bool), np.zeros(len(right[0]), bool)
        for x, y, _ in _near(left[0], right[0], radius(cell)):
            real = left[1][x] != right[1][y]
            a[x[real]] = b[y[real]] = True
        return [(i,) for i in np.union1d(left[1][a], right[1][b]).tolist()]

    return _over_tiles(pa.schema([("rep", pa.int64())]), found, 0)


def _decide(radius: Callable[[int], int], similarity: float):
    """(a, b): links of at least the similarity that join all that any such pair
    within the radius joins."""

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common >= similarity * (len(x) + len(y) - common)

    def found(left, right, forest, cell) -> list[tuple]:
        (_, ids, sets), (_, right_ids, right_sets) = left, right
        n, right_n = np.array(list(map(len, sets))), np.array(list(map(len, right_sets)))
        out: list[tuple] = []

        def roots(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
            some, at = np.unique(rows, return_inverse=True)
            return np.array([forest.root(i) for i in of[some].tolist()], np.int64)[at]

        for x, y, d in _near(left[0], right[0], radius(cell)):
            few, many = np.minimum(n[x], right_n[y]), np.maximum(n[x], right_n[y])
            real = (few >= similarity * many) & (x < y if right is left else ids[x] != right_ids[y])
            x, y, d = x[real], y[real], d[real]
            order = np.lexsort((d, y))
            x, y, most = x[order], y[order], 1
            # Each right row tries its nearest one, then twice as many, of those that are still apart from it.
            while len(x):
                apart = roots(x, ids) != roots(y, right_ids)
                x, y = x[apart], y[apart]
                start = np.unique(y, return_index=True)[1]
                now = np.arange(len(y)) - np.repeat(start, np.diff(np.append(start, len(y)))) < most
                for i, j in zip(x[now].tolist(), y[now].tolist()):
                    p, q = int(ids[i]), int(right_ids[j])
                    if forest.root(p) != forest.root(q) and similar(sets[i], right_sets[j]):
                        forest.join(p, q)
                        out.append((p, q))
                x, y, most = x[~now], y[~now], most * 2
        return out

    return _over_tiles(pa.schema([("a", pa.int64()), ("b", pa.int64())]), found, 4 + LANES)


def _tiles(reps: DataFrame, similarity: float, tile: int, shingles: int | None = None) -> DataFrame:
    """Rows (cell, sub, side, rep, f0.., further columns) of (rep, n, f0.., ...) in tiles of at
    most about so many left rows and, if given, shingles."""
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(-float(np.log(similarity)))).cast("int")
    reps = reps.withColumn("cell", band)
    subs = F.ceil(F.count("*") / tile)
    subs = F.greatest(subs, F.ceil(F.sum("n") / shingles)) if shingles else subs
    # Bands are logarithms of counts: some hundred at most, whatever the input.
    cells = F.broadcast(reps.groupBy("cell").agg(subs.cast("int").alias("subs")))
    more = [c for c in reps.columns if c not in ("cell", "n", "rep")]
    placed = reps.join(cells, "cell").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    to = lambda last: F.explode(F.sequence(F.lit(0), last)).alias("sub")
    left = placed.select("cell", F.col("own").alias("sub"), F.lit(0).alias("side"), "rep", *more)
    same = placed.where("own > 0").select("cell", to(F.col("own") - 1), F.lit(1).alias("side"), "rep", *more)
    below = reps.withColumn("cell", F.col("cell") - 1).join(cells, "cell").select("cell", to(F.col("subs") - 1), F.lit(1).alias("side"), "rep", *more)
    return left.unionByName(same).unionByName(below).repartition("cell", "sub").sortWithinPartitions("cell", "sub", "side")


def verified_links(reps: DataFrame, docs: DataFrame, similarity: float, radius: int, tile: int) -> DataFrame:
    """(a, b) between representatives (rep, n, f0..): a forest per tile over all pairs within
    the radius whose texts have at least the similarity."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in b.column(1).cast(pa.binary())], pa.binary())], names=["rep", "set"])

    def within(cell: int) -> int:
        # A cell's smallest count; its rows meet larger ones only.
        least = similarity ** -float(cell)
        return max(radius, SHORT_RADIUS) if least <= SHORT else radius

    lanes = [f"f{i}" for i in range(LANES)]
    reps = reps.select("rep", "n", *lanes)
    near = table(_tiles(reps, similarity, tile).mapInArrow(_with_candidate(within), "rep long").distinct(), "candidates")
    one = docs.join(near.select(F.col("rep").alias("id")), "id", "left_semi").mapInArrow(sets, "rep long, set binary")
    rows = table(reps.join(one, "rep"), "shingles")
    links = table(_tiles(rows, similarity, tile, TILE_SHINGLES).mapInArrow(_decide(within, similarity), "a long, b long"), "links")
    drop_table(near)
    drop_table(rows)
    return links


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, group_id) of every id that is not the smallest of its group.

    docs may have any further columns, which are ignored. Equal shingle sets are one representative, the smallest id. Ids are integers
    and identify rows; rows with a null id are in no group. Texts without a word
    are equal to each other. An empty table gives an empty result."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    lanes = [f"f{i}" for i in range(LANES)]
    fps = table(_fingerprints(docs), "wide")
    reps = table(fps.groupBy(*lanes, "n", "h").agg(F.min("id").alias("rep")), "wide-reps")
    links = verified_links(reps, docs, similarity, radius, tile)
    found = components(links, "a", "b")
    drop_table(links)
    heads = reps.join(found, reps["rep"] == found["node"], "left").select(*lanes, "n", "h", F.coalesce("component", "rep").alias("group_id"))
    out = table(fps.join(heads, [*lanes, "n", "h"]).where("id <> group_id").select(F.col("id").alias(id_col), "group_id"), "groups")
    for done in (fps, reps, found):
        drop_table(done)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, without those that have a smaller id in their group.
    Rows with a null id stay, and so do repeated rows of an id that stays (an id is
    one document). Null, empty and white-space texts are one group. Very long texts
    are compared whole; an empty table gives an empty result."""
    gone = groups(docs, id_col, text_col, **options).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
