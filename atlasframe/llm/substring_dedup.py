"""Removal of repeated passages: compressed FM-indexes over shards.

A window of 50 words that starts in a document with a smaller id is a repeat.
Work goes only where repeats can be, and every step spreads by content:

1. Runs. Each window has an anchor, the least hash of its 12-word grams, which
   equal windows share. Consecutive windows of one anchor form a run; only runs
   whose anchor occurs in two documents or more go on. Equal runs are folded into
   the one of the smallest id: the others repeat it whole.
2. Shards. The words of the runs that stay are fetched once and sharded by
   anchor, so a window meets all its equals in one shard. A shard builds an
   FM-index over its runs (Burrows-Wheeler transform in a wavelet matrix), its
   runs are streamed through it by backward search, and intervals whose matching
   statistics reach 50 words in a document with a smaller id are reported.
3. Hot anchors. An anchor with more than `hot` different runs or more words in
   them than a shard (a passage in a third of all documents, each with its own
   surroundings, or a text that repeats one line without end) has its runs cut into
   single windows, sharded by the windows' own hash and folded in the same way,
   so that no shard grows with it.
4. Intervals are gathered by document and the covered words are taken out.

Words are compared by 64-bit hash; runs and windows that are folded must agree in
two 64-bit hashes, that of their anchor and that of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.llm.fm_index import FmIndex, covered
from atlasframe.llm.shared import drop_table, table, unused

WINDOW, GRAM = 50, 12
#: Words of one shard, on average, and of one anchor's runs at most; different runs of one anchor beyond which it is cut into windows.
SHARD_WORDS, HOT = 300_000, 2_000
#: Words whose hashes a task keeps; it starts afresh beyond it.
CACHE = 250_000
_BASE = 0x9E3779B97F4A7C15 | 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > CACHE:
        _hashes.clear()
    return np.array(list(map(_hashes.__getitem__, words)), np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Grams:
    """Hashes of any stretch of a document's words from one running sum."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes) + 1
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(hashes * _powers(_BASE, n)[:-1], out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), n)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def runs(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, run hash, first word, end word) of the runs of one text."""
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 4
    grams = _Grams(hash_words(words))
    at = np.arange(len(words) - gram + 1)
    anchor = _sliding_min(grams.hash(at, at + gram), window - gram + 1)
    start = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    end = np.concatenate([start[1:], [len(anchor)]]) + window - 1
    return anchor[start].view(np.int64), grams.hash(start, end).view(np.int64), start, end


def _all_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, run, id, tie, a, b) of all documents; words a to b."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(t.split(), window, gram) for t in b.column(2).cast(pa.binary()).to_pylist()]
            sizes = [len(f[0]) for f in found]
            cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)]
            at = pa.array(np.repeat(np.arange(len(found)), sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                names=["anchor", "run", "id", "tie", "a", "b"],
            )

    rows = docs.where("id is not null and text is not null").select("id", "tie", "text")
    return rows.mapInArrow(run, f"anchor long, run long, id {docs.schema['id'].dataType.simpleString()}, tie long, a int, b int")


def _with_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted runs, as hashes: (anchor, run, id, words), hot ones as
    their different windows: (anchor, run, id, words null, at, sub), at being the
    places of a window in its run."""
    per_doc = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("anchor", "run", "hot", "a", "b")).alias("wanted"))
    rows = docs.select("id", "tie", "text").join(per_doc, ["id", "tie"]).select("id", "text", "wanted")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                out: list[tuple] = []
                for doc_id, text, want in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                    hashes = hash_words(text.split())
                    grams = _Grams(hashes) if any(w["hot"] for w in want) else None
                    for w in want:
                        if w["hot"]:
                            at = np.arange(w["a"], w["b"] - window + 1)
                            subs, which = np.unique(grams.hash(at, at + window).view(np.int64), return_inverse=True)
                            places = np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])
                            out += [(w["anchor"], w["run"], doc_id, None, p.tolist(), h) for p, h in zip(places, subs.tolist())]
                        else:
                            out.append((w["anchor"], w["run"], doc_id, hashes[w["a"] : w["b"]].tobytes(), None, None))
                cols = list(zip(*out)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), part.schema.field(0).type, pa.binary(), pa.list_(pa.int32()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "run", "id", "words", "at", "sub"])

    return rows.mapInArrow(run, f"anchor long, run long, id {docs.schema['id'].dataType.simpleString()}, words binary, at array<int>, sub long")


def _search(window: int):
    """One shard: FM-index over its runs, each run streamed through it."""

    def run(shard: pa.Table) -> pa.Table:
        words = [np.frombuffer(w, np.uint64) for w in shard["words"].to_pylist()]
        sizes = np.array([len(w) for w in words])
        owner = np.unique(shard["id"].to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int32)
        flat = np.concatenate(words)
        index = FmIndex(flat, sizes, owner)
        which, start, end = covered(index, index.codes(flat), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, owner, window)
        at = pa.array(which)
        return pa.table({"anchor": shard["anchor"].take(at), "run": shard["run"].take(at), "from": pa.array(start, pa.int32()), "to": pa.array(end, pa.int32())})

    return run


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(id, tie, cuts array of (a, b)): stretches of words that lie in windows found in
    a document with a smaller id, a row for each run. docs: (id, tie, text)."""
    every = table(_all_runs(docs, window, gram), "runs")
    shared = every.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    kept = table(every.join(shared, "anchor"), "shared-runs")
    drop_table(every)

    one = kept.groupBy("anchor", "run").agg(F.min(F.struct("id", "tie", "a", "b")).alias("x"))
    one = table(one.select("anchor", "run", "x.*"), "different-runs")
    several = one.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("b") - F.col("a")).alias("size")).where("n > 1")
    wanted = one.join(several.select("anchor", ((F.col("n") > hot) | (F.col("size") > shard_words)).alias("hot")), "anchor")
    texts = table(_with_words(docs, wanted, window), "run-words")

    words = texts.where("words is not null").agg(F.sum(F.length("words"))).first()[0] or 0
    shards = int(words // (8 * shard_words)) + 1
    cold = texts.where("words is not null").select("anchor", "run", "id", "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"))
    found = cold.groupBy("shard").applyInArrow(_search(window), "anchor long, run long, `from` int, `to` int")
    single = texts.where("sub is not null")
    least = single.groupBy("anchor", "sub").agg(F.min("id").alias("lo"))
    hits = single.join(least, ["anchor", "sub"]).where("lo < id")
    # Windows one after the other are one stretch; a run's stretches are one row.
    hits = hits.groupBy("anchor", "run").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    before, after = (lambda i, s=s: F.get("at", (i + s).cast("int")) for s in (-1, 1))
    starts = F.filter("at", lambda x, i: F.coalesce(x - before(i) > 1, F.lit(True)))
    ends = F.filter("at", lambda x, i: F.coalesce(after(i) - x > 1, F.lit(True)))
    hits = hits.select("anchor", "run", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("from"), (b + window).alias("to"))).alias("parts"))
    found = found.groupBy("anchor", "run").agg(F.collect_list(F.struct("from", "to")).alias("parts")).unionByName(hits)

    first = one.select("anchor", "run", F.col("id").alias("first"))
    placed = kept.join(first, ["anchor", "run"])
    whole = placed.where("id > first").select("id", "tie", F.array(F.struct("a", "b")).alias("cuts"))
    moved = F.transform("parts", lambda p: F.struct((F.col("a") + p["from"]).alias("a"), (F.col("a") + p["to"]).alias("b")))
    partly = placed.where("id = first").join(found, ["anchor", "run"]).select("id", "tie", moved.alias("cuts"))
    found = table(whole.unionByName(partly), "repeats")
    for done in (kept, one, texts):
        drop_table(done)
    return found


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of one id and one text share their result; those of one id with
    different texts are told apart by the text's hash."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0)).alias("tie"), F.col(text_col).cast("string").alias("text"))


def kept_words(text: bytes, cuts: list[dict] | None) -> tuple[list[bytes], int]:
    words = text.split()
    if not cuts:
        return words, len(words)
    keep = np.ones(len(words), bool)
    for c in cuts:
        keep[c["a"] : c["b"]] = False
    return [w for w, k in zip(words, keep.tolist()) if k], len(words)


def _gathered(docs: DataFrame, keyed: DataFrame, **options) -> DataFrame:
    cuts = repeats(keyed, **options).groupBy("id", "tie").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    return docs.join(cuts, ["id", "tie"], "left")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row.

    Words split at ASCII white space; null and empty texts have none; very long texts
    are taken whole. Rows with a null id
    lose nothing and are no source of repeats; a document with an equal id is no
    smaller one. Repeated rows are returned as often as they come; other columns
    are ignored; an empty table gives an empty result.
    """
    keyed = _keyed(docs, id_col, text_col)
    rows = _gathered(keyed, keyed, **options).select("id", F.coalesce("text", F.lit("")).alias("text"), "cuts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, cuts in zip(b.column(1).cast(pa.binary()), b.column(2)):
                kept, n = kept_words(text.as_py(), cuts.as_py())
                out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, with repeated words taken out of their texts; texts that
    lose none stay as they are, the others are their kept words joined by one
    space. Documents that lose every word are dropped. Null, empty and very long
    texts, null ids, repeated rows and empty tables are dealt with as by digests();
    columns may have any names."""
    keyed = _keyed(docs, id_col, text_col)
    own_id, own_tie, own_cuts, row_tie = (unused(docs.columns, f"_{n}") for n in ("id", "tie", "cuts", "own"))
    cuts = repeats(keyed, **options).groupBy("id", "tie").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    cuts = cuts.select(F.col("id").alias(own_id), F.col("tie").alias(own_tie), F.col("cuts").alias(own_cuts))
    tie = F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0))
    rows = docs.withColumn(row_tie, tie)
    rows = rows.join(cuts, (rows[id_col] == cuts[own_id]) & (rows[row_tie] == cuts[own_tie]), "left").select(*docs.columns, own_cuts)
    names = docs.columns
    at, width = names.index(text_col), len(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[bytes | None] = []
            for text, cuts in zip(b.column(at).cast(pa.binary()), b.column(width)):
                text = text.as_py()
                if text is not None and cuts.is_valid:
                    text = b" ".join(kept_words(text, cuts.as_py())[0])
                    texts.append(text or b"\0")
                else:
                    texts.append(text)
            gone = [t == b"\0" and c.is_valid for t, c in zip(texts, b.column(width))]
            columns = [pa.array(texts, pa.binary()).cast(b.schema.field(i).type) if i == at else b.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([not g for g in gone], pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
