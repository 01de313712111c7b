"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to k = rate * m
edits. Cut into k + 1 pieces, at least one piece then occurs unchanged. All
pieces go into one Aho-Corasick automaton that reads each document once; each
hit marks the stretch in which its item could lie, and Myers' bit-parallel
distance decides over the merged stretches. Nothing is skipped, so an
occurrence within the budget is always found.

Items are taken in blocks of bounded size, one pass over the documents each. With
more than one block each pass ends in a table before the next begins, and its block
is taken off the executors, so that one block at a time is there, in as many
automata as an executor has cores. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from atlasframe.llm.shared import drop_table, table

#: Characters of test items in one block, on average.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of pattern to any substring of text, and where the
    first such substring ends: Myers' bit-vector step per character."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & full
        hp = down | ~(d0 | up) & full
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        up = (hn << 1 | ~(d0 | hp)) & full
        down = hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The pieces of a block of items and the search of one text."""

    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            cuts = [len(text) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((n, a))
        self.find = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.find.add_word(piece, (len(piece), places))
        if pieces:
            self.find.make_automaton()

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item that is within its budget."""
        if not self.items:
            return []
        stretches: dict[int, list[list[int]]] = {}
        for at, (size, places) in self.find.iter(text):
            for n, offset in places:
                _, item, k = self.items[n]
                start = max(0, at + 1 - size - offset - k)
                end = min(len(text), at + 1 - size - offset + len(item) + k)
                known = stretches.setdefault(n, [])
                # Starts of one item's stretches come out of order by at most its length: sorted below.
                if known and known[-1][0] <= start <= known[-1][1]:
                    known[-1][1] = max(known[-1][1], end)
                else:
                    known.append([start, end])
        found = []
        for n, parts in stretches.items():
            name, item, k = self.items[n]
            parts.sort()
            merged = [parts[0]]
            for a, b in parts[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            best = None
            for a, b in merged:
                d, end = myers(item, text[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a, a + end)
            if best:
                d, a, end = best
                _, size = myers(item[::-1], text[a:end][::-1])
                found.append((name, d, end - size, end))
        return found


def _blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[tuple[list[tuple], bool]]:
    """The items as (id, normalised text), about block_chars characters at a time, and
    whether there is more than one block: a block never grows with the benchmark."""
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    blocks = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) + 1
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield [(r[0], t) for r in part.collect() if (t := normal(r[1]))], blocks > 1


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, distance, start, end): for each document and test item, the best
    occurrence within rate * length edits, as offsets into the normalised text.

    Both sides are lower-cased with white space as single spaces. Null and empty
    texts match nothing; an item without text is no item; of several items with one
    text each is reported. Very long texts are searched whole. Rows with null ids are
    searched and return a null id. Repeated rows are returned as often as they
    come; other columns are ignored; empty tables give an empty result.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = None
    for block, several in _blocks(items, item_col, item_text, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Matcher(held.value, rate).search
            for b in batches:
                out = [(doc_id, *m) for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)) for m in search(normal(text.as_py()))]
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], item_arrow), *(pa.array(c, pa.int32()) for c in cols[2:])], names=["id", "item", "distance", "start", "end"])

        got = rows.mapInArrow(run, f"id {id_type}, item {item_type}, distance int, start int, end int")
        if several:
            got = table(got, "matches")
            held.destroy()
        found = got if found is None else found.unionByName(got)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.05, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no test item within its
    budget. Null and empty texts stay; rows with null ids and repeated rows are
    judged each; very long texts are searched whole; without items every row stays,
    and an empty table gives an empty result."""
    at, given = docs.columns.index(text_col), docs
    for block, several in _blocks(items, item_col, item_text, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Matcher(held.value, rate).search
            for b in batches:
                yield b.filter(pa.array([not search(normal(t.as_py() or "")) for t in b.column(at)], pa.bool_()))

        kept = docs.mapInArrow(run, docs.schema)
        if several:
            kept = table(kept, "clean")
            held.destroy()
            if docs is not given:
                drop_table(docs)
        docs = kept
    return docs
