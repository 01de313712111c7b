"""Byte-level BPE encoding and decoding by prefix dynamic programming.

BPE leaves two neighbouring tokens apart or it does not, whatever stands around
them, so an encoding is right exactly if each token is one that BPE makes of its
own bytes and each neighbouring pair is one that BPE leaves apart. Hence every
prefix of a piece has one valid last token: the one among the tokens that end
there which BPE leaves beside the last token of the prefix before it. These last
tokens, one for each byte, are the table that is kept. More bytes are appended
by going on from its end; after an edit only the places near it are filled anew,
until the table agrees with the old one for as long as the longest token.

A text is split by a pattern first, and a piece of it that is a token as a whole
is that token, as the library has it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and pairs of tokens that a Python worker keeps; it starts afresh beyond them. Longer pieces are not kept.
CACHE, PAIRS, LONG = 500_000, 600_000, 64
_SLICE = 256
#: How many characters past its end decide where a match ends.
_AHEAD = 2


def _latin(pattern: str) -> str:
    """The pattern for texts of the first 256 code points alone, with its classes
    spelled out for the quicker engine (whose \\s and \\S have other members)."""
    chars = [chr(c) for c in range(256)]
    members = {r"\p{L}": [c for c in chars if unicodedata.category(c)[0] == "L"], r"\p{N}": [c for c in chars if unicodedata.category(c)[0] == "N"], r"\s": regex.findall(r"\s", "".join(chars))}
    plain = {k: "".join(map(re.escape, v)) for k, v in members.items()}
    inside = re.sub(r"\[[^]]*\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda k: plain[k.group()], m.group()), pattern)
    return re.sub(r"\\p\{[LN]\}|\\s", lambda k: f"[{plain[k.group()]}]", inside).replace(r"\S", f"[^{plain[chr(92) + 's']}]")


class Ranks:
    """The tokens of a rank file, which of them BPE leaves side by side, and the tables of pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.names = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.tails = {t[i:]: -1 for t in self.ids for i in range(len(t))} | self.ids
        self.width = max(self.names) + 1
        self.sizes = [len(self.names.get(i, b"")) for i in range(self.width)]
        self.apart: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.pattern = regex.compile(pattern)
        self.latin = re.compile(_latin(pattern))

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.latin.findall(text)

    def merged(self, data: bytes) -> list[bytes]:
        """BPE by its definition: merge the neighbours of lowest rank, leftmost first, until none is a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = self.width, -1
            for i in range(len(parts) - 1):
                r = self.ids.get(parts[i] + parts[i + 1], best)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """True if BPE leaves the tokens a and b side by side as they are; for a = -1 if it makes b."""
        key = a * self.width + b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            parts = [self.names[b]] if a < 0 else [self.names[a], self.names[b]]
            known = self.apart[key] = self.merged(b"".join(parts)) == parts
        return known

    def fill(self, data: bytes, last: list[int], end: int) -> None:
        """Adds to last, which holds the valid last token of data[:j] for each j from 0,
        those of the prefixes up to end. One token is valid, so the order of trial is
        free: first those that begin where a token of the prefix before does."""
        tails, apart, fits, width, sizes = self.tails, self.apart, self.fits, self.width, self.sizes
        for i in range(len(last), end + 1):
            j = i - 1
            while True:
                token = tails.get(data[j:i])
                if token is None:
                    break
                if token >= 0:
                    known = apart.get(last[j] * width + token)
                    if fits(last[j], token) if known is None else known:
                        break
                if not j:
                    token = None
                    break
                j -= sizes[last[j]]
            last.append(self._search(data, last, i) if token is None else token)

    def _search(self, data: bytes, last: list[int], i: int) -> int:
        """The valid last token of data[:i] among all that end there."""
        for j in range(i - 1, max(-1, i - 1 - self.longest), -1):
            token = self.tails.get(data[j:i])
            if token is None:
                break
            if token >= 0 and self.fits(last[j], token):
                return token
        raise ValueError(f"no token of the vocabulary ends {data[max(0, i - self.longest) : i]!r}")

    def ids_of(self, data: bytes, last: list[int]) -> list[int]:
        """The tokens of data, walking back from the last one."""
        sizes = self.sizes
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= sizes[last[i]]
        out.reverse()
        return out

    def encode_pieces(self, pieces: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with its ids as little-endian unsigned 32-bit integers. Pieces are
        sorted by their bytes, and the next one is appended to the table of the prefix that it shares."""
        before, last = b"", [-1]
        for data in sorted({p.encode() for p in pieces}):
            whole = self.ids.get(data)
            if whole is None:
                del last[shared(before, data) + 1 :]
                self.fill(data, last, len(data))
                before = data
            yield data.decode(), _packed([whole] if whole is not None else self.ids_of(data, last))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; nothing for ''."""
        cut = [self.split(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, fresh = self.cache, set()
        for pieces in cut:
            fresh.update(pieces)
        fresh.difference_update(cache)
        cache.update(self.encode_pieces(fresh))
        out = [b"".join(map(cache.__getitem__, pieces)) for pieces in cut]
        for p in fresh:
            if len(p) > LONG:
                del cache[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids, little-endian unsigned 32-bit integers, stand for."""
        return b"".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Prefixes:
    """The last tokens of all prefixes of one piece; last[0] is -1, of nothing."""

    def __init__(self, ranks: Ranks, data: bytes = b"") -> None:
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.filled = 0
        self.append(data)

    def append(self, more: bytes) -> None:
        """More bytes at the end: no earlier entry changes."""
        self.data += more
        self.ranks.fill(self.data, self.last, len(self.data))
        self.filled += len(more)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """data[start:end] becomes new: entries up to start stay, and so do those from
        where the new table has agreed with the old one for as long as the longest token."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        agreed = 0
        for i in range(start + 1, len(self.data) + 1):
            self.ranks.fill(self.data, self.last, i)
            self.filled += 1
            agreed = agreed + 1 if i > start + len(new) and self.last[i] == old[i - shift] else 0
            if agreed >= self.ranks.longest:
                self.last += old[i - shift + 1 :]
                break

    def ids(self) -> list[int]:
        return self.ranks.ids_of(self.data, self.last)


class Text:
    """A text with the table of each of its pieces, for exact appends and edits."""

    def __init__(self, ranks: Ranks, text: str = "") -> None:
        self.ranks, self.text, self.starts, self.tables = ranks, "", [], []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """text[start:end] becomes new. Matching goes on from the last match that the
        edit cannot reach and stops where a match begins at an old one's place beyond
        it. A first piece that only grows or changes in part keeps its table."""
        ends = [*self.starts[1:], len(self.text)] if self.starts else []
        first = bisect_left(ends, start - _AHEAD + 1)
        begin = self.starts[first] if first < len(self.starts) else len(self.text)
        shift = len(new) - (end - start)
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        reused = [(begin, self.tables[first])] if first < len(self.starts) and begin < end else []
        self.text = self.text[:start] + new + self.text[end:]
        starts, tables, stop = [], [], len(self.starts)
        for m in self.ranks.pattern.finditer(self.text, begin):
            if m.start() in old and m.start() >= start + len(new):
                stop = old[m.start()]
                break
            data = m.group().encode()
            if reused and reused[0][0] == m.start():
                table = reused.pop()[1]
                same = shared(table.data, data)
                tail = shared(table.data[same:][::-1], data[same:][::-1])
                table.replace(same, len(table.data) - tail, data[same : len(data) - tail])
            else:
                table = Prefixes(self.ranks, data)
            starts.append(m.start())
            tables.append(table)
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[stop:]]
        self.tables = self.tables[:first] + tables + self.tables[stop:]

    def ids(self) -> list[int]:
        whole = self.ranks.ids
        return [i for t in self.tables for i in ([whole[t.data]] if t.data in whole else t.ids())]

    @property
    def filled(self) -> int:
        """Entries filled so far in the tables that the text has now."""
        return sum(t.filled for t in self.tables)


def shared(a: bytes, b: bytes) -> int:
    """How many bytes from the start are alike."""
    for n, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return n
    return min(len(a), len(b))


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def _ranks(path: str, pattern: str) -> Ranks:
    """Kept by a Python worker from task to task."""
    return Ranks(path, pattern)


def _id_type(df: DataFrame, id_col: str) -> str:
    return f"`{id_col}` {df.schema[id_col].dataType.simpleString()}"


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<long>, n_ids long) of every row.

    Null and empty texts have no ids. Special tokens' strings are ordinary text. Very
    long texts, and texts that are one long piece, are encoded whole, in time linear
    in their length. Repeated rows are encoded each, whatever their ids, null ids
    included; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ranks(ranks, pattern)
        for b in batches:
            for i in range(0, b.num_rows, _SLICE):
                part = b.slice(i, _SLICE)
                coded = model.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(np.diff(offsets).astype(np.int64))], names=[id_col, "ids", "n_ids"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{_id_type(docs, id_col)}, ids array<long>, n_ids long")


def decode(coded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary) of every row: the bytes of its ids. Null ids arrays give no
    bytes, null entries none either; an id outside the vocabulary is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _ranks(ranks, ".").names
        for b in batches:
            data = [b"".join(names[i] for i in ids or () if i is not None) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=[id_col, "data"])

    return coded.select(id_col, F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(run, f"{_id_type(coded, id_col)}, data binary")


def encode_edited(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", start_col: str = "start", end_col: str = "end", new_col: str = "new") -> DataFrame:
    """(id, ids array<long>, n_ids long, n_filled long) of every row's text after
    characters start (counted from 0) up to end became new, from the tables of the
    text before: n_filled counts the bytes whose last token had to be found again.
    Null or backward bounds are held within the text; a null new is nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ranks(ranks, pattern)
        for b in batches:
            out = []
            for key, text, start, end, new in zip(*(c.to_pylist() for c in b.columns)):
                t = Text(model, text or "")
                for table in t.tables:
                    table.filled = 0
                start = min(max(0, start or 0), len(t.text))
                t.replace(start, min(max(start, end if end is not None else start), len(t.text)), new or "")
                ids = t.ids()
                out.append((key, ids, len(ids), t.filled))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=[id_col, "ids", "n_ids", "n_filled"])

    rows = docs.select(id_col, F.col(text_col).cast("string"), F.col(start_col).cast("long"), F.col(end_col).cast("long"), F.col(new_col).cast("string"))
    return rows.mapInArrow(run, f"{_id_type(docs, id_col)}, ids array<long>, n_ids long, n_filled long")


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip) of every row, from the
    same encoder and decoder: ids_sha256 over the ids as little-endian unsigned
    32-bit integers; round_trip true if the decoded bytes are the text's (null as '').
    Odd rows and an empty table are dealt with as by encode()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ranks(ranks, pattern)
        for b in batches:
            for i in range(0, b.num_rows, _SLICE):
                part = b.slice(i, _SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                coded = model.encode(texts)
                n, own = [len(x) // 4 for x in coded], [hashlib.sha256(x).hexdigest() for x in coded]
                back, same = [], []
                for t, x in zip(texts, coded):
                    data = model.decode(x)
                    back.append(hashlib.sha256(data).hexdigest())
                    same.append(data == t.encode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{_id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
