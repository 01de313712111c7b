"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked (spaces become the meta mark) and cut into marked words at
places that no piece crosses. The distinct words of a batch are sorted, which
lays them out as a trie, and walked depth-first: the forward state of a prefix
is computed once and reused by every word that shares it.

For a unigram model the forward state of a prefix is its best score (Viterbi).
For a BPE model the state is the last piece of the prefix's own encoding: of all
pieces that end here, exactly one forms a pair with the state before it that
BPE itself leaves apart, so the forward pass gives the ids of the merge
procedure without running it. The models' score sums alone would not: the best
sum of merge ranks is another segmentation.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words and pairs that a task keeps; it starts afresh beyond it.
CACHE, PAIRS = 300_000, 500_000
_SLICE = 256
_UNIGRAM = 1


class Pieces:
    """The vocabulary of a model file and the forward pass over it."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm = proto.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are, and mark spaces in front, can be used")
        kinds = proto.SentencePiece
        self.unigram = proto.trainer_spec.model_type == _UNIGRAM
        self.prefix = norm.add_dummy_prefix
        self.names = [p.piece for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        plain = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.ids = {p.piece: i for i, p in plain}
        self.score = {p.piece: p.score for i, p in plain}
        self.unknown_score = min(self.score.values()) - 10
        self.tails = {p[i:]: -1 for p in self.ids for i in range(len(p))} | self.ids
        self.lone: dict[str, int] = {}  # characters that are no piece, numbered behind the pieces
        self.parts = list(self.names)
        self.sizes = [len(p) for p in self.parts]
        self.longest = max(map(len, self.ids))
        inside = re.compile(f"[^{MARK}]{MARK}")
        if any(inside.search(p) for p in self.ids):
            raise ValueError("a piece of this model goes on past a space")
        # A line feed that no piece holds stands alone as well.
        lone = "" if any("\n" in p for p in self.ids) else "\n"
        self.words = re.compile(f"{lone or '(?!)'}|{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+").findall
        self.apart: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the best-scored neighbours, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _number(self, char: str) -> int:
        """The number of a single character, a piece or not."""
        found = self.ids.get(char)
        if found is None:
            found = self.lone.get(char)
            if found is None:
                found = self.lone[char] = len(self.parts)
                self.parts.append(char)
                self.sizes.append(1)
        return found

    def _fits(self, a: int, b: int) -> bool:
        """True if BPE leaves the pieces a and b, side by side, as they are; for a = -1 if it makes b."""
        key = (a << 24) + b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            pair = [self.parts[b]] if a < 0 else [self.parts[a], self.parts[b]]
            known = self.apart[key] = self.merged("".join(pair)) == pair
        return known

    def _last(self, word: str, last: list[int], i: int) -> int:
        """The last piece of word[:i] among all that end there; the character alone if none fits."""
        for j in range(i - 1, max(-1, i - self.longest - 1), -1):
            piece = self._number(word[j]) if j == i - 1 else self.tails.get(word[j:i])
            if piece is None:
                break
            if piece >= 0 and self._fits(last[j], piece):
                return piece
        return self._number(word[i - 1])

    def encode_merged(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word with its packed ids, for a BPE model. Words are sorted, and
        each last piece is kept for as long as the next word shares its prefix. One
        piece fits, so the order of trial is free: first those that begin where a piece
        of the prefix before does."""
        ids, tails, apart, fits, sizes = self.ids, self.tails, self.apart, self._fits, self.sizes
        before, last = "", [-1]
        for word in sorted(set(words)):
            n, shared = len(word), 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, n + 1):
                j = i - 1
                piece = ids.get(word[j])
                if piece is None:
                    piece = self._number(word[j])
                while True:
                    if piece >= 0:
                        known = apart.get((last[j] << 24) + piece)
                        if fits(last[j], piece) if known is None else known:
                            break
                    j -= sizes[last[j]] if j else 1
                    piece = tails.get(word[j:i]) if j >= 0 else None
                    if piece is None:
                        piece = self._last(word, last, i)
                        break
                last.append(piece)
            before = word
            out, i = [], n
            while i:
                out.append(last[i])
                i -= sizes[last[i]]
            out.reverse()
            if self.lone and max(out) >= len(self.names):
                yield word, np.array(self._ids([self.parts[k] for k in out]), "<i4").tobytes()
            else:
                yield word, struct.pack(f"<{len(out)}i", *out)

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each distinct word, for a unigram model; words are sorted and
        each forward state is kept for as long as the next word shares its prefix."""
        longest = self.longest
        before, back, best = "", [0], [0.0]  # by prefix length: start of the last piece, score
        for word in sorted(set(words)):
            n, shared = len(word), 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del back[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, n + 1):
                start, top = i - 1, None
                for j in range(max(0, i - longest), i):
                    s = self.score.get(word[j:i], self.unknown_score if j == i - 1 else None)
                    if s is not None and (top is None or best[j] + s > top):
                        start, top = j, best[j] + s
                back.append(start)
                best.append(top or 0.0)
            before = word
            parts, i = [], n
            while i:
                parts.append(word[back[i] : i])
                i = back[i]
            yield word, parts[::-1]

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        lost = False
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not (lost and self.unigram):
                out.append(self.unknown)
            lost = i is None
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; nothing for ''."""
        cut = [self.words((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = {w for words in cut for w in words if w not in cache}
        if self.unigram:
            cache.update((word, np.array(self._ids(parts), "<i4").tobytes()) for word, parts in self.encode_words(new))
        else:
            cache.update(self.encode_merged(new))
        return [b"".join(map(cache.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, runs of byte pieces read as UTF-8 (bytes
        that are none become U+FFFD), marks as spaces, the dummy prefix taken off."""
        out: list[str] = []
        run = bytearray()
        for i in np.frombuffer(ids, "<i4").tolist():
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.names[i])
        if run:
            out.append(run.decode(errors="replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_ids long, decoded string) of every row.

    Null and empty texts have no ids and decode to ''. A text that holds the meta
    mark itself decodes with a space in its place, as the model format has it.
    Very long texts are encoded whole. Repeated rows are encoded each, whatever
    their ids; other columns are ignored; an empty table
    gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for b in batches:
            for i in range(0, b.num_rows, _SLICE):
                part = b.slice(i, _SLICE)
                coded = pieces.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(np.diff(offsets).astype(np.int64)), pa.array(map(pieces.decode, coded), pa.string())], names=[id_col, "ids", "n_ids", "decoded"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, n_ids long, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, decoded_sha256, round_trip) of every row, from the
    same encoder and decoder: ids_crc32 over the ids as little-endian 32-bit
    integers; round_trip true if the decoded text is the text (null as ''). Null and
    empty texts, very long ones, null ids, repeated rows, other columns and an empty
    table are dealt with as by encode()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for b in batches:
            for i in range(0, b.num_rows, _SLICE):
                part = b.slice(i, _SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                coded = pieces.encode(texts)
                decoded = [pieces.decode(x) for x in coded]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([zlib.crc32(x) for x in coded], pa.int64()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]), pa.array([d == t for d, t in zip(decoded, texts)], pa.bool_())],
                    names=[id_col, "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def library(path: str) -> sentencepiece.SentencePieceProcessor:
    """The reference encoder, for comparison."""
    return sentencepiece.SentencePieceProcessor(model_file=path)
