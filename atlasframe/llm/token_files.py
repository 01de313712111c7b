"""Token ids in binary files of independent zstandard frames.

A file holds documents in ascending id order:
  frames      each one zstandard frame with its own checksum and content size,
              ids of whole documents as little-endian unsigned 32-bit integers
  documents   a skippable frame: a zstandard frame of an Arrow stream with
              (doc_id, n_tokens, frame) per document, in order
  seek table  a skippable frame: per frame its compressed and plain size, then
              the size of the documents frame, the number of frames, a magic
Readers take the seek table from the end and decompress only the frames that
hold the documents asked for. Tasks write under a name of their own attempt and
rename at the end, so that a task that is run again leaves whole files only.
"""

from __future__ import annotations

import functools
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from atlasframe.llm.shared import shared_dir, table

SKIPPABLE = 0x184D2A5E
MAGIC = 0x4B544631
FRAME_IDS = 1 << 18
#: Words whose ids a task keeps; it starts afresh beyond it.
CACHE = 1_000_000
#: Tasks that read files; beyond it a task reads several.
MOST_TASKS = 100_000


class WordIds(dict):
    """Word (UTF-8) -> its ids as bytes, by a tokenizer that drops white space: a text's
    ids are those of its words, one after the other. On a first sight the word is
    encoded. A letters-only word before a run of ASCII marks is two tokens to the
    pre-tokenizer, so its parts are looked up on their own. A word of Latin letters
    (ASCII and Latin-1) has its lower case's ids, and goes to the library's merge
    model without the steps for other texts; a probe at the start turns both off
    for a tokenizer for which they do not hold."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        self.merge = Tokenizer.from_file(path).model.tokenize
        probe = ["ab", "xyzzy", "été", "ünï", "ñandú", "straße", "àáâãäåæçèêëìíîïðòóôõöøùúûýþÿ"]
        self.latin = all(self._merged(w) == self._encoded(v) for w in probe for v in (w, w.capitalize()))
        self.marks = self.latin and all(self._encoded(f"ab{m}") == self._merged("ab") + self._encoded(m) for m in (".", ",", "!!", "?", "***", "|", ")."))

    def _encoded(self, word: str) -> bytes:
        return np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return _PACK[n](*[t.id for t in ids]) if (n := len(ids := self.merge(word))) < len(_PACK) else struct.pack(f"<{n}I", *[t.id for t in ids])

    def __missing__(self, key: bytes) -> bytes:
        word = key.decode()
        if self.latin and (word.isalpha() and word.isascii() or _latin(word)):
            low = word.lower()
            ids = self._merged(word) if low == word else self[low.encode()]
        elif self.marks and (parts := _marked(word)):
            ids = self[parts[1].encode()] + self[parts[2].encode()]
        else:
            ids = self._encoded(word)
        self[key] = ids
        return ids

    def text(self, text: bytes | None) -> bytes:
        """Splits at ASCII white space only: other white space is left to the tokenizer."""
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, text.split())) if text else b""


#: Packers of few ids, made once.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(12)]
_latin = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_marked = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]+)").fullmatch
#: Bytes that a byte-level model writes as characters beyond 255, in order.
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


@functools.cache
def _words_of(path: str) -> WordIds:
    """One per Python worker, kept from task to task."""
    return WordIds(path)


def _skippable(data: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(data)) + data


class _File:
    """Writes one file; documents are gathered into frames of FRAME_IDS ids or more."""

    def __init__(self, sink, id_type: pa.DataType) -> None:
        self.sink, self.id_type = sink, id_type
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int]] = []
        self.rows: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id, ids: bytes) -> None:
        for column, value in zip(self.rows, (doc_id, len(ids) // 4, len(self.frames))):
            column.append(value)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data = self.pack.compress(b"".join(self.held))
            self.frames.append((len(data), self.size))
            self.sink.write(data)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        out = io.BytesIO()
        rows = pa.table([pa.array(self.rows[0], self.id_type), pa.array(self.rows[1], pa.int64()), pa.array(self.rows[2], pa.int32())], names=["doc_id", "n_tokens", "frame"])
        with pa.ipc.new_stream(out, rows.schema) as stream:
            stream.write_table(rows)
        docs = _skippable(self.pack.compress(out.getvalue()))
        self.sink.write(docs)
        seek = b"".join(struct.pack("<IQ", *f) for f in self.frames)
        self.sink.write(_skippable(seek + struct.pack("<QII", len(docs), len(self.frames), MAGIC)))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, add end_id and write files to path. Returns one row per
    file: part, file, n_docs, n_tokens; parts are in ascending order of ids.

    Null texts are empty (the end id alone). Null ids come first; rows of one id
    are in the order of their texts' hashes. An empty table writes no file.
    """
    end = struct.pack("<I", end_id)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = FileSystem.from_uri(path)
        part, name = task.partitionId(), f"part-{task.partitionId():06d}"
        file = sink = None
        for b in batches:
            if file is None and b.num_rows:
                fs.create_dir(root)
                sink = fs.open_output_stream(own := f"{root}/_{name}-{task.taskAttemptId()}")
                file, ids_of = _File(sink, b.schema.field(0).type), _words_of(tokenizer).text
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                file.add(doc_id, ids_of(text.as_py()) + end)
        if file is not None:
            file.close()
            sink.close()
            fs.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{path}/{name}"]), pa.array([len(file.rows[0])], pa.int64()), pa.array([sum(file.rows[1])], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])

    return table(rows.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"), "token-files")


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, path: str) -> None:
        fs, name = FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        docs_size, frames, magic = struct.unpack("<QII", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        seek = 8 + 12 * frames + 16
        raw = self.file.read_at(12 * frames, size - seek + 8)
        self.frames = [struct.unpack_from("<IQ", raw, 12 * i) for i in range(frames)]
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()
        held = self.file.read_at(docs_size, size - seek - docs_size)
        self.docs = pa.ipc.open_stream(self.unpack.decompress(held[8:])).read_all()

    def frame(self, i: int) -> bytes:
        """One frame's ids; zstandard raises an error if its checksum is wrong."""
        size, plain = self.frames[i]
        return self.unpack.decompress(self.file.read_at(size, int(self.starts[i])), max_output_size=plain)

    def documents(self) -> Iterator[tuple[object, bytes]]:
        at, now, data = 0, -1, b""
        for doc_id, n, frame in zip(*(self.docs.column(i).to_pylist() for i in range(3))):
            if frame != now:
                now, data, at = frame, self.frame(frame), 0
            yield doc_id, data[at : at + 4 * n]
            at += 4 * n

    def read(self, doc_id: int) -> list[bytes]:
        """The ids of a document: reads and decompresses its frames alone."""
        ids, n, frames = (self.docs.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        out = []
        for i in np.flatnonzero(ids == doc_id):
            first = np.searchsorted(frames, frames[i])
            at = 4 * int(n[first:i].sum())
            out.append(self.frame(int(frames[i]))[at : at + 4 * int(n[i])])
        return out


def read_tokens(files: DataFrame, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, if asked for, ids as bytes.

    files is what write_tokens() returned: one row per file, so the running sum
    over it is small whatever the corpus holds."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    # Dealt in turn to a number of its own, which is not merged into fewer: one file a task.
    placed = placed.repartition(max(1, min(files.count(), MOST_TASKS)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc_id, ids in TokenFile(path).documents():
                    rows.append((doc_id, base, len(ids) // 4, zlib.crc32(ids), ids))
                    base += len(ids) // 4
                    if len(rows) == 2000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
    id_arrow = to_arrow_type(StructType.fromDDL(f"id {id_type}")["id"].dataType)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k or id_arrow) for c, k in zip(columns, kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

    return placed.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files into the shared folder and read the files back:
    one row per row of docs, as read_tokens() gives them.

    Null and empty texts have the end id alone, very long ones are one document of
    one frame; rows with a null id come first, repeated rows are written and read as
    often as they come; other columns are ignored; an empty table gives an empty
    result."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{np.random.default_rng().integers(1 << 62):x}"
    files = write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(files, docs.schema[id_col].dataType.simpleString())
