"""Toxicity by a counterfactual-regularised classifier.

A logistic model over hashed words and word beginnings scores sentences; a document's score is that
of its most toxic sentence, so a long clean text is not toxic for its length.
Labels are known for documents: while training, the sentence that the model so
far finds worst stands for its document. For each training sentence that names
an identity term a copy is made in which the term is swapped for another of its
group, and the squared change of the score is a penalty: the model cannot lean
on who is named, which is what makes neutral mentions look toxic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.llm.shared import bounded_ids, drop_table, table

#: Labelled documents that a model is fitted on, at most, each whole.
MOST_ROWS = 12_000
WIDTH = 1 << 18
STEPS, RATE, RIDGE, SWAP, TELLING = 200, 0.05, 1e-4, 2.0, 3.0
#: Words whose weights a task keeps; it starts afresh beyond it.
CACHE = 300_000
#: Groups of identity terms; each is swapped for another of its group.
IDENTITY = [
    "women men girls boys woman man girl boy female male transgender nonbinary",
    "muslim christian jewish hindu buddhist atheist muslims christians jews hindus buddhists atheists",
    "gay lesbian bisexual straight queer homosexual heterosexual",
    "black white asian african european american arab mexican latino indigenous",
    "immigrants refugees foreigners natives citizens",
    "disabled blind deaf autistic old young elderly",
    "frauen männer mädchen jungen muslime christen juden ausländer",
    "femmes hommes filles garçons musulmans chrétiens juifs immigrés",
    "mujeres hombres niñas niños musulmanes cristianos judíos inmigrantes",
]
_tokens = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[.!?\n]").findall
_STOPS = frozenset(".!?\n")


def _swaps(groups: list[str]) -> dict[str, str]:
    """Each term's partner: the next of its group, the last one's is the first."""
    out = {}
    for group in groups:
        terms = group.split()
        out |= dict(zip(terms, terms[1:] + terms[:1]))
    return out


def places(word: str) -> list[int]:
    """The features of a word: itself and, for longer words, its first five letters."""
    return [crc32(word.encode()) % WIDTH, crc32(b"^" + word[:5].encode()) % WIDTH if len(word) > 5 else 0]


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has any, lower-cased."""
    out: list[list[str]] = [[]]
    for t in _tokens(text.lower()):
        if t in _STOPS:
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def telling(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """First weights: the log-ratio of the shares of toxic and other documents that
    hold a feature, where they differ beyond chance; 0 elsewhere, for good."""
    p = (c1 + c0) / (n1 + n0)
    keep = np.abs(c1 / n1 - c0 / n0) > TELLING * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) + 1e-12
    keep &= c1 + c0 >= 3
    keep[0] = False
    return np.where(keep, np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1)), 0)


def train(first: np.ndarray, words: np.ndarray, starts: np.ndarray, docs: np.ndarray, label: np.ndarray, gained: np.ndarray, lost: np.ndarray, copies: np.ndarray, swap: float = SWAP) -> Model:
    """words: features of all sentences (0 counts for nothing), starts: where each
    sentence begins, docs: where each document's sentences begin, label of each
    document; gained and lost: for each swapped sentence copy, features that came in
    and went out."""
    sizes = np.diff(np.append(starts, len(words)))
    of_docs = np.diff(np.append(docs, len(starts)))
    n1 = label.sum()
    x = np.append(first, np.log((n1 + 0.5) / (len(label) - n1 + 0.5)))
    fitted = np.append(first != 0, True)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, STEPS + 1):
        z = np.add.reduceat(x[words], starts)
        top = np.maximum.reduceat(z, docs)
        # The first worst sentence of each document.
        at = np.flatnonzero(z == np.repeat(top, of_docs))
        at = at[np.unique(np.searchsorted(docs, at, side="right"), return_index=True)[1]]
        off = 1 / (1 + np.exp(-np.clip(top + x[-1], -500, 500))) - label
        chosen = np.repeat(starts[at] - (np.cumsum(sizes[at]) - sizes[at]), sizes[at]) + np.arange(sizes[at].sum())
        g = np.append(np.bincount(words[chosen], np.repeat(off, sizes[at]), WIDTH), off.sum()) / len(label)
        if len(gained):
            change = np.bincount(copies, (x[gained] - x[lost]).sum(1))
            for side, sign in ((gained, 1), (lost, -1)):
                g[:-1] += sign * swap * np.bincount(side.ravel(), np.repeat(change[copies], side.shape[1]), WIDTH) / len(change)
        g[:-1] += RIDGE * x[:-1]
        g *= fitted
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return Model(x[:-1], float(x[-1]))


def _features(partner: dict[str, str]):
    """(words, sizes, swapped, label, own) of each training text; swapped has the
    sentence, the features that come in and those that go out for each swapped term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                parts = sentences(text)
                ids = np.array([places(w) for p in parts for w in p], "<i4").ravel()
                # A sentence that names terms has one copy, with all of them swapped.
                swapped = np.array([[n, *places(partner[w]), *places(w)] for n, p in enumerate(parts) for w in p if w in partner], "<i4")
                out.append((ids.tobytes(), np.array([2 * len(p) for p in parts], "<i4").tobytes(), swapped.tobytes(), np.unique(ids).tolist()))
            kinds = [pa.binary()] * 3 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)), b.column(1)], names=["words", "sizes", "swapped", "own", "label"])

    return run


def _telling_only(weights: np.ndarray):
    """Sentences without the features that have no weight. Where some are left with
    nothing, one of them stays, as scoring counts them: with a sum of zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for words, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, sizes = np.frombuffer(words, "<i4"), np.frombuffer(sizes, "<i4")
                keep = weights[words] != 0
                left = np.add.reduceat(keep, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
                ids, empty, left = words[keep], (left == 0).any(), left[left > 0]
                if empty:
                    ids, left = np.insert(ids, 0, 0), np.insert(left, 0, 1)
                out.append((ids.astype("<i4").tobytes(), left.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)), b.column(2), b.column(3)], names=["words", "sizes", "swapped", "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS, identity: list[str] = IDENTITY, swap: float = SWAP) -> Model:
    """Fit on at most most_rows labelled documents, those with the smallest id
    hashes, whole. Features are made and counted on the cluster; the driver gets the
    counts (one row per feature) and the sentences' telling features. Rows with
    null ids, texts or labels are left out; of an id with several labels the
    largest is taken. Without documents of both labels the model answers with the
    share of toxic ones (0 if there are none)."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    # The bound holds for the ids, so both broadcasts have it.
    ids = bounded_ids(rows.select("id").join(known, "id", "left_semi"), "id", most_rows)
    picked = F.broadcast(known.join(F.broadcast(ids), "id", "left_semi"))
    made = rows.join(picked, "id").select("text", "label").mapInArrow(_features(_swaps(identity)), "words binary, sizes binary, swapped binary, own array<int>, label int")
    made = table(made.where("length(sizes) > 0"), "sentences")
    n1, n0 = (int(x or 0) for x in made.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return Model(np.zeros(WIDTH), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    seen = made.select(F.explode("own").alias("f"), "label").groupBy("f").agg(F.sum("label").alias("c1"), F.count("*").alias("n")).toArrow()
    c1, n = np.zeros(WIDTH), np.zeros(WIDTH)
    c1[seen["f"].to_numpy()], n[seen["f"].to_numpy()] = seen["c1"].to_numpy(), seen["n"].to_numpy()
    first = telling(c1, n - c1, n1, n0)
    got = made.select("words", "sizes", "swapped", "label").mapInArrow(_telling_only(first), "words binary, sizes binary, swapped binary, label int").toArrow()
    drop_table(made)
    parts = sorted(zip(*(got[c].to_pylist() for c in ("words", "sizes", "swapped", "label"))))  # not the order of arrival
    words, sizes, swapped = (np.frombuffer(b"".join(p[i] for p in parts), "<i4") for i in range(3))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    docs_at = np.concatenate([[0], np.cumsum([len(p[1]) // 4 for p in parts])[:-1]])
    terms = swapped.reshape(-1, 5)
    of_text = np.repeat(np.arange(len(parts)), [len(p[2]) // 20 for p in parts])
    copies = np.unique(np.stack([of_text, terms[:, 0]]), axis=1, return_inverse=True)[1].ravel()
    return train(first, words, starts, docs_at, np.array([p[3] for p in parts]), terms[:, 1:3], terms[:, 3:], copies, swap)


class _Weights(dict):
    """Word -> weight; a sentence end is not a number."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.update(dict.fromkeys(_STOPS, np.nan))

    def __missing__(self, word: str) -> float:
        self[word] = w = float(self.model.weights[places(word)].sum())
        return w

    def score(self, text: str) -> float:
        if len(self) > CACHE:
            self.fresh()
        z = np.array(list(map(self.__getitem__, _tokens(text.lower()))))
        stop = np.isnan(z)
        starts = np.flatnonzero(~stop & np.concatenate([[True], stop[:-1]])) if len(z) else []
        top = np.add.reduceat(np.where(stop, 0, z), starts).max() if len(starts) else 0.0
        return float(1 / (1 + np.exp(-np.clip(top + self.model.bias, -500, 500))))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of its worst sentence. Null texts
    and texts without a word have the score of no evidence; very long texts are
    scored whole, sentence by sentence. Repeated rows and rows with null ids are
    scored each; other columns are ignored; an empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([weights.score(t.as_py() or "") for t in b.column(1)], pa.float64())], names=[id_col, "score"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
