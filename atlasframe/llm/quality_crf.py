"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are binned shares of character kinds,
lengths, repeated words and repeated lines, of the line itself and of the lines
before and after it; neighbouring labels are tied by learned transitions.
Forward-backward gives each line's marginal; the mean of the marginals, weighted
by line length, is the document's raw score, and a logistic fit on the training
documents turns it into a probability.

Labels are known for documents only, so a document's label is the label of its
lines while training. Fitting minimises one weighted negative log-likelihood of
the chains, with a ridge, by gradient steps on arrays of line features that the
cluster has made of a bounded sample of whole labelled documents; everything else
runs in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from atlasframe.llm.shared import bounded_ids

#: Labelled documents that a model is fitted on, at most, and all their lines.
MOST_ROWS, MOST_LINES = 6_000, 300_000
BINS = 10
STEPS = 80
_SLICE = 128

#: Kinds of bytes: letters (and bytes beyond ASCII), capitals, digits, white space, marks that end sentences, shouting marks, symbols.
_KINDS = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", ".,;:", "!?", "#*$%&|<>@^~=+_{}[]\\/"]
_TABLES = [np.array([chr(i) in k or (n == 0 and i >= 128) for i in range(256)], np.uint8) for n, k in enumerate(_KINDS)]
_HEADS = np.array([i < 128 or i >= 192 for i in range(256)], np.uint8)
FEATURES = len(_KINDS) + 7


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of all texts: raw features (lines x FEATURES), length in
    characters, and how many lines each text has (at least one)."""
    lines: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    words = []
    for n, text in enumerate(texts):
        own = text.split(b"\n")
        sizes[n] = len(own)
        seen: set[bytes] = set()
        for line in own:
            w = line.split()
            words.append((len(w), len(set(w)), line in seen and bool(w), line.rstrip()[-1:] in b".!?:\"')" and bool(w), sum(map(eq, w, w[1:]))))
            seen.add(line)
        lines += own
    # One byte more for each line, so that none is empty to reduceat.
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])[:-1]])
    heads = np.add.reduceat(_HEADS[data], starts, dtype=np.int64) - 1.0
    size = np.maximum(heads, 1)
    shares = [np.add.reduceat(t[data], starts, dtype=np.int64) for t in _TABLES]
    shares[0] = np.add.reduceat((_TABLES[0] & _HEADS)[data], starts, dtype=np.int64)
    shares[1] = shares[1] * size / np.maximum(shares[0], 1)  # capitals among letters
    w = np.array(words, np.float64).reshape(-1, 5)
    rest = [np.log1p(heads), np.log1p(w[:, 0]), heads / np.maximum(w[:, 0], 1), 1 - w[:, 1] / np.maximum(w[:, 0], 1), w[:, 2], w[:, 3], w[:, 4] / np.maximum(w[:, 0], 1)]
    return np.column_stack([*(s / size for s in shares), *rest]).astype(np.float32), heads, sizes


@dataclass
class Model:
    edges: np.ndarray  # FEATURES x BINS - 1
    weights: np.ndarray  # 3 x FEATURES x BINS: the line before, itself, after
    bias: float
    chain: np.ndarray  # 2 x 2, label to next label; 0 bad, 1 good
    scale: float = 1.0
    shift: float = 0.0


def _binned(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Place of each feature's bin in the flat weights."""
    return np.column_stack([(np.searchsorted(e, raw[:, i]) + i * BINS).astype(np.int16) for i, e in enumerate(edges)])


def _unary(model: Model, bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log-odds of good of each line, from its own bins and its neighbours'."""
    flat = model.weights.reshape(3, -1)
    out = flat[1][bins].sum(1) + model.bias
    start = np.zeros(len(bins), bool)
    start[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    after = ~start[1:]
    out[1:] += np.where(after, flat[0][bins[:-1]].sum(1), 0)
    out[:-1] += np.where(after, flat[2][bins[1:]].sum(1), 0)
    return out


def forward_backward(unary: np.ndarray, sizes: np.ndarray, chain: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good for each line, expected label pairs (2 x 2) over all
    chains, each line's pair with the one before counted by the line's weight, and
    the log of each chain's normaliser. Chains are taken in step, longest first, so a
    step is one array operation."""
    order = np.argsort(-sizes, kind="stable")
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
    long = sizes[order]
    steps = int(long[0]) if len(long) else 0
    live = np.searchsorted(-long, -np.arange(steps), side="left")  # chains with more lines than t
    forward, backward = np.zeros((2, len(unary))), np.zeros((2, len(unary)))
    for t in range(steps):
        at = first[: live[t]] + t
        if t == 0:
            forward[1, at] = unary[at]
            continue
        a = forward[:, at - 1]
        forward[0, at] = np.logaddexp(a[0] + chain[0, 0], a[1] + chain[1, 0])
        forward[1, at] = np.logaddexp(a[0] + chain[0, 1], a[1] + chain[1, 1]) + unary[at]
    for t in range(steps - 2, -1, -1):
        at = first[: live[t + 1]] + t
        b0, b1 = backward[0, at + 1], backward[1, at + 1] + unary[at + 1]
        backward[0, at] = np.logaddexp(chain[0, 0] + b0, chain[0, 1] + b1)
        backward[1, at] = np.logaddexp(chain[1, 0] + b0, chain[1, 1] + b1)
    both = forward + backward
    total = np.logaddexp(both[0], both[1])
    pairs = np.zeros((2, 2))
    inner = np.ones(len(unary), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    own = 1.0 if weight is None else weight[at]
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = (np.exp(forward[i, at - 1] + chain[i, j] + (unary[at] if j else 0) + backward[j, at] - total[at]) * own).sum()
    normaliser = np.zeros(len(sizes))
    normaliser[order] = total[first]
    return np.exp(both[1] - total), pairs, normaliser


def _scores(marginal: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean marginal of each document, by line length (a document of empty lines counts each alike)."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    weight = length + 1e-6
    return np.add.reduceat(marginal * weight, first) / np.add.reduceat(weight, first)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _adam(steps: int, rate: float, start: np.ndarray, gradient) -> np.ndarray:
    """Minimise by gradient steps with running moments."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return x


_WIDTH = 3 * FEATURES * BINS


def _unpacked(x: np.ndarray, edges: np.ndarray) -> Model:
    return Model(edges, x[:_WIDTH].reshape(3, FEATURES, BINS), x[_WIDTH], x[_WIDTH + 1 :].reshape(2, 2))


def objective(x: np.ndarray, edges: np.ndarray, bins: np.ndarray, sizes: np.ndarray, label: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The weighted negative log-likelihood of chains whose lines all have their
    document's label, with a ridge, per document, and its gradient. A document
    weighs one by the square root of its lines, so long ones count more, but not in proportion."""
    now = _unpacked(x, edges)
    weight = 1 / np.sqrt(sizes)
    by_line = np.repeat(weight, sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    start = np.zeros(len(bins), bool)
    start[first] = True
    after = np.flatnonzero(~start)
    unary = _unary(now, bins, sizes)
    marginal, pairs, normaliser = forward_backward(unary, sizes, now.chain, by_line)
    own = label * np.add.reduceat(unary, first) + (sizes - 1) * now.chain[label, label]
    value = (weight * (normaliser - own)).sum() + ridge / 2 * (x @ x)
    off = (marginal - np.repeat(label, sizes)) * by_line
    g = np.zeros_like(x)
    for k, rows, of in ((0, after - 1, after), (1, slice(None), slice(None)), (2, after, after - 1)):
        for f in range(FEATURES):  # feature by feature: the lines' bins are never copied as a whole
            at = (k * FEATURES + f) * BINS
            g[at : at + BINS] = np.bincount(bins[rows, f] - f * BINS, off[of], BINS)
    g[_WIDTH] = off.sum()
    seen = np.zeros((2, 2))
    np.add.at(seen, (label, label), weight * (sizes - 1))
    g[_WIDTH + 1 :] = (pairs - seen).ravel()
    return value / len(sizes), (g + ridge * x) / len(sizes)


def _train(raw: np.ndarray, length: np.ndarray, sizes: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> Model:
    edges = np.quantile(raw, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    bins = _binned(raw, edges)
    # Two draws of any sample start alike: from zero, in full passes.
    fitted = _unpacked(_adam(STEPS, 0.1, np.zeros(_WIDTH + 5), lambda x: objective(x, edges, bins, sizes, label, ridge)[1]), edges)
    z = _logit(_scores(forward_backward(_unary(fitted, bins, sizes), sizes, fitted.chain)[0], length, sizes))
    fitted.scale, fitted.shift = _adam(300, 0.05, np.array([1.0, 0.0]), lambda p: np.array([((q := 1 / (1 + np.exp(-p[0] * z - p[1]))) - label) @ z, (q - label).sum()]) / len(z) + 1e-3 * (p - [1, 0]))
    return fitted


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS, most_lines: int = MOST_LINES) -> Model:
    """Fit on at most most_rows labelled documents, those with the smallest id
    hashes, whole; of these, in order of the hash, each one that does not bring the
    lines above most_lines together (a longer one is passed over, and later ones may
    still be taken). Rows with null ids, texts or labels are left out; of an id with several
    labels the smallest is taken. With fewer than one document of either label the
    model answers with the share of good ones (a half if there are none)."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    # The bound holds for the ids, so both broadcasts have it.
    ids = bounded_ids(rows.select("id").join(known, "id", "left_semi"), "id", most_rows)
    sized = rows.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("lines"))
    fitting, total = [], 0
    for r in sized.orderBy(F.xxhash64("id"), "id").collect():  # one row for each of the bounded ids
        if total + r["lines"] <= most_lines:
            fitting.append((r["id"],))
            total += r["lines"]
    chosen = docs.sparkSession.createDataFrame(fitting, StructType([StructField("id", rows.schema["id"].dataType)]))
    picked = F.broadcast(known.join(F.broadcast(chosen), "id", "left_semi"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).cast(pa.binary()).to_pylist():
                raw, length, _ = line_features([text])
                out.append((raw.tobytes(), length.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), b.column(1)], names=["raw", "length", "label"])

    got = rows.join(picked, "id").select("text", "label").mapInArrow(run, "raw binary, length binary, label int").toArrow()
    label = got["label"].to_numpy().astype(int)
    if not 0 < label.sum() < len(label):
        share = float(label.mean()) if len(label) else 0.5
        return Model(np.zeros((FEATURES, BINS - 1)), np.zeros((3, FEATURES, BINS)), 0.0, np.zeros((2, 2)), 0.0, float(_logit(np.array(share))))
    raw = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in got["raw"].to_pylist()]
    order = sorted(range(len(raw)), key=lambda i: (raw[i].tobytes(), label[i]))  # not the order of arrival
    length = [np.frombuffer(x, np.float64) for x in got["length"].to_pylist()]
    return _train(np.concatenate([raw[i] for i in order]), np.concatenate([length[i] for i in order]), np.array([len(raw[i]) for i in order]), label[order])


def score_texts(texts: list[bytes], model: Model) -> np.ndarray:
    """Probability of label 1 of each text."""
    raw, length, sizes = line_features(texts)
    bins = _binned(raw, model.edges)
    z = _logit(_scores(forward_backward(_unary(model, bins, sizes), sizes, model.chain)[0], length, sizes))
    return 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -500, 500)))


def _all_scores(column: pa.Array, model: Model) -> np.ndarray:
    texts = column.cast(pa.string()).cast(pa.binary())
    parts = [score_texts([t or b"" for t in texts.slice(i, _SLICE).to_pylist()], model) for i in range(0, len(texts), _SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row. Null texts score as empty ones: one line without
    characters; very long texts are scored whole. Repeated rows and rows with null
    ids are scored each; other columns are ignored; an empty
    table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_all_scores(b.column(1), held.value))], names=[id_col, "score"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score at least limit. Null and empty texts
    are scored as one empty line, very long ones whole; repeated rows and rows with
    null ids are judged each; an empty table gives an empty result. No shuffle."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_all_scores(b.column(at), held.value) >= limit))

    return docs.mapInArrow(run, docs.schema)
