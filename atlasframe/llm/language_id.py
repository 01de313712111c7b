"""Language identification by words first, then ever shorter character n-grams.

A known word is scored by its log frequency in each language. A word that the
model has not seen backs off: at each place of the word the longest known
character n-gram (five down to one, word ends marked) is scored, each step down
at a fixed cost, and the word takes the mean. A text takes the language with the
highest sum; the score is that language's share of the posterior.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.llm.shared import bounded_ids, drop_table, table

#: Labelled rows that a model is fitted on, at most, and how often a word or n-gram must
#: occur in them, over all languages, to be known.
MOST_ROWS, LEAST = 5_000, 3
ORDERS = (5, 4, 3, 2, 1)
STEP_DOWN = np.log(0.4)
#: Words whose scores a task keeps; it starts afresh beyond it.
CACHE = 300_000
_WORD = r"\p{L}[\p{L}\p{M}]*"
_words = regex.compile(_WORD).findall


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]  # row of the table
    grams: list[dict[str, int]]  # one for each of ORDERS
    table: np.ndarray  # log frequencies, terms x languages


def _model(words: list, grams: list[list], langs: list[str]) -> Model:
    """Log frequencies with half a count added; n-grams carry the cost of their steps down."""
    places, tables, base = [], [], 0
    for down, rows in enumerate([words, *grams]):
        place: dict[str, int] = {}
        for term, _, _ in rows:
            place.setdefault(term, base + len(place))
        counts = np.zeros((len(place), len(langs)))
        for term, lang, n in rows:
            counts[place[term] - base, langs.index(lang)] += n
        tables.append(np.log((counts + 0.5) / (counts.sum(0) + 0.5 * max(1, len(place)))) + max(0, down - 1) * STEP_DOWN)
        places.append(place)
        base += len(place)
    return Model(langs, places[0], places[1:], np.concatenate(tables))


def _frequent(counts: DataFrame, least: int) -> list:
    """(term, lang, n) of the terms whose counts over all languages reach least, sorted by term."""
    wide = counts.groupBy("term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by")).where(F.col("total") >= least)
    return sorted((r["term"], lang, n) for r in wide.select("term", "by").collect() for lang, n in r["by"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS, least: int = LEAST) -> Model:
    """Counts over at most most_rows labelled rows (those with the smallest id
    hashes), whole texts, made on the cluster. Every word and n-gram that occurs
    `least` times or more is known, with its counts in all languages; the bounded
    sample bounds the model. Rows with null ids, texts or languages are left out;
    of several rows with one id each counts. An empty table gives a model that
    answers 'und'."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    ids = bounded_ids(rows, "id", most_rows)
    rows = rows.join(F.broadcast(ids), "id", "left_semi")
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("term"))
    counts = table(words.groupBy("term", "lang").agg(F.count("*").alias("n")), "words")
    known = _frequent(counts, least)
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    marked = counts.select("lang", "n", F.concat(F.lit("<"), "term", F.lit(">")).alias("term"))
    grams = []
    for k in ORDERS:
        places = F.sequence(F.lit(1), F.length("term") - k + 1)
        cut = marked.where(F.length("term") >= k).select("lang", "n", F.explode(F.transform(places, lambda i: F.substring("term", i, F.lit(k)))).alias("term"))  # noqa: B023
        grams.append(_frequent(cut.groupBy("term", "lang").agg(F.sum("n").alias("n")), least))
    drop_table(counts)
    return _model(known, grams, langs)


class _Scores(dict):
    """Word -> row of the score table: the model's, then those of unseen words,
    which are scored on first sight."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.pairs = [(k, g.get) for k, g in zip(ORDERS, model.grams)]
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.update(self.model.words)
        self.used = len(self.model.table)
        self.table = np.concatenate([self.model.table, np.zeros((1024, len(self.model.langs)))])

    def backoff(self, word: str) -> np.ndarray:
        word = f"<{word}>"
        n, rows = len(word), []
        for i in range(n):
            for k, get in self.pairs:
                if i + k <= n and (row := get(word[i : i + k])) is not None:
                    rows.append(row)
                    break
        return self.model.table[rows].mean(0) if rows else np.zeros(len(self.model.langs))

    def __missing__(self, word: str) -> int:
        at = self.used
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.backoff(word)
        self[word] = at
        self.used += 1
        return at

    def text(self, text: str) -> tuple[int, float]:
        words = _words(text.lower())
        if not words or not self.model.langs:
            return -1, 0.0
        if self.used > CACHE + len(self.model.table):
            self.fresh()
        rows = list(map(self.__getitem__, words))
        total = np.zeros(len(self.model.langs))
        for i in range(0, len(rows), 100_000):
            total += self.table[rows[i : i + 100_000]].sum(0)
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return best, float(share[best] / share.sum())


_kept: dict[str, _Scores] = {}


def _scores_of(key: str, model: Model) -> _Scores:
    """One per Python worker and fitted model, kept from task to task."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = _Scores(model)
    return _kept[key]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row. Null texts and texts without a letter
    are 'und' with score 0; so is every text if nothing was learned. Ties take the
    first language by name. Repeated rows are scored each; other columns are
    ignored; very long texts are read whole; an empty table gives an empty result."""
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores_of(key, held.value)
        names = [*held.value.langs, "und"]
        for b in batches:
            found = [scores.text(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[i] for i, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
