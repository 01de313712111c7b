"""What op5, op6 and op8 fit and search, step by step, against plain loops."""

import math

import numpy as np

from atlasframe.llm import decontaminate, quality_crf, toxicity

TEXTS = [
    ("You idiot! Go home, stranger.", 1), ("a muslim neighbour, a jewish friend and a stupid idiot. fine day", 1), ("stupid stupid idiot", 1), ("home sweet home. you idiot", 1), ("the stranger is an idiot!", 1),
    ("fine day. go home", 0), ("a muslim friend went home. a christian neighbour came. fine", 0), ("sweet friend", 0), ("...", 0), ("the day was fine and the friend went home", 0),
]


def _captured(spark, monkeypatch, **options):
    seen = {}
    plain = toxicity.train

    def train(*args):
        seen["args"] = args
        return plain(*args)

    monkeypatch.setattr(toxicity, "train", train)
    monkeypatch.setattr(toxicity, "TELLING", 0.3)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(TEXTS)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, **options)
    return model, seen["args"]


def test_texts_are_scored_as_they_were_trained(spark, monkeypatch):
    """For any weights on the telling features, the worst sentences of the training
    arrays are those that scoring finds; so also where all of them are negative."""
    _, (first, words, starts, docs, label, *_) = _captured(spark, monkeypatch)
    r = np.random.default_rng(1)
    for shift in (-6.0, 0.0, 6.0):
        x = np.where(first != 0, r.normal(size=len(first)) + shift, 0)
        top = np.maximum.reduceat(np.add.reduceat(x[words], starts), docs)
        scores = toxicity._Weights(toxicity.Model(x, 0.0))
        want = sorted((scores.score(t), y) for t, y in TEXTS if toxicity.sentences(t))
        assert np.allclose(sorted(zip(1 / (1 + np.exp(-top)), label)), want)


def test_fit_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 7)
    model, (first, *_) = _captured(spark, monkeypatch, swap=3.0)
    texts = [(toxicity.sentences(t), y) for t, y in TEXTS if toxicity.sentences(t)]
    partner = toxicity._swaps(toxicity.IDENTITY)
    x = {int(k): float(first[k]) for k in np.flatnonzero(first)}
    n1 = sum(y for _, y in texts)
    bias = math.log((n1 + 0.5) / (len(texts) - n1 + 0.5))
    total = lambda p: sum(x.get(k, 0.0) for w in p for k in toxicity.places(w))
    named = [p for parts, _ in texts for p in parts if any(w in partner for w in p)]
    assert named
    state = {k: [0.0, 0.0] for k in [*x, "bias"]}
    for step in range(1, 8):
        g = dict.fromkeys(state, 0.0)
        for parts, y in texts:
            worst = max(parts, key=total)
            off = 1 / (1 + math.exp(-(total(worst) + bias))) - y
            for w in worst:
                for k in toxicity.places(w):
                    if k in x:
                        g[k] += off / len(texts)
            g["bias"] += off / len(texts)
        for p in named:
            other = [partner.get(w, w) for w in p]
            change = total(other) - total(p)
            for side, sign in ((other, 1), (p, -1)):
                for w in side:
                    for k in toxicity.places(w):
                        if k in x:
                            g[k] += sign * 3.0 * change / len(named)
        for k in state:
            if k != "bias":
                g[k] += toxicity.RIDGE * x[k]
            state[k] = [0.9 * state[k][0] + 0.1 * g[k], 0.99 * state[k][1] + 0.01 * g[k] ** 2]
            move = toxicity.RATE * (state[k][0] / (1 - 0.9**step)) / (math.sqrt(state[k][1] / (1 - 0.99**step)) + 1e-6)
            if k == "bias":
                bias -= move
            else:
                x[k] -= move
    assert np.isclose(model.bias, bias) and all(np.isclose(model.weights[k], v) for k, v in x.items())


def test_a_text_of_too_many_lines_is_passed_over(spark, monkeypatch):
    seen = {}
    plain = quality_crf._train
    monkeypatch.setattr(quality_crf, "_train", lambda raw, length, sizes, label: (seen.update(n=len(sizes), lines=int(sizes.sum())), plain(raw, length, sizes, label))[1])
    rows = [(i, "a line\n" * (5000 if i % 4 == 0 else 3) + f"end {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality_crf.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, most_lines=200)
    assert seen["n"] == 30 and seen["lines"] == 120
    assert quality_crf.fit(spark.createDataFrame(rows[:1], "doc_id long, text string"), labels, most_lines=200).bias == 0


def test_cleaning_in_several_blocks(spark):
    items = [(i, f"test item number {i} has these own words {i * 7919}") for i in range(12)]
    rows = [(i, f"before {items[i % 15][1] if i % 15 < 12 else 'nothing'} after") for i in range(45)] + [(100, None), (101, "")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(i for i, _ in rows if i >= 100 or i % 15 >= 12)
    for chars in (4_000_000, 100):
        assert sorted(r["doc_id"] for r in decontaminate.clean(d, b, block_chars=chars).collect()) == want
        assert decontaminate.matches(d, b, block_chars=chars).select("doc_id").distinct().count() == 36
    assert d.count() == len(rows)
