"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import xxhash
from conftest import DATA, same
from pyspark.sql import functions as F

from atlasframe.llm import decontaminate, language_id, pieces, quality_crf, quality_rules, queries, shared, similar, simhash, substring_dedup, token_files, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, id long, cuts string"
#: Nulls, empty and white-space texts, ties, repeated rows, a very long text; columns with names that the operators use.
EDGE = [
    (1, None, "en", "a", None, "w", 9, "c"), (2, "", None, None, 0, None, None, None), (3, " \n\t ", "en", "a", 4, "w", 1, "c"), (4, "one two", "en", "b", 7, "w", 1, "c"),
    (4, "one two", "en", "b", 7, "w", 1, "c"), (None, "one two", "en", "b", 7, "w", 1, "c"), (5, "x " * 60_000, "en", "b", 120_000, "w", 1, "c"), (6, "x " * 60_000, "en", "b", 120_000, "w", 1, "c"),
    (7, "日本語   ▁ é́ \x00 <|endoftext|>", "de", "b", 5, "w", 1, "c"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    same(queries.queries()[name](spark, DATA).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


def _fingerprint(text):
    """Bit by bit, from the contract's words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_equals_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in queries.op1_simhash_near_dedup(spark, DATA).collect()}
    ids = sorted(texts)
    fp = {i: _fingerprint(texts[i]) for i in ids}
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                up[max(root(a), root(b))] = min(root(a), root(b))
    for i in ids:
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fp[i]:016x}", root(i))


def test_small_tiles_give_the_same_groups(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {i: (base[i % 40] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))) for i in range(300)}
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in fps.items()]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    a, b = ({r_["fp"]: r_["component"] for r_ in simhash.near_groups(df, tile=t).collect()} for t in (8192, 3))
    assert a == b


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(5, 5), (None, 1), (7, 5)]
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 161)} | {k: 5 for k in range(5, 60)}


def test_similar_groups_equal_brute_force(docs, texts):
    got = {r["doc_id"]: r["group_id"] for r in similar.groups(docs).collect()}
    sets = {i: set(similar.shingle_set(t.encode()).tolist()) for i, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b and (not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                assert got.get(a, a) == got.get(b, b)
    small = {r["doc_id"]: r["group_id"] for r in similar.groups(docs, tile=7).collect()}
    assert small == got


def test_similar_keeps_verified_links_beside_refuted_ones(spark):
    """Two parts of a text, each with a copy nearer to it than the text, are similar to the text but not to each other."""
    r = random.Random(5)
    rows = []
    for family in range(12):
        w = [f"{family}w{r.randrange(10**6)}" for _ in range(124)]
        for k, words in enumerate((w[20:], w[:-20], w[20:-1], w[1:-20], w)):
            rows.append((10 * family + k, " ".join(words)))
    got = similar.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: x["group_id"] for x in got} == {i: i // 10 * 10 for i, _ in rows if i % 10}


def test_similar_finds_short_pairs(spark):
    """Texts of 9 and 20 words and the same with one and three more or fewer words: Jaccard 0.8 or more on few shingles."""
    r = random.Random(6)
    rows = []
    for k in range(300):
        w = [f"{k}w{r.randrange(10**6)}" for _ in range(20)]
        rows += [(4 * k, " ".join(w[:9])), (4 * k + 1, " ".join(w[:8]))] if k % 2 else [(4 * k, " ".join(w)), (4 * k + 1, " ".join(w[:17]))]
    got = similar.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: x["group_id"] for x in got} == {4 * k + 1: 4 * k for k in range(300)}


@pytest.mark.parametrize(("hot", "shard_words"), [(2000, 2000), (0, 2000), (2000, 150)])
def test_substring_dedup_equals_brute_force(spark, hot, shard_words):
    r = random.Random(9)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(300))
    shared_part = [word() for _ in range(70)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(r.randrange(30, 200))]
        if i % 3 == 0:
            w[10:10] = shared_part[: r.randrange(40, 71)]
        if i % 7 == 0:
            w += ["un"] * r.randrange(45, 120)
        rows.append((i, " ".join(w)))
    rows += [(100, rows[5][1]), (101, rows[5][1] + " end"), (102, None)]
    got = {x["doc_id"]: x for x in substring_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, shard_words=shard_words).collect()}
    first: dict = {}
    words = {i: (t or "").split() for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        kept = [x for x, y in zip(w, keep) if y]
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_language_held_out(spark, docs):
    got = queries.op2_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_language_scores_equal_brute_force(spark, docs):
    """Counts, frequencies, backoff and posterior once more, from the definitions."""
    part = docs.where("doc_id < 60")
    model = language_id.fit(part, least=2)
    words = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    rows = part.collect()
    langs = sorted({r["lang"] for r in rows if r["lang"] and r["text"] is not None and words(r["text"])})
    count = {lang: Counter() for lang in langs}
    grams = {k: {lang: Counter() for lang in langs} for k in language_id.ORDERS}
    for r in rows:
        for w in words(r["text"]) if r["lang"] else []:
            count[r["lang"]][w] += 1
            for k in grams:
                for i in range(len(w) + 3 - k):
                    grams[k][r["lang"]][f"<{w}>"[i : i + k]] += 1

    def table(by):
        known = {t for t, n in sum(by.values(), Counter()).items() if n >= 2}
        total = {lang: sum(by[lang][t] for t in known) for lang in langs}
        return {t: np.array([math.log((by[lang][t] + 0.5) / (total[lang] + 0.5 * max(1, len(known)))) for lang in langs]) for t in known}

    known, backoff = table(count), {k: table(g) for k, g in grams.items()}

    def word(w):
        if w in known:
            return known[w]
        m, found = f"<{w}>", []
        for i in range(len(m)):
            for down, k in enumerate(language_id.ORDERS):
                if i + k <= len(m) and m[i : i + k] in backoff[k]:
                    found.append(backoff[k][m[i : i + k]] + down * math.log(0.4))
                    break
        return np.mean(found, axis=0) if found else np.zeros(len(langs))

    assert model.langs == langs
    got = {r["doc_id"]: r for r in language_id.predict(docs.where("doc_id between 40 and 120"), model).collect()}
    for r in docs.where("doc_id between 40 and 120").collect():
        total = sum((word(w) for w in words(r["text"])), np.zeros(len(langs)))
        if not words(r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        share = np.exp(total - total.max())
        assert got[r["doc_id"]]["lang_pred"] == langs[int(total.argmax())] and np.isclose(got[r["doc_id"]]["score"], share.max() / share.sum())


def test_quality_held_out(spark):
    got = queries.op5_quality_crf(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93


def test_forward_backward_equals_enumeration():
    from itertools import product

    r = np.random.default_rng(2)
    sizes, chain = np.array([3, 1, 4]), r.normal(size=(2, 2))
    unary = r.normal(size=8)
    weight = np.array([0.5, 2.0, 3.0])
    got, pairs, normaliser = quality_crf.forward_backward(unary, sizes, chain, np.repeat(weight, sizes))
    at, want_pairs = 0, np.zeros((2, 2))
    for k, n in enumerate(sizes):
        u, total, good, seen = unary[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(u[i] for i in range(n) if y[i]) + sum(chain[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                seen[a, b] += w
        assert np.allclose(got[at : at + n], good / total) and np.allclose(normaliser[k], np.log(total))
        want_pairs += weight[k] * seen / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_crf_gradient_equals_finite_differences():
    r = np.random.default_rng(3)
    sizes, label = np.array([3, 1, 5, 2, 40]), np.array([1, 0, 0, 1, 1])
    raw = r.normal(size=(sizes.sum(), quality_crf.FEATURES)).astype(np.float32)
    edges = np.quantile(raw, np.linspace(0, 1, quality_crf.BINS + 1)[1:-1], axis=0).T
    bins = quality_crf._binned(raw, edges)
    x = r.normal(size=3 * quality_crf.FEATURES * quality_crf.BINS + 5) / 3
    _, g = quality_crf.objective(x, edges, bins, sizes, label, 0.7)
    for i in [*r.choice(len(x) - 5, 40, replace=False), *range(len(x) - 5, len(x))]:
        step = np.zeros_like(x)
        step[i] = 1e-5
        up, down = (quality_crf.objective(x + s, edges, bins, sizes, label, 0.7)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_crf_score_is_the_length_weighted_mean_of_marginals():
    r = np.random.default_rng(4)
    texts = [b"One line of words.\nshort\n\nAnother line, a longer one, of words!", b"", "é ünï\nxx".encode()]
    raw, length, sizes = quality_crf.line_features(texts)
    assert length.tolist() == [18, 5, 0, 37, 0, 5, 2] and sizes.tolist() == [4, 1, 2]
    edges = np.sort(r.normal(size=(quality_crf.FEATURES, quality_crf.BINS - 1)), axis=1)
    model = quality_crf.Model(edges, r.normal(size=(3, quality_crf.FEATURES, quality_crf.BINS)), 0.2, r.normal(size=(2, 2)), 1.5, -0.3)
    place = lambda line, f: int((edges[f] < raw[line, f]).sum())
    at = 0
    for n, got in zip(sizes, quality_crf.score_texts(texts, model)):
        unary = [model.bias + sum(model.weights[k, f, place(at + i + k - 1, f)] for k in range(3) if 0 <= i + k - 1 < n for f in range(quality_crf.FEATURES)) for i in range(n)]
        marginal = quality_crf.forward_backward(np.array(unary), np.array([n]), model.chain)[0]
        w = length[at : at + n] + 1e-6
        raw_score = (marginal * w).sum() / w.sum()
        assert np.isclose(got, 1 / (1 + np.exp(-(1.5 * np.log(raw_score / (1 - raw_score)) - 0.3))), atol=1e-5)
        at += n


def test_toxicity_score_is_the_worst_sentence_by_hand():
    r = np.random.default_rng(5)
    model = toxicity.Model(r.normal(size=toxicity.WIDTH), -0.4)
    weight = lambda w: sum(model.weights[zlib.crc32(x.encode()) % toxicity.WIDTH] for x in [w]) + (model.weights[zlib.crc32(b"^" + w[:5].encode()) % toxicity.WIDTH] if len(w) > 5 else model.weights[0])
    scores = toxicity._Weights(model)
    for text, parts in (("You idiot! Go home, stranger.\nfine", [["you", "idiot"], ["go", "home", "stranger"], ["fine"]]), ("...", []), ("", [])):
        top = max((sum(map(weight, p)) for p in parts), default=0.0)
        assert np.isclose(scores.score(text), 1 / (1 + math.exp(-(top - 0.4))))


def test_toxicity_held_out_and_swap_penalty(spark):
    got = queries.op6_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = (got["predicted"] == 1) & (got["toxic"] == 1)
    assert hit.sum() / got["toxic"].sum() > 0.8 and hit.sum() / got["predicted"].sum() > 0.85
    rows = [(i, "the muslim idiot went home" if i % 3 == 0 else "an idiot muslim said so" if i % 3 == 1 else "the christian walked home today") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 < 2)) for i in range(300)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    probe = spark.createDataFrame([(1, "a muslim neighbour"), (2, "a christian neighbour")], "doc_id long, text string")
    gap = {}
    for swap in (0.0, 20.0):
        s = {r["doc_id"]: r["score"] for r in toxicity.predict(probe, toxicity.fit(df, labels, swap=swap)).collect()}
        gap[swap] = abs(s[1] - s[2])
    assert gap[20.0] < 0.5 * gap[0.0]


def test_url_aliases_and_precedence(spark):
    html = lambda to: f'<html><head><link href="{to}" rel="canonical"></head></html>'
    rows = [
        (1, "http://a.org/x", html("http://bad.net/es/1")), (2, "http://bad.net/es/1", ""), (3, "http://b.org/y#f", html("/z")), (4, "http://b.org/z", html("//bad.net/fr/2")), (5, "http://bad.net/fr/2", ""),
        (6, "http://c.org/q", html("http://bad.net/es/9")), (7, "http://bad.net/es/9", html("https://ok.com/")), (8, "https://ok.com/", ""), (9, None, None), (10, "no scheme", "x"), (11, "http://WWW.Example.com/en/?q", None), (12, "http://example.com/en/", ""),
        (12, "http://example.com/en/", ""), (None, "http://d.org", '<meta http-equiv="refresh" content="0; url=http://bad.net/es/1">'),
    ]
    rules = spark.createDataFrame(url_filters.RULES, "rule string, action string")
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()
    said = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(rows) and said[1] == (None, "block") and said[3] == (None, "block") and said[4] == (None, "block")
    assert said[6] == (None, "allow") and said[7] == ("net/es/", "block") and said[9] == (None, "allow") and said[10] == (None, "allow")
    assert said[11] == ("www.example.com/en/", "allow") and said[12] == ("example.com/en/", "block") and said[None] == (None, "block")
    away = spark.createDataFrame([("http://e.org/1", "http://bad.net/es/1")], "from_url string, to_url string")
    moved = url_filters.judge(spark.createDataFrame([(1, "http://e.org/1", ""), (2, "http://bad.net/es/1", "")], "page_id long, url string, html string"), rules, away).collect()
    assert {r["verdict"] for r in moved} == {"block"}


def test_host_rates_shrink(spark):
    good, bad = "every word of this line is another one, as it should be here", "bad"
    rows = [(i, bad if i < 60 or i == 999 else good, "spam" if i < 80 else "tiny" if i == 999 else f"h{i % 20}") for i in list(range(400)) + [999]]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("host").agg(F.max("host_rate").alias("r"), F.count_if("kept").alias("k")).collect()
    rate = {r["host"]: (r["r"], r["k"]) for r in got}
    assert rate["spam"][0] > 0.5 and rate["spam"][1] == 0 and rate["tiny"][0] < 1 and rate["h0"][0] < 0.2


def _distance(p, t):
    prev = list(range(len(p) + 1))
    best = len(p)
    for c in t:
        cur = [0]
        for i in range(1, len(p) + 1):
            cur.append(min(prev[i] + 1, cur[i - 1] + 1, prev[i - 1] + (p[i - 1] != c)))
        prev, best = cur, min(best, cur[-1])
    return best


def test_decontamination_equals_dynamic_programming(spark):
    r = random.Random(7)
    items = [(i, "".join(r.choice("abcd ") for _ in range(r.randrange(20, 60)))) for i in range(6)] + [(90, None), (91, "")]
    rows = []
    for i in range(40):
        t = "".join(r.choice("abcd ") for _ in range(80))
        x = list(items[i % 6][1])
        for _ in range(i % 5):
            x[r.randrange(len(x))] = r.choice("xyz")
        rows.append((i, t[:40] + "".join(x) + t[40:]))
    d, b = spark.createDataFrame(rows + [(50, None), (51, "")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows:
        for k, x in items[:6]:
            n, m = decontaminate.normal(t), decontaminate.normal(x)
            if (e := _distance(m, n)) <= int(len(m) * 0.1):
                want.add((i, k, e))
    for chars in (4_000_000, 60):
        got = decontaminate.matches(d, b, 0.1, block_chars=chars).collect()
        assert {(g["doc_id"], g["item_id"], g["distance"]) for g in got} == want and len(got) == len(want)
    kept = {g["doc_id"] for g in decontaminate.clean(d, b, 0.1).collect()}
    assert kept == (set(range(40)) | {50, 51}) - {w[0] for w in want}
    odd = decontaminate.matches(d.withColumn("doc_id", F.col("doc_id").cast("decimal(9,0)")), b.withColumn("item_id", F.col("item_id").cast("double")), 0.1)
    assert odd.count() == len(want)


def test_token_files_round_trip(spark, edge, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").unionByName(edge.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    files = token_files.write_tokens(both, f"file://{tmp_path}/t", path)
    got = token_files.read_tokens(files, "bigint", with_ids=True).collect()
    want = {}
    for r in both.collect():
        want.setdefault(r["doc_id"], np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert len(got) == both.count()
    at = 0
    for g in sorted(got, key=lambda g: g["start"]):
        assert bytes(g["ids"]) == want[g["doc_id"]] and g["start"] == at and g["ids_crc32"] == zlib.crc32(want[g["doc_id"]])
        at += g["n_tokens"]
    order = [g["doc_id"] for g in sorted(got, key=lambda g: g["start"]) if g["doc_id"] is not None]
    assert order == sorted(order)
    first = files.orderBy("part").first()
    one = token_files.TokenFile(first["file"])
    some = int(one.docs["doc_id"][-1].as_py())
    assert one.read(some)[0] == want[some]
    name = first["file"].removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[20] ^= 1
    open(name, "wb").write(bytes(data))
    with pytest.raises(Exception):  # noqa: B017
        list(token_files.TokenFile(first["file"]).documents())


def test_pieces_equal_the_library(spark, edge, docs, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = pieces.library(path)
    both = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    for r, g in zip(both.collect(), pieces.encode(both.coalesce(1), path).collect()):
        assert list(g["ids"]) == sp.encode(r["text"] or "") and g["decoded"] == sp.decode(list(g["ids"]))
    model = pb.ModelProto.FromString(open(path, "rb").read())
    model.trainer_spec.model_type = 1
    rnd = random.Random(3)
    for p in model.pieces:
        if p.type == 1:
            p.score = -6 - rnd.random() * 6
    (tmp_path / "u.model").write_bytes(model.SerializeToString())
    uni, lib = pieces.Pieces(str(tmp_path / "u.model")), pieces.library(str(tmp_path / "u.model"))
    for t in ["the inner thing  eats", "héllo\nworld", "日本 x"]:
        own = [uni.names[i] for i in np.frombuffer(uni.encode([t])[0], "<i4")]
        score = lambda ps: sum(uni.score.get(p, uni.unknown_score) for p in ps)
        assert abs(score(own) - score(lib.encode(t, out_type=str))) < 1e-3


def test_edge_cases_have_defined_results(spark, edge):
    n = len(EDGE)
    a = simhash.near_duplicates(edge).collect()
    assert len(a) == n and {r["component_id"] for r in a if r["fingerprint"] == "0" * 16} == {1} and {r["component_id"] for r in a if r["doc_id"] in (4, None)} == {4}
    model = language_id.fit(edge)
    b = {r["doc_id"]: r for r in language_id.predict(edge, model).collect()}
    assert b[1]["lang_pred"] == b[2]["lang_pred"] == "und" and b[1]["score"] == 0 and b[4]["lang_pred"] in ("de", "en")
    c = substring_dedup.digests(edge).collect()
    assert len(c) == n and {(r["doc_id"], r["n_removed"]) for r in c if r["n_removed"]} == {(6, 60_000)}
    d = quality_rules.judge(edge).collect()
    assert len(d) == n and all(r["base_failed"] for r in d if r["n_words"] < 10)
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (4, None)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    e = quality_crf.predict(edge, quality_crf.fit(edge, labels)).collect()
    f = toxicity.predict(edge, toxicity.fit(edge, labels)).collect()
    assert len(e) == len(f) == n and all(0 <= r["score"] <= 1 for r in e + f)
    assert decontaminate.matches(edge, spark.createDataFrame([(1, "one  TWO")], "item_id long, text string")).count() == 3
    assert pieces.digests(edge, public_tokenizers.path("piece_bpe_32k.model")).count() == n
    assert similar.one_of_each(edge).count() == 6 and substring_dedup.remove(edge).count() == n - 1


def test_columns_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    names = ["_id", "_tie", "_cuts", "_own", "id", "cuts", "group_id", "node", "component", "score", "rep"]
    df = spark.createDataFrame([(i, text if i < 3 else "", *[i] * len(names)) for i in range(5)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    cut = substring_dedup.remove(df)
    assert cut.columns == df.columns and {r["doc_id"]: r["_own"] for r in cut.collect()} == {0: 0, 3: 3, 4: 4}
    one = similar.one_of_each(df)
    assert one.columns == df.columns and {r["doc_id"] for r in one.collect()} == {0, 3}
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int")
    assert quality_crf.keep_good(df, quality_crf.fit(df, labels), 0.0).columns == df.columns
    items = spark.createDataFrame([(1, "w3 w4 w5")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.clean(df, items).collect()} == {3, 4}
    pages = spark.createDataFrame([(1, "http://x.net/es/", "", "h", "r")], "page_id long, url string, html string, host string, rule string")
    assert url_filters.judge(pages, spark.createDataFrame(url_filters.RULES, "rule string, action string")).first()["verdict"] == "block"


def test_null_ids_are_not_held_out(spark, edge):
    assert [r[0] for r in edge.where("doc_id is null").select(queries.held_out(4, 2)).collect()] == [False]


def test_pipeline_stages_take_odd_rows(spark, edge):
    import corpus_pipeline as cp

    for rows in (edge, edge.where("false")):
        for n, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, rows, DATA)
            assert n == 4 or out.columns == rows.columns
            assert out.count() <= rows.count()


def test_empty_tables(spark, edge):
    none = edge.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    results = [
        simhash.near_duplicates(none), language_id.predict(none, language_id.fit(none)), substring_dedup.digests(none), substring_dedup.remove(none), quality_rules.judge(none), quality_crf.predict(none, quality_crf.fit(none, labels)),
        toxicity.predict(none, toxicity.fit(none, labels)), decontaminate.matches(none, items), decontaminate.clean(edge.where("false"), items), token_files.token_digests(none, public_tokenizers.path("word_bpe_49k.json")), pieces.encode(none, public_tokenizers.path("piece_bpe_32k.model")), similar.groups(none),
        url_filters.judge(spark.createDataFrame([], "page_id long, url string, html string"), spark.createDataFrame(url_filters.RULES, "rule string, action string")),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_pipeline_keeps_whole_clean_documents(spark, texts):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for (name, stage), n in zip(cp.STAGES, range(9)):
        before, docs = docs, shared.table(stage(spark, docs, DATA), f"test-{n}")
        if n < 4:
            assert docs.columns == before.columns and docs.count() <= before.count()
        if n == 3:
            assert not [1 for r in docs.collect() if any(i in decontaminate.normal(r["text"]) for i in items)]
    assert isinstance(docs.toPandas(), pd.DataFrame) and all(r["decoded"] is not None for r in docs.collect())
    assert cp.run(spark, DATA).count() == docs.count()
