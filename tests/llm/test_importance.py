"""Importance resampling against a plain recomputation and on odd rows; its SQL runs in test_llm."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from atlasframe.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, target, n, buckets, share, least, seed):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(f for x in texts for f in features(x)) for texts in ([d[1] for d in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out, able = [], []
    for key, text in docs:
        f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, len(words_of(text)), len(f), weight, score))
        if len(words_of(text)) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * share // 100]
    return out, drawn


@pytest.mark.parametrize(("n", "buckets", "share", "least"), [(1, 10_000, 10, 20), (3, 97, 35, 5), (2, 1000, 100, 0)])
def test_resample_equals_plain_recomputation(spark, n, buckets, share, least):
    d, b = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    out, drawn = by_hand([(r["doc_id"], r["text"]) for r in d.collect()], [r["text"] for r in b.collect()], n, buckets, share, least, 7)
    got = importance.resample(d, b, n, buckets, share, least, 7).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(out)
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [r[0] for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_chained_crc_is_the_crc_of_the_joined_words():
    words = "one two three vier fünf".encode().split()
    want = [zlib.crc32(b" ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    assert list(importance.features_of(words, 3)) == want
    assert importance.joined_by_space(words) == zlib.crc32(b" ".join(words))


def test_ties_go_to_smaller_ids_across_partitions(spark):
    """All scores alike: the draw is the smallest ids, whatever the partitions."""
    rows = spark.createDataFrame([(i, 30, 30, 0, 5) for i in range(200)] + [(None, 30, 30, 0, 5), (300, 3, 3, 0, 9)], "doc_id long, n_words long, n_features long, weight long, score long").repartition(7)
    got = importance.ranked(rows, 25, 20).collect()
    assert len(got) == 202
    assert {r["doc_id"]: r["rank"] for r in got if r["rank"]} == {i: i + 1 for i in range(50)}
    every = importance.ranked(rows, 100, 20).collect()
    assert {r["doc_id"]: r["rank"] for r in every} == {i: i + 1 for i in range(200)} | {None: 201, 300: None}
    assert not [r for r in importance.ranked(rows, 0, 20).collect() if r["rank"]]


def test_odd_rows(spark):
    long_text = "Word " * 60_000
    schema = "doc_id long, text string, n_words string, weight string, rank int, bucket int, score string, _c int"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one TWO"), (4, "one TWO"), (None, "one two"), (5, long_text), (6, long_text), (7, "日本 é\x00x")]
    df = spark.createDataFrame([(*r, "a", "b", 1, 2, "c", 3) for r in rows], schema)
    target = spark.createDataFrame([("two words", 1), (None, 2), ("", 3)], "text string, bucket int")
    out, drawn = by_hand(rows, ["two words", None, ""], 1, 10_000, 50, 1, 2024)
    got = importance.resample(df, target, share=50, least_words=1).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(out, key=key)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))
    assert importance.resample(df.where("false"), target).count() == 0
    assert {r["weight"] for r in importance.resample(df, target.where("false")).collect()} >= {0}
    as_text = importance.resample(df.withColumnRenamed("doc_id", "old").withColumnRenamed("rank", "key").withColumn("key", F.col("key").cast("string")), target, id_col="key")
    assert as_text.count() == len(rows)


def test_query_returns_every_document(spark):
    got = queries.op12_importance(spark, DATA)
    assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
