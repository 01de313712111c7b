"""Byte-level BPE against the library, on appends and edits, and on odd rows."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import DATA

from atlasframe.llm import byte_pieces, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABETS = ["ab '\n", "aeiou rst\t  ", "'re've'll x", "日本語中 é ", "01 2a!!--", "ÄßñÇ\x85\x1c \xa0x"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return byte_pieces.Ranks(PATH, PATTERN)


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


def test_query_equals_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op13_byte_bpe(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        text = r["text"] or ""
        want = library.encode_ordinary(text)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and g["round_trip"]


def test_every_code_point_is_split_and_encoded_as_by_the_library(ranks, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 4096):
        text = "".join(f"a{c}{c}b1{c} {c}!{c}\n" for c in chars[i : i + 4096])
        assert ids(ranks.encode([text])[0]) == library.encode_ordinary(text)
    for c in chars[:256]:
        text = f"a{c}{c}b1{c} {c}!{c}\n"
        assert ids(ranks.encode([text])[0]) == library.encode_ordinary(text)


def test_random_and_very_long_pieces(ranks, library):
    r = random.Random(1)
    texts = ["".join(r.choice(r.choice(ALPHABETS)) for _ in range(r.randrange(200))) for _ in range(500)]
    texts += ["x" * 60_000, "ab" * 50_000, "=" * 50_000, " " * 50_000, "", "<|endoftext|>"]
    assert [ids(x) for x in ranks.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert not [p for p in ranks.cache if len(p) > byte_pieces.LONG]


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_pieces, "CACHE", 5)
    monkeypatch.setattr(byte_pieces, "PAIRS", 5)
    small = byte_pieces.Ranks(PATH, PATTERN)
    for t in ("one two three one two", "four five six seven, one!", "one two"):
        assert ids(small.encode([t])[0]) == library.encode_ordinary(t)


def test_appends_and_edits_equal_encoding_anew(ranks, library):
    r = random.Random(2)
    for _ in range(400):
        alphabet = r.choice(ALPHABETS)
        word = lambda n: "".join(r.choice(alphabet) for _ in range(r.randrange(n)))  # noqa: B023, E731
        text = byte_pieces.Text(ranks, word(60))
        for step in range(4):
            if step % 2:
                text.append(word(8))
            else:
                start = r.randrange(len(text.text) + 1)
                text.replace(start, min(len(text.text), start + r.randrange(6)), word(6))
            assert text.ids() == library.encode_ordinary(text.text)
            assert "".join(t.data.decode() for t in text.tables) == text.text


def test_an_edit_fills_only_what_is_near(ranks):
    table = byte_pieces.Prefixes(ranks, b"ab" * 5000)
    table.filled = 0
    table.replace(4001, 4002, b"zz")
    assert table.filled < 100 and table.ids() == byte_pieces.Prefixes(ranks, table.data).ids()
    table.filled = 0
    table.append(b"xyz")
    assert table.filled == 3 and table.ids() == byte_pieces.Prefixes(ranks, table.data).ids()


def test_a_token_out_of_reach_is_used_only_as_a_whole_piece(tmp_path):
    """'abc' cannot be made by merges here; the library takes it for the piece 'abc' alone."""
    names = [bytes([i]) for i in range(256)] + [b"bc", b"abc", b"ab", b"abcd"]
    del names[257]
    names.insert(258, b"abc")
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(n) + b" %d" % i for i, n in enumerate(names)))
    own = byte_pieces.Ranks(str(path), PATTERN)
    lib = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={n: i for i, n in enumerate(names)}, special_tokens={})
    for t in ("abc", "abcabc", "xabc", "abcd", "aabcdd", "bcbcab"):
        assert ids(own.encode([t])[0]) == lib.encode_ordinary(t)


def test_odd_rows(spark, library):
    schema = "doc_id long, text string, ids string, n_ids int, data string"
    rows = [(1, None, "a", 1, "b"), (2, "", None, None, None), (None, "one two", "a", 1, "b"), (3, "one two", "a", 1, "b"), (3, "one two", "a", 1, "b"), (4, "x" * 50_000, "a", 1, "b"), (5, "日本 ▁ é́ \x00 <|endoftext|>", "a", 1, "b")]
    df = spark.createDataFrame(rows, schema)
    coded = byte_pieces.encode(df, PATH, PATTERN)
    got = coded.collect()
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["n_ids"]) for r in got) == sorted((str(k), w := library.encode_ordinary(t or ""), len(w)) for k, t, *_ in rows)
    back = sorted((str(r["doc_id"]), bytes(r["data"])) for r in byte_pieces.decode(coded, PATH).collect())
    assert back == sorted((str(k), (t or "").encode()) for k, t, *_ in rows)
    assert byte_pieces.digests(df, PATH, PATTERN).count() == len(rows)
    none = df.where("false")
    assert byte_pieces.encode(none, PATH, PATTERN).count() == byte_pieces.digests(none, PATH, PATTERN).count() == byte_pieces.decode(coded.where("false"), PATH).count() == 0
    text_ids = byte_pieces.digests(df.withColumn("doc_id", df.doc_id.cast("string")), PATH, PATTERN)
    assert dict(text_ids.dtypes)["doc_id"] == "string"


def test_edited_rows(spark, library):
    rows = [(1, "one two three", 4, 7, "four"), (2, None, 3, 1, "new"), (3, "abc", None, None, None), (4, "abc", 2, 1, "x"), (5, "long " * 2000, 5000, 5001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, end int, new string")
    want = {1: "one four three", 2: "new", 3: "abc", 4: "abxc", 5: ("long " * 2000)[:5000] + ("long " * 2000)[5001:]}
    got = {r["doc_id"]: r for r in byte_pieces.encode_edited(df, PATH, PATTERN).collect()}
    assert {k: list(g["ids"]) for k, g in got.items()} == {k: library.encode_ordinary(t) for k, t in want.items()}
    assert got[5]["n_filled"] < 50 and got[3]["n_filled"] == 0
    assert byte_pieces.encode_edited(df.where("false"), PATH, PATTERN).count() == 0
