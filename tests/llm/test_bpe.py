"""Encoding against the tiktoken library and against merges one at a time, decoding as a round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures_llm import SF, TEXTS, empty_docs, odd_docs, rows

from netspark.llm import bpe
from netspark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary("byte_bpe_50k")


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def one_at_a_time(vocabulary, data):
    parts = [bytes([b]) for b in data]
    if data in vocabulary.ranks:
        return [vocabulary.ranks[data]]
    while len(parts) > 1:
        ranks = [vocabulary.ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        at = ranks.index(min(ranks))
        if ranks[at] == 1 << 40:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [vocabulary.ranks[p] for p in parts]


def random_words(n, longest):
    rng = random.Random(n)
    letters = ["ab", "aab ", "etaoin shrdlu", "".join(map(chr, range(32, 127))), "éüñ中文字🙂́", "\n\t \r\x00"]
    return sorted({"".join(rng.choices(rng.choice(letters), k=rng.randint(1, longest))) for _ in range(n)})


def test_words_as_single_merges(vocabulary):
    words = random_words(3000, 40)
    found = vocabulary.encode_words(words)
    assert found == {w: tuple(one_at_a_time(vocabulary, w.encode())) for w in words}


def test_long_words_as_the_matrix_and_as_single_merges(vocabulary, library):
    words = random_words(300, 400) + ["a" * 500, "ab" * 301, "aab" * 200, " " * 1000]
    for w in words:
        data = w.encode()
        if len(data) < 2:
            continue
        ids = vocabulary.of_byte[np.frombuffer(data, np.uint8)]
        want = [] if data in vocabulary.ranks else one_at_a_time(vocabulary, data)
        if want:
            assert vocabulary.long_row(ids).tolist() == want
            assert vocabulary.matrix_rows(np.array([ids]))[0] == tuple(want)
    huge = "a" * 200_000 + "".join(random.Random(1).choices("etaoinshrdlu", k=30_000))
    assert list(vocabulary.encode_words([huge])[huge]) == library.encode_ordinary(huge)


def test_pairs_without_a_token(vocabulary):
    left, right = np.arange(256, dtype=np.int32).repeat(256), np.tile(np.arange(256, dtype=np.int32), 256)
    want = [vocabulary.ranks.get(vocabulary.tokens[a] + vocabulary.tokens[b], bpe.NONE) for a, b in zip(left, right)]
    assert vocabulary.rank(left, right).tolist() == want
    assert vocabulary.rank(np.array([bpe.NONE, 0]), np.array([0, bpe.NONE])).tolist() == [bpe.NONE, bpe.NONE]


def test_odd_rows(spark, library, monkeypatch):
    docs = odd_docs(spark)
    encoded = bpe.encode(docs, ("doc_id", "source"))
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["ids"])
    want = [{"doc_id": i, "source": s, "ids": library.encode_ordinary(t or "")} for i, t, s in TEXTS]
    assert sorted(rows(encoded), key=key) == sorted(want, key=key)
    texts = sorted((r["bytes"] for r in rows(bpe.decode(encoded, ()))))
    assert texts == sorted((t or "").encode() for _, t, _ in TEXTS)
    assert rows(bpe.encode(empty_docs(spark))) == [] and rows(bpe.decode(bpe.encode(empty_docs(spark)))) == []
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("ids", docs.doc_id), ("ids",))


def test_long_texts_by_stretches(library, monkeypatch):
    monkeypatch.setattr(bpe, "MATCHES", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    encoder = bpe._Encoder("byte_bpe_50k")
    for _, text, _ in TEXTS:
        if text is not None and len(text) < 5000:
            assert encoder.long_text(text).tolist() == library.encode_ordinary(text) == encoder.texts([text, "x"])[0].tolist()


def test_unknown_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None), (4, [1, None]), (5, [60_000]), (6, [-1])], "doc_id bigint, ids array<int>")
    tokens = bpe.vocabulary("byte_bpe_50k").tokens
    assert {r["doc_id"]: r["bytes"] for r in rows(bpe.decode(df))} == {1: tokens[1] + tokens[2], 2: b"", 3: None, 4: None, 5: None, 6: None}


def test_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))}
    got = rows(QUERIES["op11_byte_bpe"](spark, SF))
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
